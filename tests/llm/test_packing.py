"""Filling windows with documents."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxloom.llm import packing

TIERS = (64, 128, 256)
PIECES = "doc_id long, piece int, token_start int, n_tokens int"


@given(st.lists(st.integers(1, 256), max_size=200))
@settings(max_examples=60, deadline=None)
def test_every_item_is_in_one_window_that_holds_it(sizes):
    windows = packing.pack_tiers(np.array(sizes, int), TIERS)
    assert sorted(i for _, items in windows for i in items) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) <= c and c in TIERS for c, items in windows)


def test_fill_is_high(spark):
    rng = np.random.default_rng(0)
    sizes = np.minimum(256, rng.lognormal(4, 0.8, 12_000).astype(int) + 1)
    df = spark.createDataFrame([(k, 0, 0, int(n)) for k, n in enumerate(sizes)], PIECES)
    placed = packing.pack(df, TIERS, shard_items=2000, step_tokens=2048)
    assert placed.count() == len(sizes) == placed.select("doc_id").distinct().count()
    per = placed.groupBy("window").agg(F.sum("n_tokens").alias("u"), F.max("used").alias("m"), F.max("tier").alias("c"), F.count_distinct("slot").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["u"] == r["m"] <= r["c"] and r["s"] == r["n"] for r in per)
    total = packing.fill_report(placed).where("tier = 0").first()
    assert total["fill"] > 0.99 and total["tokens"] == int(sizes.sum())


def test_step_groups_are_level_over_all_windows(spark):
    used = np.random.default_rng(1).integers(50, 65, 3200)
    used[:1600] = 64
    df = spark.createDataFrame([(64, f"{k % 9}-w{k}", int(u)) for k, u in enumerate(used)] + [(128, f"x{k}", 100) for k in range(5)], "tier int, window string, used int")
    for part_rows in (200_000, 100):
        got = packing.step_groups(df, 1024, part_rows=part_rows)
        assert got.count() == 3205 and got.select("window").distinct().count() == 3205
        load = got.join(df, ["tier", "window"]).where("tier = 64").groupBy("step").agg(F.sum("used").alias("u"), F.count("*").alias("n")).toPandas()
        assert len(load) == 200 and set(load["n"]) == {16} and load["u"].max() - load["u"].min() <= 20


def test_texts_are_cut_only_beyond_the_capacity(spark):
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "short text"), (2, "word " * 700), (3, None), (4, ""), (5, "<|endoftext|>"), (5, "short text")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = packing.token_pieces(docs, 256).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 5} and sum(r["doc_id"] == 5 for r in got) == 2
    two = sorted((r["piece"], r["token_start"], r["n_tokens"]) for r in got if r["doc_id"] == 2)
    assert [t[:2] for t in two] == [(0, 0), (1, 256), (2, 512)] and two[0][2] == two[1][2] == 256
    assert packing.pack(packing.token_pieces(docs, 256), TIERS).count() == len(got)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], PIECES), TIERS).count() == 0
