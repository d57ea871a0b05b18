"""Evaluation texts leaking into documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluxloom.llm import leakage
from fluxloom.llm.words import words

DOCS, ITEMS = "doc_id long, text string, term string, n int", "item_id long, text string, term string"
VOCABULARY = [f"w{k}x" for k in range(400)] + ["the", "of", "and", "a"] * 20


def passage(rng, n):
    return [VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), n)]


def build(spark):
    rng = np.random.default_rng(0)
    items = {k: passage(rng, 60) for k in range(8)}
    items[8] = items[0][:40] + passage(rng, 20)  # shares a passage
    docs, want = {}, set()
    for k in range(40):
        docs[k] = passage(rng, 80)
    for k in range(8):
        docs[100 + k] = passage(rng, 20) + items[k][20:33] + passage(rng, 20)
        want |= {(k, 100 + k)} | ({(8, 100)} if k == 0 else set())
        docs[200 + k] = passage(rng, 20) + items[k][5:14] + passage(rng, 20)  # nine words are no case
        fuzzy = [w if n % 8 else ("zz" if n % 16 else None) for n, w in enumerate(items[k][10:55], 1)]
        docs[300 + k] = passage(rng, 30) + [w for w in fuzzy if w] + passage(rng, 30)
        want |= {(k, 300 + k)} | ({(8, 300)} if k == 0 else set())
        half = [w if n % 2 else "zz" for n, w in enumerate(items[k][10:55])]
        docs[400 + k] = half + items[k][0:6]
    texts = [(i, " ".join(w)) for i, w in docs.items()]
    texts += [(500, "«" + ", ".join(items[1][:15]).upper() + "»\n> É"), (501, None), (502, ""), (503, " \n\t "), (504, " ".join(passage(rng, 20_000) + items[2][:12] + passage(rng, 20_000)))]
    want |= {(1, 500), (2, 504)}
    return (
        spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], DOCS),
        spark.createDataFrame([(i, " ".join(w), "clash") for i, w in items.items()] + [(50, None, ""), (51, "", ""), (52, "too short", "")], ITEMS),
        want,
    )


def leaked(spark, folder, items, *batches):
    index = leakage.PostingIndex(spark, str(folder / "postings"))
    for docs in batches:
        index.add(docs)
    return [(r["item_id"], r["doc_id"]) for r in leakage.leaked_items(index, items).collect()]


def test_exact_and_near_passages(spark, tmp_path):
    docs, items, want = build(spark)
    got = leaked(spark, tmp_path, items, docs)
    assert set(got) == want and len(got) == len(set(got))


def test_index_grows_by_segments(spark, tmp_path):
    docs, items, want = build(spark)
    got = leaked(spark, tmp_path, items, docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0"))
    assert set(got) == want and len(got) == len(set(got))


def test_without_broadcast_and_with_repeats(spark, tmp_path, monkeypatch):
    docs, items, want = build(spark)
    monkeypatch.setattr(leakage, "broadcast_if_small", lambda df, *a: df)
    got = leaked(spark, tmp_path, items, docs.union(docs))
    assert set(got) == want and len(got) == len(set(got))


def test_every_seventh_word_wrong_is_found(spark, tmp_path):
    rng = np.random.default_rng(3)
    items = {k: [f"u{x}" for x in rng.integers(0, 5000, 30)] for k in range(120)}
    docs = []
    for k, w in items.items():
        bad = rng.choice(30, 4, replace=False)
        kept = [("zz" if k % 2 else None) if n in bad else x for n, x in enumerate(w)]
        docs.append((k, "before " + " ".join(x for x in kept if x) + " after", "", 0))
        docs.append((1000 + k, " ".join(x if n % 3 else "zz" for n, x in enumerate(w)), "", 0))
    got = set(leaked(spark, tmp_path, spark.createDataFrame([(k, " ".join(w), "") for k, w in items.items()], ITEMS), spark.createDataFrame(docs, DOCS)))
    assert got == {(k, k) for k in items}


def test_empty_tables(spark, tmp_path):
    docs, items, _ = build(spark)
    assert leaked(spark, tmp_path / "a", items, docs.limit(0)) == []
    assert leaked(spark, tmp_path / "b", items.limit(0), docs) == []


def test_words_fold_case_accents_and_marks(spark):
    text = "Ça-va,  L'ÉTÉ straße­_x Œuvre​ 12.5"
    assert spark.range(1).select(words(F.lit(text)).alias("w")).first()["w"] == ["ca", "va", "l", "ete", "strasse", "x", "oeuvre", "12", "5"]


def test_postings_are_positions(spark):
    df = spark.createDataFrame([(1, "a b a", "", 0), (2, None, "", 0)], DOCS)
    assert sorted(r["pos"] for r in leakage.postings(df).collect()) == [0, 1, 2]
