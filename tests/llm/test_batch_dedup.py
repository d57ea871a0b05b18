"""Duplicates of new batches against all history."""

from __future__ import annotations

import math
import tempfile

import numpy as np
from pyspark.sql import functions as F

from fluxloom.functions.geo import RadiusGrid
from fluxloom.llm import batch_dedup as bd
from fluxloom.llm import registry

SCHEMA = "id long, batch int, lon double, lat double, t long, rate double, tile string, row string"


def rows(n=160, seed=0):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for _ in range(n):
        lon, lat, t, rate = rng.uniform(-180, 180), rng.uniform(-80, 80), int(rng.integers(10**6, 2 * 10**6)), float(rng.uniform(50, 5000))
        for copy in range(int(rng.integers(1, 5))):
            a, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, 230)
            dlat = math.degrees(d * math.sin(a) / 6371000)
            dlon = math.degrees(d * math.cos(a) / 6371000 / math.cos(math.radians(lat)))
            out.append((k, int(rng.integers(0, 6)), (lon + dlon + 180) % 360 - 180, lat + dlat, t + int(rng.integers(0, 110)), rate * rng.uniform(0.95, 1.05) if rng.random() > 0.1 else None, "x", "x"))
            k += 1
    return out


def brute(data, tol=bd.Tolerance()):
    data = [r for r in data if r[2] is not None and r[4] is not None]
    parent = {r[0]: r[0] for r in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            p, q = math.radians(a[3]), math.radians(b[3])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            near = 2 * 6371000 * math.asin(math.sqrt(h)) <= tol.metres and abs(a[4] - b[4]) <= tol.seconds
            if near and (a[5] is None or b[5] is None or abs(a[5] - b[5]) <= 0.2 * max(a[5], b[5])):
                parent[root(a[0])] = root(b[0])
    classes = {}
    for r in data:
        classes.setdefault(root(r[0]), []).append((r[1], r[0]))
    return {(min(c)[1], k) for c in classes.values() for _, k in c if k != min(c)[1]}


def found(spark, data, by_batch=False):
    with tempfile.TemporaryDirectory() as folder:
        return {(r["kept_id"], r["id"]) for r in bd.find_duplicates(spark.createDataFrame(data, SCHEMA), f"{folder}/index", by_batch=by_batch).collect()}


def test_matches_brute_force(spark):
    data = rows()
    data += [(9000, 0, 179.9999, 10.0, 5000, 100.0, "", ""), (9001, 1, -179.9999, 10.0, 5100, 100.0, "", ""), (9002, 1, None, 10.0, 5100, 1.0, "", ""), (9003, 2, 179.9999, 10.0, None, 1.0, "", ""), (9004, 0, 0.0, 89.9999, 7000, None, "", ""), (9005, 0, 120.0, 89.9999, 7000, None, "", "")]
    got = found(spark, data)
    assert got == brute(data) and {(9000, 9001), (9004, 9005)} <= got and len(got) > 200
    assert found(spark, data, by_batch=True) == got


def test_links_between_later_members_are_kept(spark):
    step = 160 / 111194.9  # about 160 m apart, so tiles hold several and chains run through later members
    data = [(k, 0, 10.0, 20.0 + step * ((k * 7) % 24), 1000, 100.0, "", "") for k in range(24)]
    assert found(spark, data) == brute(data) and len(brute(data)) == 23


def test_late_links_in_the_middle_of_a_slot(spark):
    side = math.degrees(bd.Tolerance().metres / 1.45 / 6371000)
    lat = math.floor(90 / side) * side - 90 + side / 2
    for t in (1000, 1700, 1800, 1900):  # from 1680 on the heads' slot lies between those of the ends of the reach
        data = [(k, 0, (30 + x) * side - 180, lat, t, 100.0, "", "") for k, x in enumerate((0.01, 2.99, 0.99, 2.01))]
        assert found(spark, data) == brute(data) == {(0, 1), (0, 2), (0, 3)}, t


def diagonal(rate_a, rate_b):
    """Two tiles of two, corner to corner: the later members 490 m apart, the first ones three diagonals."""
    side = math.degrees(bd.Tolerance().metres / 1.45 / 6371000)
    r, c = math.floor(90 / side), 30
    at = lambda k: (c * side - 180 + k * side, r * side - 90 + k * side)
    return [(0, 0, *at(0.01), 5000, rate_a, "", ""), (1, 0, *at(2.99), 5000, rate_b, "", ""), (2, 1, *at(0.99), 5000, rate_a, "", ""), (3, 1, *at(2.001), 5000, rate_b, "", "")]


def test_late_links_across_diagonals_and_without_rates(spark):
    for rates in ((100.0, 100.0), (None, None), (None, 100.0), (100.0, None), (100.0, 90.0)):
        data = diagonal(*rates)
        assert found(spark, data) == brute(data) == {(0, 1), (0, 2), (0, 3)}, rates
    step = 160 / 111194.9
    data = [(k, 0, 10.0, 20.0 + step * ((k * 7) % 24), 1800, None, "", "") for k in range(24)]
    assert found(spark, data) == brute(data) and len(brute(data)) == 23


def test_late_match_that_is_earlier_wins(spark):
    # the tile without rates is tied at once to a record of batch 5, and by later members only to one of batch 1
    data = [(r[0], *((0, 1, 1, 1)[r[0]],), *r[2:]) for r in diagonal(100.0, None)]
    data += [(9, 5, data[1][2], data[1][3], 5000, 500.0, "", "")]
    assert found(spark, data) == {(0, 1), (0, 2), (0, 3)}


def test_crowd_of_copies_stays_linear(spark):
    crowd = [(k, k % 9, 10.0, 20.0, 1000, 100.0, "", "") for k in range(3000)] + [(10_000 + k, 1, 10.0 + k * 1e-6, 20.0, 1000 + k % 60, 100.0, "", "") for k in range(600)]
    assert found(spark, crowd) == {(0, r[0]) for r in crowd if r[0] != 0}


def test_unknown_rate_does_not_tie_two_rates(spark):
    data = [(1, 0, 10.0, 20.0, 1000, 100.0, "", ""), (2, 1, 10.0, 20.0, 1000, None, "", ""), (3, 2, 10.0, 20.0, 1000, 300.0, "", ""), (4, 3, 10.0, 20.0, 1000, 290.0, "", "")]
    assert found(spark, data) == {(1, 2), (3, 4)}


def test_batches_link_across_the_index(spark):
    # later members of a tile arrive batches after its head, and a late record joins two accepted classes
    for rates in ((100.0, 100.0), (None, None), (None, 100.0)):
        data = [(r[0], r[0], *r[2:]) for r in diagonal(*rates)]
        assert found(spark, data, by_batch=True) == brute(data) == {(0, 1), (0, 2), (0, 3)}, rates
    step = 400 / 111194.9
    data = [(1, 0, 10.0, 20.0, 1000, 50.0, "", ""), (2, 1, 10.0, 20.0 + 2 * step, 1000, 50.0, "", ""), (3, 2, 10.0, 20.0 + step, 1000, 50.0, "", "")]
    assert found(spark, data, by_batch=True) == brute(data) == {(1, 2), (1, 3)}


def test_index_is_appended_and_compacted(spark, tmp_path):
    data = rows(40, seed=4)
    df = spark.createDataFrame(data, SCHEMA)
    index = bd.CellIndex(spark, str(tmp_path / "cells"))
    index.accept(df.where("batch < 3"))
    index.compact()
    index.accept(df.where("batch between 3 and 4"))
    index.accept(df.where("batch = 5"))
    assert {(r["kept_id"], r["id"]) for r in index.repeats().collect()} == brute(data)


def test_groups_of_batches_double_the_index():
    assert bd.batch_groups([(0, 5), (2, 5), (3, 5)]) == [(0, 0), (2, 2), (3, 3)]
    groups = bd.batch_groups([(k, 10) for k in range(1000)], together=20)
    assert groups[:3] == [(0, 1), (2, 3), (4, 7)] and groups[-1][1] == 999 and len(groups) == 10
    assert all(b[0] == a[1] + 1 for a, b in zip(groups, groups[1:]))
    assert bd.batch_groups([(1, 10), (4, 1)], together=5) == [(1, 1), (4, 4)] and bd.batch_groups([], together=5) == []


def accepted(monkeypatch):
    """Counts the groups that an index accepts."""
    calls, accept = [], bd.CellIndex.accept_prepared
    monkeypatch.setattr(bd.CellIndex, "accept_prepared", lambda self, new: (calls.append(1), accept(self, new))[1])
    return calls


def test_groups_give_the_rows_of_single_batches(spark, monkeypatch):
    calls, data = accepted(monkeypatch), rows(120, seed=7)
    with tempfile.TemporaryDirectory() as folder:
        got = bd.find_duplicates(spark.createDataFrame(data, SCHEMA), f"{folder}/index", together=60).collect()
    assert {(r["kept_id"], r["id"]) for r in got} == brute(data) and 1 < len(calls) < 6


def test_the_query_does_not_read_its_index_once_a_batch(spark, sf_dir, monkeypatch):
    calls = accepted(monkeypatch)
    assert registry.p3_found(spark, sf_dir).count() > 0 and len(calls) == 1


def test_probes_are_the_cells_in_reach(spark):
    tol, grid = bd.Tolerance(), RadiusGrid(bd.Tolerance().cell_m)
    rng = np.random.default_rng(5)
    at = [(k, 0, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90)), 1000, 1.0) for k in range(300)]
    at += [(1000 + k, 0, float(rng.uniform(-180, 180)), float(s * (90 - 10 ** rng.uniform(-4, 0))), 1000, 1.0) for k in range(100) for s in (-1, 1)]
    at += [(2000, 0, 180.0, 10.0, 1000, 1.0), (2001, 0, -180.0, -10.0, 1190, 1.0), (2002, 0, 0.0, 90.0, 1000, 1.0), (2003, 0, 179.9999, 50.0, 1210, None)]
    df = bd.to_vectors(spark.createDataFrame(at, "id long, batch int, lon double, lat double, t long, rate double"), tol)
    slots = F.sequence(F.floor((F.col("t") - 240) / 1200), F.floor((F.col("t") + 240) / 1200))
    want = df.withColumn("c", F.explode(grid.touched(F.col("lon"), F.col("lat"), tol.metres))).withColumn("s", F.explode(slots)).select("id", F.xxhash64("c.row", "c.col", "s").alias("cell"))
    got = bd.probes(df, tol).select("id", "cell")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert bd.at_home(df, tol).select("id", "cell").exceptAll(got).count() == 0


def test_empty(spark):
    assert found(spark, []) == set()
