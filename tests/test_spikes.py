"""Spikes, stuck stretches and impossible readings."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators import spikes

SCHEMA = "row_id long, obspack_id string, file_name string, time timestamp, value double, value_unit string, ch4 double, reason string"


def series(n=400, seed=0, scatter=4.0):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.5, 1.5, n))
    v = 1850 + 20 * np.sin(t / 40) + np.cumsum(rng.normal(0, 0.5, n)) + rng.normal(0, scatter, n)
    return t, np.round(v, 2)


def test_clean_series_has_no_flags():
    for seed in range(5):
        spike, stuck, _ = spikes.scan_series(*series(seed=seed))
        assert not spike.any() and not stuck.any()


def test_spikes_but_not_lasting_rises():
    t, v = series(seed=3)
    v[50] += 90
    v[51] += 85
    v[200] -= 100
    v[300:312] += 45  # a rise of half a day is real
    spike, _, _ = spikes.scan_series(t, v)
    assert set(np.flatnonzero(spike)) == {50, 51, 200}


def test_stuck_against_coarse_sensor():
    t, v = series(seed=4)
    v[100:112] = v[100]
    v[105] += 0.02
    _, stuck, _ = spikes.scan_series(t, v)
    assert set(np.flatnonzero(stuck)) == set(range(100, 112))
    coarse = np.round(v / 40) * 40  # this sensor repeats itself all the time
    assert not spikes.scan_series(t, coarse)[1].any()


def test_short_series():
    for n in range(4):
        spike, stuck, z = spikes.scan_series(np.arange(n, dtype=float), np.full(n, 1800.0))
        assert len(spike) == len(stuck) == len(z) == n and not spike.any() and not stuck.any()


def frame(spark, n=700):
    t, v = series(n, seed=9)
    v[350] += 120
    t0 = datetime(2009, 3, 1, tzinfo=UTC)
    rows = [(k, f"p~ch4_abc_tower-insitu_1_x~{k}", f"f{k // 200}", t0 + timedelta(hours=float(t[k])), float(v[k]), "ppb", 1850.0, "x") for k in range(n)]
    again = [(10_000 + k, rows[k][1], "f_again", rows[k][3], rows[k][4] / 1000, None, 1850.0, "x") for k in (350, 351)]
    odd = [
        (20_000, "p~ch4_abc_tower-insitu_1_x~a", "f0", rows[5][3], -9999.0, "ppb", None, "x"),
        (20_001, None, "f0", None, 1e30, None, None, "x"),
        (20_002, "p~ch4_abc_tower-insitu_1_x~b", "f0", rows[6][3], None, None, None, "x"),
        (20_003, "p~ch4_abc_tower-insitu_1_x~c", "f0", rows[7][3], float("nan"), None, None, "x"),
        (20_004, "no-dataset", "f0", rows[7][3], 90000.0, None, None, "x"),
        (20_005, "p~ch4_abc_tower-insitu_1_x~d", None, rows[7][3], -1.0, None, None, "x"),
    ]
    return spark.createDataFrame(rows + again + odd, SCHEMA)


def test_flag_readings_shards_agree(spark):
    df = frame(spark)
    for shard_rows in (100, 1500):
        got = {r["row_id"]: r["reason"] for r in spikes.flag_readings(df, shard_rows=shard_rows).collect()}
        assert got == {350: "spike", 10_350: "spike", 20_000: "impossible", 20_001: "impossible", 20_004: "impossible", 20_005: "impossible"}


def stuck_frame(spark, n, lo, hi):
    t, v = series(n, seed=11)
    v[lo:hi] = 1900.0
    t0 = datetime(2009, 3, 1, tzinfo=UTC)
    return spark.createDataFrame([(k, f"p~ch4_abc_tower-insitu_1_x~{k}", "f", t0 + timedelta(hours=float(t[k])), float(v[k]), "ppb", 1850.0, "x") for k in range(n)], SCHEMA)


def test_outage_longer_than_a_shard_is_stuck_throughout(spark):
    for n, lo, hi in ((3000, 800, 2300), (400, 0, 400)):
        got = {r["row_id"]: r["reason"] for r in spikes.flag_readings(stuck_frame(spark, n, lo, hi), shard_rows=300).collect()}
        assert set(range(lo, hi)) == {k for k, why in got.items() if why == "stuck"}


def test_burst_and_stray_time_make_even_shards(spark):
    n = 4000
    rows = [("d", f"id{k}", 1000.0 + k / n, 1850.0) for k in range(n)] + [("d", "stray", 900_000.0, 1850.0)]
    sizes = spikes._in_shards(spark.createDataFrame(rows, "dataset string, obspack_id string, time_h double, ppb double"), 500, 0.2).groupBy("shard").count().collect()
    assert len(sizes) >= 7 and max(r["count"] for r in sizes) <= 1100


def test_repeated_rows_and_empty(spark):
    df = frame(spark)
    assert spikes.flag_readings(df.union(df)).count() == 12
    assert spikes.flag_readings(df.where(F.lit(False))).count() == 0
