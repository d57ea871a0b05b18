"""Regular grids from irregular readings."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators import regular

SCHEMA = "obspack_id string, time timestamp, value double, source string, slot long"


def frame(spark, hours, site="abc", kind="insitu"):
    t0 = datetime(2009, 3, 1, tzinfo=UTC)
    return spark.createDataFrame([(f"p~ch4_{site}_tower-{kind}_1_x~{k}", t0 + timedelta(hours=h), 1800.0 + h, "clash", 7) for k, h in enumerate(hours)], SCHEMA)


def brute(hours):
    t0 = datetime(2009, 3, 1, tzinfo=UTC)
    whole = sorted({t0 + timedelta(hours=int(np.floor(h))) for h in hours})
    out = set()
    for month in {(t.year, t.month) for t in whole}:
        have = [t for t in whole if (t.year, t.month) == month]
        t = have[0]
        while t < have[-1]:
            if t not in have:
                out.add(t.strftime("%Y-%m-%dT%H"))
            t += timedelta(hours=1)
    return out


def test_missing_hours_match_brute_force(spark):
    hours = np.cumsum(np.random.default_rng(2).exponential(3.0, 500)).tolist()  # over two months
    df = frame(spark, hours).union(frame(spark, [5.0, 900.0], "xyz", "flask"))
    got = [(r["sitecode"], r["slot"]) for r in regular.missing_hours(df).collect()]
    assert len(got) == len(set(got)) and {s for _, s in got} == brute(hours) and {c for c, _ in got} == {"abc"}


def test_shard_size_does_not_matter(spark):
    slots = spark.createDataFrame([("a", s, 1, float(s)) for s in (0, 1, 5, 30, 31, 400)] + [("b", 7, 1, 1.0)], "source string, slot long, n long, value double")
    results = [sorted(map(tuple, regular.regular_series(slots, shard_slots=k, by_month=False).drop("slot_start").collect())) for k in (3, 24, 1000)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 402
    status = {(r[0], r[1]): (r[3], r[2]) for r in results[0]}
    assert status[("a", 3)] == ("filled", 3.0) and status[("a", 100)] == ("missing", None) and status[("b", 7)][0] == "observed"


def test_nulls_and_empty(spark):
    df = frame(spark, [0.0, 4.0]).union(spark.createDataFrame([(None, None, None, None, None), ("p~ch4_abc_tower-insitu_1_x~9", datetime(2009, 3, 1, 2, tzinfo=UTC), float("nan"), None, None)], SCHEMA))
    assert regular.missing_hours(df.union(df)).count() == 3
    assert regular.missing_hours(df.where(F.lit(False))).count() == 0
