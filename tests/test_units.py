"""Units from labels, prose and values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.functions.unit_labels import MOLE_FRACTION, fraction_unit, rate_unit
from fluxloom.operators import units

OBS = "row_id long, obspack_id string, file_name string, value double, value_unit string, ch4 double"
PLUMES = "plume_id long, datasource string, emission_rate double, rate_unit string, remarks string"
SOURCES = "source_name string, feeds_table string, description string"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        ("ppb (dry air)", "ppb"), ("nmol mol-1", "ppb"), ("1e-9", "ppb"), ("PPM ", "ppm"), ("µmol/mol", "ppm"), ("micromol per mol", "ppm"), ("pmol/mol", "ppt"),
        ("per cent by volume", "percent"), ("%", "percent"), ("1", "mol/mol"), ("mol CH4 per mol dry air", "mol/mol"), ("see header", None), (None, None), ("", None),
    ],
)
def test_fraction_labels(spark, text, unit):
    assert one(spark, fraction_unit(F.lit(text).cast("string"))) == unit


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        ("kgh", "kg/h"), ("kg CH4 per hour", "kg/h"), ("flux entered in kg per hr after review; low confidence mask", "kg/h"), ("T/HR", "t/h"), ("Mg/h", "t/h"),
        ("NB flux = metric tonnes hourly", "t/h"), ("LB HR-1", "lb/h"), ("crew gave pounds an hour", "lb/h"), ("g s-1", "g/s"), ("rate is g per s, not yet converted", "g/s"),
        ("kt a-1", "kt/yr"), ("stated as kt per annum", "kt/yr"), ("annualised figure, kilotonnes a year", "kt/yr"), ("they don't have it", None), (None, None),
    ],
)
def test_rate_labels(spark, text, unit):
    assert one(spark, rate_unit(F.lit(text).cast("string"))) == unit


def make_obs(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for f, unit in enumerate(["ppb", "ppm", "ppt", "percent", "mol/mol", "ppb"]):
        for _ in range(40):
            rows.append((n, f"a~d~{n}", f"f{f}", float(rng.normal(1850, 15)) / MOLE_FRACTION[unit], "ppb" if f in (0, 1) else None, 1850.0))
            n += 1
    rows += [(n, "a~d~x", "f1", 9.0, None, 1.85e-6), (n + 1, "a~d~y", "f1", float("nan"), None, None), (n + 2, "a~d~z", "f9", None, "ppm", 1850.0), (n + 3, None, None, -9999.0, None, None)]
    return spark.createDataFrame(rows, OBS)


def test_units_by_mixture_beat_stale_labels(spark):
    files = {r["file_name"]: r for r in units.obspack_file_units(make_obs(spark)).collect()}
    assert [files[f"f{k}"]["value_unit_true"] for k in range(6)] == ["ppb", "ppm", "ppt", "percent", "mol/mol", "ppb"]
    assert files["f9"]["value_unit_true"] == "ppm"  # nothing but a label
    assert all(files[f"f{k}"]["value_posterior"] > 0.99 for k in range(6))


def test_found_rows(spark):
    plumes = spark.createDataFrame(
        [(1, "A", 2.0, "t/h", None), (2, "A", 2.0, None, "rate in g per s"), (3, "A", 2.0, None, None), (4, "A", -9999.0, "t/h", None), (5, "B", 3.0, None, None), (6, None, None, None, None)], PLUMES
    ).withColumn("_default_unit_", F.lit("x"))
    sources = spark.createDataFrame([("A", "plumes", "Rates in pounds per hour."), ("B", "plumes", None), ("A", "obspack", "kg per hour")], SOURCES)
    got = {(r["field"], r["row_id"]): r["unit"] for r in units.units_found(make_obs(spark), plumes, sources).collect()}
    assert got[("emission_rate", 1)] == "t/h" and got[("emission_rate", 2)] == "g/s" and got[("emission_rate", 3)] == "lb/h"
    assert not any(k[0] == "emission_rate" and k[1] in (4, 5, 6) for k in got)
    assert sum(k[0] == "value" for k in got) == 40 * 4 + 1  # the bad reading has the unit of its file
    assert ("ch4", 240) not in got


def test_unlabelled_rates_follow_the_mixture_where_it_can_tell(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "A", float(300 * rng.lognormal(0, 0.1)), None, None) for k in range(300)] + [(1000 + k, "B", float(0.3 * rng.lognormal(0, 0.1)), None, None) for k in range(300)]
    plumes = spark.createDataFrame(rows + [(5000, "C", 41.0, None, None)], PLUMES)
    sources = spark.createDataFrame([("A", "plumes", None), ("B", "plumes", "No word on units.")], SOURCES)
    got = {r["plume_id"]: r for r in units.with_kg_per_h(plumes, sources, evidence=True).collect()}
    assert got[3]["rate_unit_true"] == "kg/h" and not got[3]["rate_uncertain"]
    assert got[1003]["rate_unit_true"] == "t/h" and not got[1003]["rate_uncertain"] and 100 < got[1003]["kg_h"] < 1000
    assert got[5000]["rate_uncertain"]
    assert got[3]["plume_id"] == 3 and units.with_kg_per_h(plumes, sources).where("kg_h is not null").count() == 0


def test_empty_tables(spark):
    none = units.units_found(spark.createDataFrame([], OBS), spark.createDataFrame([], PLUMES), spark.createDataFrame([], SOURCES))
    assert none.count() == 0
