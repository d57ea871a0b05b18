"""Schemas that drift between files."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from fluxloom.operators import drift
from fluxloom.plans import problems

SCHEMA = "rec_id long, feed string, file_name string, line_no int, payload string, delivered_at timestamp, tag string, text string"


def raw(spark, files, twice=()):
    rows, t = [], datetime(2009, 3, 1, tzinfo=UTC)
    for name, lines in files.items():
        first = 0 if name.endswith(".csv") else 1
        for copy in range(2 if name in twice else 1):
            for k, line in enumerate(lines):
                rows.append((len(rows), name.split("_")[0], name, first + k, line if isinstance(line, str) or line is None else json.dumps(line), t, "clash", "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return {(r["file_name"], r["field"], r["change"]) for r in drift.schema_changes(drift.file_schemas(drift.tagged_fields(df))).collect()}


FILES = {
    "A-1_20090302.jsonl": [{"lon": 1.5, "lat": 2, "rate": 5, "tile_date": 20090301, "bounds": [1, 2], "ok": True}, {"lon": None, "lat": 3, "rate": None}],
    "A-1_20090301.jsonl": [{"lon": 1.5, "lat": 2.5, "emission": 5, "tile_date": "2009-03-01"}, '{"lon": 7, "broken', "[1, 2]", "", '{"lon": NaN, "lat": 1, "emission": "x"}'],
    "A-1_20090305.jsonl": [{"lon": 1.5, "lat": 2, "rate": {"value": 3, "unit": "kg/h"}, "Tile_date": None, "bounds": None, "ok": "Y"}],
    "A-1_20090309.jsonl": [{"lon": "1.5E", "lat": 2, "rate": 7, "Tile_date": "2009-03-04", "bounds": [1]}],
    "B-2_20090301.csv": ["date,lon,lat,uncertainty_t/h", "20090301,1.5,2.5,0.1", "20090302,1.5,2.5", "20090303,-1.5,NaN,"],
    "B-2_20090308.csv": ["lat;lon;date;uncertainty_t/h;note", "2.5;1.5;2009-03-09;;a", '2.5;1.5;2009-03-10;;"b;c"'],
    "B-2_20090315.csv": ["lat\tlon\tdate\tuncertainty_t/h", "2.5N\t1.5\t20090316\t0.5"],
}
WANT = {
    ("A-1_20090302.jsonl", "rate", "renamed"), ("A-1_20090302.jsonl", "tile_date", "retyped"), ("A-1_20090302.jsonl", "bounds", "added"), ("A-1_20090302.jsonl", "ok", "added"),
    ("A-1_20090305.jsonl", "rate", "retyped"), ("A-1_20090305.jsonl", "Tile_date", "renamed"), ("A-1_20090305.jsonl", "ok", "retyped"),
    ("A-1_20090309.jsonl", "lon", "retyped"), ("A-1_20090309.jsonl", "rate", "retyped"), ("A-1_20090309.jsonl", "ok", "removed"), ("A-1_20090309.jsonl", "Tile_date", "retyped"),
    ("B-2_20090308.csv", "date", "retyped"), ("B-2_20090308.csv", "note", "added"),
    ("B-2_20090315.csv", "date", "retyped"), ("B-2_20090315.csv", "lat", "retyped"), ("B-2_20090315.csv", "note", "removed"),
}


def test_changes(spark):
    got = changes(raw(spark, FILES, twice=("A-1_20090305.jsonl", "B-2_20090308.csv")))
    # the renamed field has no value in its first file, and then the type of its own first value
    assert got - {("A-1_20090309.jsonl", "Tile_date", "retyped")} == WANT - {("A-1_20090309.jsonl", "Tile_date", "retyped")}


def test_alternatives_are_kept(spark):
    s = drift.file_schemas(drift.tagged_fields(raw(spark, FILES)))
    alt = {(r["file_name"], r["field"]): r["alternatives"] for r in s.collect()}
    assert alt[("A-1_20090301.jsonl", "emission")] == ["number", "text"] and alt[("A-1_20090305.jsonl", "bounds")] == []


def test_unified_table(spark):
    rows = drift.unified_table(raw(spark, FILES, twice=tuple(FILES))).collect()
    assert len(rows) == len({(r["file_name"], r["line_no"]) for r in rows}) == 11
    by = {(r["file_name"], r["line_no"]): r for r in rows}
    assert by[("A-1_20090305.jsonl", 1)]["rate"] == 3.0 and by[("A-1_20090305.jsonl", 1)]["rate_unit"] == "kg/h"
    assert by[("B-2_20090315.csv", 1)]["lat"] == 2.5 and str(by[("B-2_20090308.csv", 2)]["obs_date"]) == "2009-03-10"
    assert by[("B-2_20090308.csv", 2)]["branches"]["note"]["text"] == "b;c"


def test_table_keeps_the_content_of_the_branches(spark, tmp_path):
    lines = [{"lon": 1, "datetime": "2009-03-01T07:05", "satellite": "cam7", "carrier": "air", "n": "3", "ok": True, "bounds": [1, "b", {"c": 2}], "q": {"value": 3, "unit": "kg/h"}}]
    files = {"A-1_20090301.jsonl": lines, "B-2_20090301.csv": ["date,time_UTC,lat,Instrument", "20090303,9:46:15,2.5,sat-a"], "C-3_20090301.jsonl": [{"dt_acq": 1236000000, "x": None}]}
    raw(spark, files).write.parquet(str(tmp_path / "plume_raw.parquet"))
    out = {r["feed"]: r.asDict(recursive=True) for r in problems.p2_table(spark, str(tmp_path)).collect()}
    a, b, c = out["A-1"], out["B-2"], out["C-3"]
    pairs = lambda v: [tuple(x.values()) for x in v]
    assert (a["obs_time"], a["instrument"], a["platform"]) == ("07:05:00", "cam7", "air") and (b["obs_time"], b["instrument"], b["platform"]) == ("09:46:15", "sat-a", None)
    assert c["obs_time"] == "13:20:00" and pairs(c["numbers"]) == [("dt_acq", 1236000000.0)]
    assert pairs(a["numbers"]) == [("lon", 1.0)] and pairs(a["booleans"]) == [("ok", True)] and pairs(a["lists"]) == [("bounds", ["1", "b", '{"c":2}'])]
    assert pairs(a["texts"]) == [("carrier", "air"), ("datetime", "2009-03-01T07:05"), ("n", "3"), ("satellite", "cam7")]
    assert a["objects"][0]["field"] == "q" and sorted(pairs(a["objects"][0]["value"])) == [("unit", "kg/h"), ("value", "3")]
    assert pairs(b["numbers"]) == [("date", 20090303.0), ("lat", 2.5)] and a["n_fields"] == 8


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "A", "A_20090301.jsonl", 1, None, None, None, None), (3, "A", "A_20090301.csv", 0, "", None, None, None)], SCHEMA)
    assert changes(df) == set() and drift.unified_table(df).count() == 0
    assert changes(df.limit(0)) == set()


def test_alternatives_per_path_are_reported(spark):
    df = raw(spark, {
        "A-1_20090301.jsonl": [{"rate": 5, "at": {"lon": 1.5}, "tags": [1, 2]}],
        "A-1_20090302.jsonl": [{"rate": 5, "at": {"lon": 1.5}, "tags": [1, "x"]}, {"rate": 6}, {"rate": "many", "at": {"lon": "1.5E"}}],
        "A-1_20090303.jsonl": [{"rate": 7, "at": {"lon": "1.5E"}, "tags": ["x"]}, '{"broken'],
    })
    got = {(r["file_name"][4:12], r["field"], r["alternative"], r["change"]) for r in drift.alternative_changes(df).collect()}
    assert got == {
        ("20090302", "rate", "text", "appears"), ("20090302", "at.lon", "text", "appears"), ("20090302", "tags[]", "text", "appears"),
        ("20090303", "rate", "text", "disappears"), ("20090303", "at.lon", "number", "disappears"), ("20090303", "tags[]", "number", "disappears"),
    }
    assert drift.alternative_changes(df.limit(0)).count() == 0
