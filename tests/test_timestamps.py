"""Times and offsets in many notations."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pytest
from pyspark.sql import functions as F

from fluxloom.operators import timestamps as ts

SCHEMA = "plume_id long, time string, date string, datasource string, ingested_at timestamp, zone string, instant string"
SOURCES = [
    ("U", "plumes", "Clock is UTC."), ("D", "plumes", "Civil clock of zone America/Denver, month before day."), ("B", "plumes", "Civil clock of zone Europe/Berlin, day before month."),
    ("S", "plumes", "Civil clock of zone Australia/Sydney, day before month."), ("B", "obspack", "zone Asia/Tokyo"),
]


def run(spark, rows):
    t = datetime(2009, 4, 1, tzinfo=UTC)
    df = spark.createDataFrame([(k, *r, t, "x", "y") for k, r in enumerate(rows)], SCHEMA)
    clocks = ts.source_clocks(spark.createDataFrame(SOURCES, "source_name string, feeds_table string, description string"))
    return {r["plume_id"]: (r["instant"], r["status"]) for r in ts.normalise_times(df, "plume_id", clocks).collect()}


def utc(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp())


CASES = [
    (("2009-03-01T02:03:26Z", None, "D"), utc(2009, 3, 1, 2, 3, 26), "given"),
    (("2009-03-01T02:03Z", None, "D"), utc(2009, 3, 1, 2, 3), "given"),
    (("20090301T011629Z", None, "D"), utc(2009, 3, 1, 1, 16, 29), "given"),
    (("2009-060T01:06:46Z", None, "U"), utc(2009, 3, 1, 1, 6, 46), "given"),
    (("2009-03-01T02:03:26.954+01:00", None, "U"), utc(2009, 3, 1, 1, 3, 26), "given"),
    (("2009-02-28T19:16:11-0600", None, "U"), utc(2009, 3, 1, 1, 16, 11), "given"),
    (("1235869406", None, "D"), 1235869406, "given"),
    (("1235870651999", None, "D"), 1235870651, "given"),
    (("2009-03-01T05:03:26.642505902", None, "U"), utc(2009, 3, 1, 5, 3, 26), "ok"),
    (("2009-02-28 18:11:24 MST", None, "D"), utc(2009, 3, 1, 1, 11, 24), "given"),
    (("2/28/2009 06:19 PM", None, "D"), utc(2009, 3, 1, 1, 19), "ok"),
    (("3/10/2009 12:48 AM MDT", None, "D"), utc(2009, 3, 10, 6, 48), "given"),
    (("01/03/2009 09:42:25", None, "S"), utc(2009, 2, 28, 22, 42, 25), "ok"),
    (("01.04.2009 02:17", None, "B"), utc(2009, 4, 1, 0, 17), "ok"),
    (("01-Apr-2009 00:25 UTC", None, "U"), utc(2009, 4, 1, 0, 25), "given"),
    (("2009/3/1 1:51:28 UTC", None, "U"), utc(2009, 3, 1, 1, 51, 28), "given"),
    (("04:31:58", "20090301", "U"), utc(2009, 3, 1, 4, 31, 58), "ok"),
    (("000046Z", "2009-060", "U"), utc(2009, 3, 1, 0, 0, 46), "given"),
    (("01:00:06 PM", "1 Mar 2009", "B"), utc(2009, 3, 1, 12, 0, 6), "ok"),
    (("12:58:52 AM", "03/10/2009", "D"), utc(2009, 3, 10, 6, 58, 52), "ok"),
    (("2009-03-08 02:30:00", None, "D"), utc(2009, 3, 8, 9, 30), "nonexistent"),
    (("2009-04-05 02:30:00", None, "S"), utc(2009, 4, 4, 15, 30), "ambiguous"),
    (("nonsense", "20090301", "U"), None, "unreadable"),
    (("", None, None), None, "unreadable"),
    (("04:31:58", None, "U"), None, "unreadable"),
    (("2009-13-45 02:30:00", None, "U"), None, "unreadable"),
]


def test_times(spark):
    got = run(spark, [c[0] for c in CASES])
    for k, (row, instant, status) in enumerate(CASES):
        assert got[k] == (instant, status), row


def test_local_times_match_the_zone_database(spark):
    try:
        zone = ZoneInfo("Europe/Berlin")
    except ZoneInfoNotFoundError:
        pytest.skip("no zone database for Python")
    local = [datetime(2009, m, 28 if m == 2 else 29, h, 15) for m in range(1, 13) for h in (0, 1, 4, 12, 23)]
    got = run(spark, [(t.strftime("%d.%m.%Y %H:%M:%S"), None, "B") for t in local])
    for k, t in enumerate(local):
        assert got[k][0] == int(t.replace(tzinfo=zone).timestamp())


@pytest.mark.parametrize(
    ("text", "minutes"),
    [
        ("-6.0", -360), ("5.75", 345), ("-6,00", -360), ("60", 60), ("-210", -210), ("+0545", 345), ("-1000", -600), ("+05:30", 330), ("GMT-03:30", -210), ("UTC−5", -300), ("UTC+9:30", 570),
        ("Etc/GMT+8", -480), ("Etc/GMT-3", 180), ("Z", 0), ("±00:00", 0), ("PT-480M", -480), ("PT5H45M", 345), ("-PT3H", -180), ("12600 s", 210), ("-600 min", -600), ("−5 h", -300),
        ("3.5 h behind UTC", -210), ("9 h ahead of UTC", 540), ("what", None), ("", None), (None, None),
    ],
)
def test_offsets(spark, text, minutes):
    assert spark.range(1).select(ts.offset_minutes(F.lit(text).cast("string")).alias("x")).first()["x"] == minutes


def test_years_come_from_the_local_times(spark):
    # read years after it was written: the zone table must not follow the time of ingestion
    got = run(spark, [("2019-07-01 10:00:00", None, "D"), ("1955-07-01 10:00:00", None, "U"), ("9999-12-31 10:00:00", None, "D")])
    assert got[0] == (utc(2019, 7, 1, 16), "ok") and got[1] == (utc(1955, 7, 1, 10), "ok") and got[2][1] in ("ok", "unreadable")


def test_found_leaves_plain_forms_and_empty(spark):
    plumes = spark.createDataFrame([(1, "2009-03-01T02:03:26Z", None, "U", None, "", ""), (2, "2009-03-01T02:03Z", None, "U", datetime(2009, 4, 1), "", ""), (3, None, None, None, None, None, None)], SCHEMA)
    obs = spark.createDataFrame([(1, "-6.0"), (2, "14"), (3, "15"), (4, None), (5, "+3"), (6, "-0.0")], "row_id long, utc_conv string")
    sources = spark.createDataFrame(SOURCES, "source_name string, feeds_table string, description string")
    got = {tuple(r) for r in ts.times_found(plumes, obs, sources).collect()}
    assert got == {("plumes", 2, utc(2009, 3, 1, 2, 3)), ("obspack", 3, 15), ("obspack", 5, 180)}
    assert ts.times_found(plumes.limit(0), obs.limit(0), sources.limit(0)).count() == 0
