"""Connectors, logs, settings and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fluxloom.config import RunConfig, float_list
from fluxloom.operators import model
from fluxloom.sources import feeds
from fluxloom.streaming import incremental


def test_connectors(spark, tmp_path):
    (tmp_path / "weekly").mkdir()
    (tmp_path / "weekly/a.csv").write_text("date,time_UTC,lat,lon,source_rate_t/h,uncertainty_t/h,uncertainty\n20200105,10:00:00,31.5,-103.2,2.5,,0.5\n20200106,,31.5,-103.2,,,\n20200301,11:00:00,31,-103,1,0.2,\n")
    (tmp_path / "cat.csv").write_text(
        "plume_longitude,plume_latitude,datetime,emission_auto,emission_uncertainty_auto,instrument,platform,mission_phase\n-103,31,2020-01-07T10:00:00Z,800,nan,GAO,air,operations\n-103,32,2020-01-08T10:00:00Z,900,10,emi,iss,operations\n-1,2,2020-01-08T10:00:00Z,5,,tan,sat,first_light\n"
    )
    (tmp_path / "portal.geojson").write_text(json.dumps({"features": [{"type": "Feature", "properties": {"lon": 1.5, "lat": 2.5, "ch4_fluxrate": 70.0, "ch4_fluxrate_std": None, "tile_date": "2020-01-09T01:02:03", "satellite": "hyp-a"}, "geometry": None}]}))
    named = {"weekly_list": str(tmp_path / "weekly"), "catalogue": str(tmp_path / "cat.csv"), "portal": str(tmp_path / "portal.geojson")}
    rows = feeds.all_plumes(spark, named, "2020-01-01", "2020-02-01").collect()
    assert sorted((r["datasource"], r["emission_rate"], r["emission_rate_std"]) for r in rows if r["datasource"] != "CarbonMapper") == [("IMEO", 70.0, None), ("SRON", 2500.0, 500.0)]
    assert sorted(r["emission_rate"] for r in rows if r["datasource"] == "CarbonMapper") == [800.0, 900.0]
    assert feeds.catalogue(spark, named["catalogue"], satellites_only=True).count() == 1
    with pytest.raises(ValueError, match="no such connector"):
        feeds.all_plumes(spark, {"os.system": "x"})
    with pytest.raises(ValueError):
        feeds.all_plumes(spark, {})


def test_point_source_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,lat,lon\na,1.5,2.5\nb,,3\n")
    assert [tuple(r) for r in feeds.point_sources(spark, str(tmp_path / "p.csv")).collect()] == [(1.5, 2.5), (None, 3.0)]
    (tmp_path / "q.csv").write_text("name,lat\na,1\n")
    with pytest.raises(ValueError):
        feeds.point_sources(spark, str(tmp_path / "q.csv"))
    with pytest.raises(ValueError):
        feeds.point_sources(spark, "p.txt")


def test_log(spark, tmp_path):
    (tmp_path / "run.log").write_text("HEMCO: Opening /x/ExtData//a.nc\nreading nothing\n: READING /x/b.nc\nFILE NOT FOUND /x/c.nc\nHEMCO: Opening /x/ExtData/a.nc\n")
    log = str(tmp_path / "run.log")
    assert {tuple(r) for r in feeds.paths_in_log(spark, log).collect()} == {("/x/ExtData/a.nc", True), ("/x/b.nc", True), ("/x/c.nc", False)}
    assert feeds.any_line_contains(spark, log, "NOT FOUND") and not feeds.any_line_contains(spark, log, "zzz")


def test_settings():
    base = {k: 1 for k in ("RunName", "StartDate", "EndDate", "nBufferClusters", "PriorError", "ObsError", "Gamma")} | {"Res": "0.25x0.3125", "LonMin": -10, "LonMax": 10, "LatMin": 0, "LatMax": 5}
    assert RunConfig.of(base, env={}).checked().values["Res"] == "0.25x0.3125"
    assert RunConfig.of(base | {"KalmanMode": True}, env={}).missing == ["NudgeFactor", "UpdateFreqDays"]
    changed = RunConfig.of(base, env={"FLUXLOOM_LonMax": "20.5", "FLUXLOOM_RunName": "a b", "OTHER": "1"}).values
    assert changed["LonMax"] == 20.5 and changed["RunName"] == "a b"
    for bad in ({"LonMax": -20}, {"Res": "1x1"}):
        with pytest.raises(ValueError):
            RunConfig.of(base | bad, env={}).checked()
    assert float_list(3) == [3.0] and float_list([1, 2.5]) == [1.0, 2.5]
    for bad in ("3", [True], None):
        with pytest.raises(TypeError):
            float_list(bad)


def test_first_hour_and_element_kinds(spark):
    run = spark.createDataFrame([(25, 1, 1.0), (26, 1, 2.0), (24, 2, 9.0)], "hour long, cell long, v double")
    before = spark.createDataFrame([(23, 1, 5.0), (24, 1, 6.0), (24, 2, 7.0)], "hour long, cell long, v double")
    assert {tuple(r) for r in model.with_first_hour(run, before, ["cell"]).collect()} == {(25, 1, 1.0), (26, 1, 2.0), (24, 2, 9.0), (24, 1, 6.0)}
    assert model.with_first_hour(run.limit(0), before, ["cell"]).count() == 0
    e = spark.range(1, 13).select(F.col("id").alias("e"))
    kinds = lambda *a: [r["k"][0] for r in e.select(model.element_kind(F.col("e"), 12, *a).alias("k")).collect()]
    assert "".join(kinds(True, True, True)) == "eeeeeeebbbbo" and "".join(kinds(True, True, False)) == "eeeeeebbbboo" and "".join(kinds(False, False, True)) == "e" * 12
    runs = [r["r"] for r in e.select(model.run_number(F.col("e"), 12, 3, True, True, True).alias("r")).collect()]
    assert runs == [1, 1, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8]


def test_files_are_processed_once(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    df.coalesce(1).write.parquet(folder)
    for _ in range(2):
        incremental.drain(incremental.new_files(spark, folder, "id long, k string"), out, state)
    assert spark.read.parquet(out).count() == 2
    df.coalesce(1).write.mode("append").parquet(folder)
    incremental.drain(incremental.new_files(spark, folder, "id long, k string"), out, state)
    assert spark.read.parquet(out).count() == 4
    assert incremental.unprocessed(df.withColumnRenamed("k", "file_id"), spark.createDataFrame([("a",), ("a",)], "file_id string")).count() == 1
