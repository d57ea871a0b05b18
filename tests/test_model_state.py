"""Model state, state vectors with buffers, restarts, caches and the names that settings may use."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import grid, kalman, model, statevector
from fluxloom.plans import reference
from fluxloom.sources import feeds


def test_element_axis_uses_the_base_of_its_kind(spark):
    tracers = spark.createDataFrame([(0, e, 1, 1, [10.0 + e, 20.0]) for e in range(1, 7)], "hour int, element int, i int, j int, ch4 array<double>")
    bases = spark.createDataFrame([(0, "0001", 1, 1, [10.0, 20.0]), (0, "0000", 1, 1, [5.0, 20.0])], "hour int, run_id string, i int, j int, ch4 array<double>")
    kind = model.element_kind(F.col("element"), 6, True, True, True)
    got = {r["element"]: r["dch4"] for r in model.element_axis(tracers, bases, kind, F.lit(0.5), 0.1, 10.0).collect()}
    assert got[1] == [2.0, 0.0] and got[3] == [0.3, 0.0] and got[6] == pytest.approx([110.0, 0.0])


def test_state_vector_with_buffer(spark):
    cells = spark.createDataFrame([(i, j, -100 + 0.3125 * i, 30 + 0.25 * j, not (i == 7 and j == 7)) for i in range(16) for j in range(14)], "i int, j int, lon double, lat double, dry boolean")
    inside = F.col("i").between(5, 9) & F.col("j").between(5, 8)
    out = statevector.native_state_vector(cells, inside, F.col("dry"), 4).toPandas()
    roi, buffer = out[out["is_roi"]], out[~out["is_roi"]]
    assert sorted(roi["element"]) == list(range(1, 20)) and set(buffer["element"]) == {20, 21, 22, 23}
    assert len(buffer) == 11 * 10 - 20 and buffer["i"].between(2, 12).all()
    assert set(statevector.native_state_vector(cells, inside, F.col("dry"), 0).where("not is_roi").select("element").distinct().toPandas()["element"]) == {-9999}
    with pytest.raises(ValueError, match="three cells"):
        statevector.buffer_cells(cells, cells.where(inside), 2)


def test_feasible_sizes_and_scaled_buffer(spark):
    statevector.check_feasible(640, 10, 0.25)
    with pytest.raises(ValueError):
        statevector.check_feasible(641, 10, 0.25)
    rows = statevector.scaled_buffer(spark.createDataFrame([(1, 2.0), (5, 2.0)], "element int, a double"), "a", 4, 0.5)
    assert [r["a"] for r in rows.orderBy("element").collect()] == [2.0, 1.0]


def test_levels_keep_every_cell_within_the_labels(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(i, j, -100 + 0.3 * i, 30 + 0.25 * j, float(rng.uniform(0, 0.2))) for i in range(12) for j in range(10)], "i int, j int, lon double, lat double, a double")
    for n in (None, 9):
        out = statevector.reduce_by_information(cells, "a", 0.3, 16, n).toPandas()
        assert len(out) == 120 and not out.duplicated(["i", "j"]).any()
        assert sorted(out["label"].unique()) == list(range(1, out["label"].nunique() + 1)) and (n is None or out["label"].nunique() <= n)
    assert statevector.reduce_by_information(cells.limit(0), "a", 0.3, 16).count() == 0


def test_regions_of_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 0.3125, 0.0), (9, 9, 3.0, 3.0), (30, 30, 50.0, 50.0)], "i int, j int, lon double, lat double")
    regions = spark.createDataFrame([(1, "POLYGON ((-1 -1, 0.1 -1, 0.1 1, -1 1, -1 -1))"), (2, "POLYGON ((0.1 -1, 2.9 -1, 2.9 2.9, 0.1 1, 0.1 -1))")], "place_id long, wkt string")
    got = {(r["i"], r["j"]): r["place_id"] for r in statevector.cell_regions(cells, regions, 0.3125, 0.25, 50_000.0).collect()}
    assert got == {(0, 0): 1, (1, 0): 2, (9, 9): 2}


def test_restart_needs_and_uses_the_archive(spark, tmp_path):
    cells = spark.createDataFrame([(i, 0) for i in range(4)], "i int, j int")
    em = cells.withColumn("flux", F.lit(2.0)).withColumn("area", F.lit(1.0))
    steps = [(cells.withColumn("post", F.lit(1.0) + F.col("i") * 0.1 * k), em) for k in (1, 2, 3)]
    whole = kalman.fold(cells, steps, cells).orderBy("i").toPandas()
    archive = str(tmp_path / "states")
    kalman.fold(cells, steps[:1], cells, archive=archive)
    again = kalman.fold(cells, steps[1:], cells, first=2, archive=archive).orderBy("i").toPandas()
    assert np.allclose(whole["sf"], again["sf"])
    with pytest.raises(ValueError, match="archived"):
        kalman.fold(cells, steps[1:], cells, first=2)


def test_eastern_edge_and_cover(spark):
    edges = spark.createDataFrame([(177.5,), (175.0,)], "lon double").select(grid.eastern_edge(F.col("lon"), 2.5).alias("e")).collect()
    assert [r["e"] for r in edges] == [180.0, 176.25]
    rows = spark.createDataFrame([(1.0, 1.0), (0.5, 1.0)], "covered double, pixel double")
    assert grid.checked_cover(rows, F.col("pixel"), 0.3125).count() == 2
    with pytest.raises(Exception, match="area differ"):
        grid.checked_cover(rows, F.col("pixel"), 2.5).collect()


def test_cache_falls_back_to_the_feed(spark, tmp_path):
    feed = tmp_path / "catalogue.csv"
    feed.write_text("plume_longitude,plume_latitude,datetime,emission_auto,emission_uncertainty_auto,instrument,platform,mission_phase\n1.5,2.5,2020-01-01T00:00:00Z,10,1,GAO,x,normal\n")
    first = feeds.cached(spark, "catalogue", str(feed), str(tmp_path / "cache")).collect()
    feed.unlink()
    assert feeds.cached(spark, "catalogue", str(feed), str(tmp_path / "cache")).collect() == first and len(first) == 1
    with pytest.raises(ValueError):
        feeds.cached(spark, "unknown", str(feed), str(tmp_path / "cache"))


def test_operators_are_named(spark, sf_dir):
    assert set(reference.observe("centers", spark, sf_dir).columns) == set(reference.observe("overlaps", spark, sf_dir).columns)
    with pytest.raises(ValueError, match="no such operator"):
        reference.observe("eval", spark, sf_dir)
