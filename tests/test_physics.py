"""Grids, soundings, inversions against closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import components, grid, inversion, kalman, report, soundings, statevector
from fluxloom.plans import reference


def clip(poly, x0, x1, y0, y1):
    """Textbook clipping of one polygon against a box."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(poly, poly[1:] + poly[:1]):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da < 0) != (db < 0):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        poly = out
        if not poly:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2


def test_clip_area_matches_textbook():
    rng = np.random.default_rng(0)
    n = 500
    ang = np.sort(rng.uniform(0, 2 * np.pi, (n, 4)), 1)
    x, y = np.cos(ang) * 0.4 + rng.uniform(-1, 1, (n, 1)), np.sin(ang) * 0.3 + rng.uniform(-1, 1, (n, 1))
    got = grid.clip_area(x, y, np.full(n, -0.5), np.full(n, 0.5), np.full(n, -0.4), np.full(n, 0.4))
    want = [clip(list(zip(a, b)), -0.5, 0.5, -0.4, 0.4) for a, b in zip(x, y)]
    assert np.allclose(got, want, atol=1e-12) and (got > 0).sum() > 50


def test_overlap_weights_sum_to_one(spark):
    box = lambda x, y, w: ([x - w, x + w, x + w, x - w], [y - w, y - w + 0.01, y + w + 0.01, y + w])
    rows = [(k, *box(-105 + 0.07 * k, 30 + 0.05 * k, 0.08)) for k in range(40)] + [(100, *box(-90.0, 30.0, 0.1)), (101, None, None), (102, [1.0], [1.0])]
    got = grid.overlap_cells(spark.createDataFrame(rows, "id long, lon_b array<double>, lat_b array<double>"), ["id"]).groupBy("id").agg(F.sum("weight").alias("w"), F.sum("area").alias("a")).collect()
    assert len(got) == 40 and all(abs(r["w"] - 1) < 1e-12 and abs(r["a"] - 0.16 * 0.16) < 1e-9 for r in got)


def test_nearest_index_ties_and_tolerance(spark):
    g = grid.GRID
    df = spark.createDataFrame([(g.lon0 + 0.15625,), (g.lon0 + 0.16,), (g.lon0 - 0.6,), (None,)], "x double")
    assert [r["k"] for r in df.select(g.i_of(F.col("x"), 0.5).alias("k")).collect()] == [0, 1, None, None]


def test_inner_domain_and_bounds(spark):
    df = spark.createDataFrame([(-106.75, 30.0), (-106.76, 30.0), (-101.4375, 34.75), (-103.0, 34.76), (None, 30.0)], "lon double, lat double")
    assert [r["x"] for r in df.select(grid.GRID.inner(F.col("lon"), F.col("lat")).alias("x")).collect()] == [True, False, True, False, None]
    grid.GRID.holds((-108.0, -101.0), (28.0, 35.0))
    with pytest.raises(ValueError):
        grid.GRID.holds((-109.0, -101.0), (28.0, 35.0))


def test_dilation_is_cut_at_the_edge(spark):
    got = grid.dilate(spark.createDataFrame([(1, 0, 0), (2, 10, 10)], "element int, i int, j int")).groupBy("element").count().collect()
    assert {r["element"]: r["count"] for r in got} == {1: 9, 2: 25}


def test_remap_conserves_mass_and_constants():
    rng = np.random.default_rng(3)
    sat = 1000 - np.cumsum(np.concatenate([np.zeros((20, 1)), rng.uniform(40, 80, (20, 12))], 1), 1)
    model = 990 - np.cumsum(np.concatenate([np.zeros((20, 1)), rng.uniform(20, 22, (20, 47))], 1), 1)
    model[:, -1] = 0
    assert np.allclose(soundings.remap_layers(sat, model, np.full((20, 47), 1.9)), 1.9)
    conc = rng.uniform(1.7, 2.0, (20, 47))
    got = soundings.remap_layers(sat, model, conc)
    edges = model.copy()
    edges[:, 0] = np.maximum(edges[:, 0], sat[:, 0])
    for r in range(20):
        for k in range(12):
            w = np.maximum(0, np.minimum(sat[r, k], edges[r, :-1]) - np.maximum(sat[r, k + 1], edges[r, 1:]))
            assert got[r, k] == pytest.approx((w * conc[r]).sum() / w.sum(), rel=1e-12)
    assert np.isnan(soundings.remap_layers(sat - 700, model + 400, conc)).all()


def test_rounded_hour(spark):
    df = spark.createDataFrame([(1800,), (5400,), (1801,), (86399,), (86399 + 86400,)], "s long")
    assert [r["h"] for r in df.select(soundings.rounded_hour(F.col("s"), F.lit(1)).alias("h")).collect()] == [0, 2, 1, 23, 48]


def system(n=6, m=400, seed=0):
    rng = np.random.default_rng(seed)
    k, x = rng.normal(size=(m, n)), rng.normal(1, 0.3, n)
    return k, k @ (x - 1) + rng.normal(0, 0.1, m), rng.integers(1, 4, m).astype(float)


def test_normal_equations_and_gaussian(spark):
    k, dy, p = system()
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(k, dy, p)], "k array<double>, dy double, p double").repartition(5)
    eq = inversion.normal_equations(df, 6, [15.0, 10.0], block=4)
    var = 225 * (225 * (0.45 / p + 0.55) + 20.25) / 245.25
    blocks = eq.where("sigma = 15").orderBy("I", "J").collect()
    whole = np.block([[np.array(r["vals"]).reshape(r["nr"], r["nc"]) for r in blocks if r["I"] == i] for i in (0, 1)])
    g, b = (k / var[:, None]).T @ k, (k / var[:, None]).T @ dy
    assert np.allclose(whole[:, :6], g) and np.allclose(whole[:, 6], b)
    got = inversion.gaussian(eq, inversion.Layout(6), inversion.members([0.5], [15.0], [0.25]), block=4).orderBy("element").toPandas()
    assert np.allclose(got["xhat"], 1 + np.linalg.inv(0.25 * g + np.eye(6) / 0.25) @ (0.25 * b)) and got["a_diag"].between(0, 1).all()
    params = inversion.members([0.25, 0.5], [15.0, 10.0], [0.5], bc=[5.0, 10.0])
    out = inversion.gaussian(eq, inversion.Layout(6, n_bc=1, n_oh=1), params, block=4)
    one = out.where("member = 0").orderBy("element").toPandas()
    plain = np.array([0.25**2] * 4 + [25.0, 0.25])
    tight = plain * [1, 1, 1, 1, 1, 1 / 5]
    assert np.allclose(one["xhat"], [1, 1, 1, 1, 0, 1] + np.linalg.solve(0.5 * g + np.diag(1 / tight), 0.5 * b))
    assert np.allclose(one["s_post_diag"], np.diag(np.linalg.inv(0.5 * g + np.diag(1 / plain))))
    summary = inversion.ensemble_summary(out, params, 4).toPandas()
    assert len(summary) == 8 and summary["is_default"].sum() == 1 and (summary["dofs_roi"] <= summary["dofs"]).all()
    assert summary.loc[summary["is_default"], "member"].iloc[0] == summary.sort_values("member").set_index("member")["ja_normalized"].sub(1).abs().idxmin()
    totals = inversion.ensemble_totals(out, spark.createDataFrame([(e, 2.0) for e in range(1, 5)], "element int, tg double")).first()
    each = out.where("element <= 4").groupBy("member").agg(F.sum("xhat").alias("x")).toPandas()["x"] * 2
    assert totals["members"] == 8 and totals["mean"] == pytest.approx(each.mean()) and totals["sd"] == pytest.approx(each.std(ddof=0))
    bad = spark.createDataFrame([([1.0] * 6, None, 1.0)], "k array<double>, dy double, p double")
    with pytest.raises(Exception, match="missing values"):
        inversion.normal_equations(bad, 6, [15.0]).collect()


def test_lognormal_converges_to_the_truth():
    rng = np.random.default_rng(1)
    k, x = rng.uniform(0, 1, (4000, 5)), np.array([0.5, 1.5, 2.0, 1.0, 0.8])
    dy = k @ (x - 1)
    xhat, _, kernel, _ = inversion.lognormal(k.T @ k / 1e-3, k.T @ dy / 1e-3, inversion.Layout(5), 2.0, 1.0, prior_scale=1.0, tolerance=1e-6)
    assert np.allclose(xhat, x, rtol=1e-2) and 0 < kernel.sum() <= 5
    # by default the prior is turned from a mean into a median, which strong data outweigh
    scaled = inversion.lognormal(k.T @ k / 1e-3, k.T @ dy / 1e-3, inversion.Layout(5), 2.0, 1.0, tolerance=1e-6)[0]
    assert np.allclose(scaled, x, rtol=2e-2)
    # without data the mean of the posterior is the mean of the prior: exp(s2/2) times its median
    assert np.allclose(inversion.lognormal(np.zeros((3, 3)), np.zeros(3), inversion.Layout(3), 2.0, 1.0)[0], 1.0)


def test_block_solve_of_two_thousand_elements(spark):
    n, block = 2000, 500
    rng = np.random.default_rng(6)
    a = rng.normal(size=(n, n)) / 50
    a = a @ a.T + np.eye(n)
    b = rng.normal(size=n)
    rows = [(1, i, j, block, block, a[i * block : (i + 1) * block, j * block : (j + 1) * block].ravel().tolist()) for i in range(4) for j in range(4)]
    rows += [(1, i, 4, block, 1, b[i * block : (i + 1) * block].tolist()) for i in range(4)]
    done = inversion.solved(spark.createDataFrame(rows, "member int, I int, J int, nr int, nc int, vals array<double>").repartition(8), ["member"], n, block)
    x = {r["I"]: r["vals"] for r in done.where("J = 4").collect()}
    assert np.allclose(np.concatenate([x[i] for i in range(4)]), np.linalg.solve(a, b))
    corner = done.where("I = 3 and J = 1").first()["vals"]
    assert np.allclose(np.array(corner).reshape(block, block), np.linalg.inv(a)[1500:, 500:1000])


def test_connected_classes(spark):
    chain = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (100, 102), (7, 7), (100, 101)]
    got = {r["node"]: r["label"] for r in components.connected_classes(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in (100, 101, 102)}
    assert components.connected_classes(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nudge_conserves_the_regional_total(spark):
    cells = [(i, j) for i in range(5) for j in range(4)]
    em = spark.createDataFrame([(i, j, 1.0 + i, 2.0) for i, j in cells], "i int, j int, flux double, area double")
    post = spark.createDataFrame([(i, j, -1.0 if (i, j) == (1, 1) else 1.2) for i, j in cells], "i int, j int, post double")
    state = spark.createDataFrame([(i, j, 1.0) for i, j in cells + [(9, 9)]], "i int, j int, sf double")
    mask = spark.createDataFrame([c for c in cells if c[0] < 4], "i int, j int")
    out = {(r["i"], r["j"]): r["sf"] for r in kalman.nudge(state, post, em, mask).collect()}
    want = sum((1.0 + i) * 2.0 * (-1.0 if (i, j) == (1, 1) else 1.2) for i, j in cells if i < 4)
    assert sum(out[c] * (1.0 + c[0]) * 2.0 for c in cells if c[0] < 4) == pytest.approx(want)
    assert out[(4, 0)] == 1.0 and out[(9, 9)] == 1.0 and len(out) == 21


def test_periods(spark):
    from datetime import date

    rows = kalman.periods(spark, date(2020, 1, 1), date(2020, 1, 20), 7).orderBy("period_number").collect()
    assert [(str(r["start"]), str(r["stop"])) for r in rows] == [("2020-01-01", "2020-01-08"), ("2020-01-08", "2020-01-15")]
    days = spark.createDataFrame([(date(2020, 1, k),) for k in (1, 2, 3, 4)], "d date")
    assert [r["d"].day for r in kalman.retained(days, date(2020, 1, 1), date(2020, 1, 4)).collect()] == [1, 4]
    with pytest.raises(ValueError):
        kalman.periods(spark, date(2020, 1, 1), date(2020, 1, 3), 7)


def test_reduction_keeps_every_cell(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(i, j, -100 + 0.3 * i, 30 + 0.25 * j, float(rng.uniform(0, 0.2))) for i in range(12) for j in range(10)], "i int, j int, lon double, lat double, a double")
    out = statevector.reduce_by_information(cells, "a", 0.15, 64)
    labels = sorted(r["label"] for r in out.select("label").distinct().collect())
    assert out.count() == 120 and labels == list(range(1, len(labels) + 1))


def test_regrid_of_a_constant_is_constant(spark):
    tenths = spark.createDataFrame([(x, y, 5.0) for x in range(0, 40) for y in range(0, 30)], "lon10 int, lat10 int, mean double")
    assert all(abs(r["mean"] - 5.0) < 1e-12 for r in report.conservative_regrid(tenths, 0.3125, 0.25).collect())


def test_inversions_take_whole_vectors(spark, sf_dir):
    for name in ("gaussian_posterior", "lognormal_posterior"):
        rows = reference.QUERIES[name](spark, sf_dir).collect()
        assert sorted(r["element"] for r in rows) == list(range(1, 65)) and all(np.isfinite(r["xhat"]) for r in rows), name
    assert reference.QUERIES["inversion_ensemble"](spark, sf_dir).where("dofs > 0 and dofs <= 64 and dofs_roi <= dofs").count() == 36
