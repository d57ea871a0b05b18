"""Registered queries of the flux-analytics operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.geo import position
from fluxloom.operators import bias, emissions, grid, inversion, kalman, model, preview, report, soundings, statevector, units
from fluxloom.operators.grid import GRID, dilate
from fluxloom.session import cut, ensure_checkpoint_dir
from fluxloom.sources.tables import dataset_of, finite, site_of, table
from fluxloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Domain of the grid's cells, edges included in the cells.
LON, LAT = (-108.15625, -100.03125), (27.875, 35.875)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; means of few decimals often end on a tie at the fourth digit, which is moved upwards."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + 1e-9 if digits == 4 else col, digits)


# --- inputs derived from the tables ------------------------------------------------------------


def soundings_in(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return soundings.screened(table(spark, d, "satellite_obs"), list(columns), LON, LAT)


def region(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "state_vector").where("is_roi").select("element", "i", "j")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "state_vector").where("element is not null").select("element", "i", "j", "is_roi")


def daily_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Emissions by day, cell and sector in the shape of the landing table, made of the line items."""
    sector = F.when(F.col("l_returnflag") == "A", "Oil").when(F.col("l_returnflag") == "N", "Gas").otherwise("Soil")
    return table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("d"), (F.col("l_partkey") % GRID.ni).cast("int").alias("i"), (F.col("l_suppkey") % GRID.nj).cast("int").alias("j"),
        sector.alias("sector"), (F.col("l_quantity") * 0.27182818284).alias("flux"), (600 + 3 * (F.col("l_suppkey") % GRID.nj)).cast("double").alias("area"),
    )


def whole_jacobian(spark: SparkSession, d: str) -> tuple[DataFrame, inversion.Layout]:
    """Rows of a Jacobian (vec_id, k, dy, p) made of the vectors, and the layout of a state vector of their length."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = e.select("vec_id", whole.alias("k"), F.element_at("embedding", 10).cast("double").alias("dy"), (1 + F.col("label")).cast("double").alias("p"))
    return rows, inversion.Layout(n, n_bc=2, n_oh=1, n_buffer=1)


def model_cells(spark: SparkSession, d: str, layers: int = 47) -> DataFrame:
    """Model columns per cell: pressure edges (hPa, falling) and mole fractions (mol/mol), made of the grid's numbers."""
    step = F.lit((1000.0 - 0.5) / layers)
    surface = F.lit(995.0) - (F.col("i") + F.col("j")) % 17
    edges = F.transform(F.sequence(F.lit(0), F.lit(layers)), lambda k: surface - k * step)
    conc = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda k: (F.lit(1900.0) - 3 * k + F.col("i") % 5) * 1e-9)
    return table(spark, d, "state_vector").select("i", "j", edges.alias("pedge"), conc.alias("conc"))


def model_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Satellite values paired with a model value per day and cell."""
    rows = soundings.center_weights(soundings_in(spark, d))
    model = F.lit(1850.0) + F.col("i") * 0.5 - F.col("j") * 0.25
    return rows.select(F.floor(F.unix_seconds("obs_time") / 86400).alias("day"), "i", "j", model.alias("model"), F.col("xch4").alias("satellite"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Station readings in ppb, whatever unit they came in; what is not a possible mole fraction (500-5000 ppb) is NULL."""
    o = units.with_ppb(table(spark, d, "obspack").select("row_id", "obspack_id", "time", "utc_conv", "obs_flag", "latitude", "file_name", "value", "value_unit", "ch4"))
    possible = lambda c: F.when(F.col(c).between(500, 5000), F.col(c)).alias(c)
    return o.select("row_id", "obspack_id", "time", "utc_conv", "obs_flag", "latitude", dataset_of(F.col("obspack_id")).alias("dataset"), site_of(F.col("obspack_id")).alias("site"), possible("ppb"), possible("ch4_ppb"))


# --- files and screening -----------------------------------------------------------------------


@query
def orbit_files(spark: SparkSession, d: str) -> DataFrame:
    return soundings.chosen_files(table(spark, d, "satellite_obs"))


@query
def duplicate_orbits(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "satellite_obs").select("file_id").distinct().select(*soundings.file_parts(F.col("file_id")))
    return files.groupBy("orbit").agg(F.count("*").alias("n_files"), F.count_distinct("mode").alias("n_modes")).where(F.col("n_files") > 1)


@query
def filter_obs(spark: SparkSession, d: str) -> DataFrame:
    return soundings_in(spark, d).select("file_id", "scanline", "pixel", _r("lon").alias("lon"), _r("lat").alias("lat"), _r("xch4").alias("xch4"))


@query
def sounding_derived(spark: SparkSession, d: str) -> DataFrame:
    rows = soundings.derived(table(spark, d, "satellite_obs"))
    total = F.aggregate("edges", F.lit(0.0), lambda s, x: s + x)
    return rows.select("file_id", "scanline", "pixel", _r("blended_albedo").alias("albedo"), F.col("surface").cast("bigint").alias("surface"), _r(total, 4).alias("edge_sum"), _r(F.col("edges")[12], 4).alias("top"))


@query
def files_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Files whose start date lies in [2009-03-10, 2009-04-10), with their number of soundings."""
    parts = table(spark, d, "satellite_obs").select("file_id", *soundings.file_parts(F.col("file_id")))
    day = F.substring("start", 1, 8)
    return parts.where((day >= "20090310") & (day < "20090410")).groupBy("file_id").agg(F.count("*").alias("n"))


@query
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days between the first and last order without an order."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days.distinct(), "day", "left_anti").select(F.col("day").cast("string").alias("day"))


# --- super-observations ------------------------------------------------------------------------


@query
def daily_bin_counts(spark: SparkSession, d: str) -> DataFrame:
    return preview.daily_counts(soundings_in(spark, d))


@query
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = soundings_in(spark, d)
    i, j = GRID.i_of(F.col("lon"), 0.5), GRID.j_of(F.col("lat"), 0.5)
    return rows.select("file_id", "scanline", "pixel", i.alias("i"), j.alias("j")).where(F.col("i").isNotNull() & F.col("j").isNotNull())


@query
def superobs_center(spark: SparkSession, d: str) -> DataFrame:
    s = soundings.superobservations(soundings.center_weights(soundings_in(spark, d)))
    return s.select("file_id", "i", "j", _r("count").alias("n"), _r("xch4", 4).alias("xch4"), _r("lon").alias("lon"), _r("lat").alias("lat"), "hour")


@query
def superobs_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = soundings.overlap_weights(soundings_in(spark, d, "lon_b", "lat_b"))
    s = soundings.superobservations(w)
    return s.select("file_id", "i", "j", _r("count").alias("n"), _r("xch4", 4).alias("xch4"), _r("lon").alias("lon"), _r("lat").alias("lat"), "hour")


@query
def trimmed_superobs(spark: SparkSession, d: str) -> DataFrame:
    """Super-observations within the domain shrunk by four cells, for the solver."""
    s = soundings.superobservations(soundings.center_weights(soundings_in(spark, d)))
    return s.where(GRID.inner(F.col("lon"), F.col("lat"))).groupBy("file_id").agg(F.count("*").alias("n"), _r(F.avg("xch4"), 4).alias("xch4"))


@query
def superobs_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean kernels and subcolumns of every layer per file and cell."""
    w = soundings.center_weights(soundings_in(spark, d, "ak", "subcol"))
    s = soundings.profile_means(w, ["ak", "subcol"]).select("file_id", "i", "j", F.posexplode(F.arrays_zip("ak", "subcol")).alias("layer", "x"))
    return s.select("file_id", "i", "j", "layer", _r("x.ak").alias("ak"), _r("x.subcol", 5).alias("subcol"))


@query
def superobs_error(spark: SparkSession, d: str) -> DataFrame:
    s = soundings.superobservations(soundings.center_weights(soundings_in(spark, d)))
    return s.groupBy(F.round("count").cast("bigint").alias("p")).agg(F.count("*").alias("n")).select("p", "n", _r(soundings.superobs_variance(15.0, F.col("p"))).alias("variance"), _r(soundings.superobs_error(15.0, F.greatest("p", F.lit(1)))).alias("error"))


@query
def vertical_remap(spark: SparkSession, d: str) -> DataFrame:
    """Model layers on the satellite layers of every screened sounding."""
    rows = soundings.center_weights(soundings_in(spark, d, "psurf", "dp")).join(model_cells(spark, d), ["i", "j"])
    edges = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.greatest(F.col("psurf") - k * F.col("dp"), F.lit(0.0)))
    out = rows.select("file_id", "scanline", "pixel", soundings.remapped(edges, F.col("pedge"), F.col("conc")).alias("x"))
    return out.where(F.col("x").isNotNull()).select("file_id", "scanline", "pixel", _r(F.col("x")[0] * 1e9, 5).alias("bottom"), _r(F.col("x")[11] * 1e9, 5).alias("top"))


@query
def column_xch4(spark: SparkSession, d: str) -> DataFrame:
    """Virtual satellite columns of the model against the observed ones, per day."""
    rows = soundings.center_weights(soundings_in(spark, d, "psurf", "dp", "ak", "prior", "subcol")).join(model_cells(spark, d), ["i", "j"])
    edges = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.greatest(F.col("psurf") - k * F.col("dp"), F.lit(0.0)))
    rows = rows.withColumn("layers", soundings.remapped(edges, F.col("pedge"), F.col("conc"))).where(F.col("layers").isNotNull())
    virtual = soundings.column_average(F.col("prior"), F.col("ak"), F.col("layers"), F.col("subcol"))
    return rows.groupBy(F.floor(F.unix_seconds("obs_time") / 86400).alias("day")).agg(F.count("*").alias("n"), _r(F.avg(virtual), 4).alias("model"), _r(F.avg("xch4"), 4).alias("satellite"))


@query
def pixel_model(spark: SparkSession, d: str) -> DataFrame:
    """The model's lowest layer at every pixel, averaged over the cells it covers."""
    w = soundings.overlap_weights(soundings_in(spark, d, "lon_b", "lat_b"))
    cells = model_cells(spark, d).select("i", "j", (F.col("conc")[0] * 1e9).alias("ppb"))
    return soundings.pixel_values(w, cells, "ppb").select("file_id", "scanline", "pixel", _r("ppb").alias("ppb"), "n_cells")


@query
def filter_blended(spark: SparkSession, d: str) -> DataFrame:
    """Soundings that pass the screening of blended products (their chi2 is made of the scan line), counted per class."""
    rows = soundings.blended(table(spark, d, "satellite_obs"), (F.col("scanline") * 17 % 30000).cast("double"), LON, LAT)
    return rows.groupBy(F.coalesce(F.col("surface_class"), F.lit(5)).alias("surface")).agg(F.count("*").alias("n"), _r(F.avg("xch4"), 4).alias("xch4"))


@query
def obs_in_mask(spark: SparkSession, d: str) -> DataFrame:
    """Soundings per element of the region, by nearest column and row of the grid."""
    rows = soundings_in(spark, d).select(GRID.i_of(F.col("lon")).alias("i"), GRID.j_of(F.col("lat")).alias("j"))
    return rows.groupBy("i", "j").agg(F.count("*").alias("n")).join(region(spark, d), ["i", "j"]).select("element", "n")


@query
def grid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the grid, its step, and the number of labels."""
    sv = table(spark, d, "state_vector")
    step = grid.axis_edges(sv, "lon").agg(F.median(F.col("upper") - F.col("lower")).alias("step")).first()["step"]
    out = sv.agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.count_distinct("element").alias("labels"))
    return out.withColumn("step", F.lit(step))


@query
def domain_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that belong to the domain: land, or offshore with emissions above a threshold; labelled by rows."""
    em = region_emissions(spark, d)
    sv = table(spark, d, "state_vector").join(em, ["i", "j"], "left")
    land = F.when(F.col("element").isNotNull(), 1.0).otherwise(0.0)
    cells = sv.where(statevector.included(land, F.coalesce("tg", F.lit(0.0)), 0.25, 420.0)).select("i", "j", "lon", "lat")
    return statevector.native_labels(cells, descending=False).select("i", "j", "element")


# --- information content -----------------------------------------------------------------------


def region_emissions(spark: SparkSession, d: str) -> DataFrame:
    mean = emissions.sector_mean(daily_emissions(spark, d))
    return mean.groupBy("i", "j").agg((F.sum(F.col("flux") * F.col("area")) * emissions.TG_PER_YEAR).alias("tg"))


@query
def preview_dofs(spark: SparkSession, d: str) -> DataFrame:
    out = preview.expected_dofs(soundings_in(spark, d), region(spark, d), region_emissions(spark, d))
    return out.select("element", _r("emission", 8).alias("emission"), "num_obs", "num_days", _r("sensitivity").alias("sensitivity"))


@query
def dilated_counts(spark: SparkSession, d: str) -> DataFrame:
    return preview.element_counts(preview.daily_counts(soundings_in(spark, d)), region(spark, d))


@query
def dilated_cells(spark: SparkSession, d: str) -> DataFrame:
    return dilate(labelled(spark, d)).groupBy("element").agg(F.count("*").alias("cells"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


# --- emissions ---------------------------------------------------------------------------------


@query
def mean_emissions(spark: SparkSession, d: str) -> DataFrame:
    return emissions.sector_mean(daily_emissions(spark, d)).select("i", "j", "sector", _r("flux").alias("flux"))


@query
def total_emissions(spark: SparkSession, d: str) -> DataFrame:
    return emissions.total_emissions(emissions.sector_mean(daily_emissions(spark, d)), region(spark, d)).select(_r("total").alias("total"))


@query
def sector_totals(spark: SparkSession, d: str) -> DataFrame:
    return emissions.sector_totals(emissions.sector_mean(daily_emissions(spark, d)), region(spark, d)).select("sector", _r("total").alias("total"))


def cell_scale(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("i", "j", (F.lit(0.5) + (F.col("element") % 7) * 0.25).alias("sf"))


@query
def posterior_emissions(spark: SparkSession, d: str) -> DataFrame:
    post = emissions.posterior_emissions(emissions.sector_mean(daily_emissions(spark, d)), cell_scale(spark, d))
    return post.groupBy("sector").agg(_r(F.sum(F.col("prior") * F.col("area")), 3).alias("prior"), _r(F.sum(F.col("posterior") * F.col("area")), 3).alias("posterior"))


@query
def perturbation_sf(spark: SparkSession, d: str) -> DataFrame:
    mean = emissions.sector_mean(daily_emissions(spark, d)).groupBy("i", "j").agg(F.sum("flux").alias("flux"))
    return emissions.perturbation_factors(mean, labelled(spark, d), 1.0).select("element", _r("jacobian_sf").alias("jacobian_sf"), _r("effective_sf").alias("effective_sf"))


@query
def gridded_scale(spark: SparkSession, d: str) -> DataFrame:
    """A vector by element on the grid; cells without an element are 1."""
    sv = table(spark, d, "state_vector").select("i", "j", "element")
    vector = labelled(spark, d).select("element").distinct().select("element", (F.lit(1.0) + (F.col("element") % 11) / 10.0).alias("v"))
    return sv.join(vector, "element", "left").select("i", "j", _r(F.coalesce("v", F.lit(1.0))).alias("scale"))


# --- inversion ---------------------------------------------------------------------------------


@query
def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    """K'K and K'dy of all elements, entry by entry (column n is the right side)."""
    rows, layout = whole_jacobian(spark, d)
    eq = inversion.normal_equations(rows, layout.n, [15.0], block=16)
    at = eq.select("I", "J", "nc", F.posexplode("vals").alias("k", "v"))
    return at.select((F.col("I") * 16 + F.floor(F.col("k") / F.col("nc"))).cast("int").alias("row"), (F.col("J") * 16 + F.col("k") % F.col("nc")).cast("int").alias("col"), _r("v").alias("v"))


@query
def gaussian_posterior(spark: SparkSession, d: str) -> DataFrame:
    rows, layout = whole_jacobian(spark, d)
    eq = inversion.normal_equations(rows, layout.n, [15.0], block=32)
    out = inversion.gaussian(eq, layout, inversion.members([0.5], [15.0], [0.25]), block=32)
    return out.select("element", _r("xhat").alias("xhat"), _r("s_post_diag").alias("s_post"), _r("a_diag").alias("a"))


def _ensemble(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], inversion.Layout]:
    sigmas = [10.0, 15.0]
    rows, layout = whole_jacobian(spark, d)
    eq = inversion.normal_equations(rows, layout.n, sigmas)
    params = inversion.members([0.25, 0.5, 0.75], sigmas, [0.1, 0.25, 1.0], bc=[5.0, 10.0])
    return inversion.gaussian(eq, layout, params), params, layout


@query
def inversion_ensemble(spark: SparkSession, d: str) -> DataFrame:
    elements, params, layout = _ensemble(spark, d)
    return inversion.ensemble_summary(elements, params, layout.n_emis - layout.n_buffer)


@query
def ensemble_totals(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the members' total emissions."""
    elements, _, layout = _ensemble(spark, d)
    tg = region_emissions(spark, d).join(labelled(spark, d), ["i", "j"]).where(F.col("element") <= layout.n_emis).groupBy("element").agg(F.sum("tg").alias("tg"))
    return inversion.ensemble_totals(elements, tg)


@query
def lognormal_posterior(spark: SparkSession, d: str) -> DataFrame:
    rows, layout = whole_jacobian(spark, d)
    eq = inversion.normal_equations(rows, layout.n, [15.0])
    out = inversion.lognormal_members(eq, layout, inversion.members([2.0], [15.0], [0.25]))
    return out.select("element", _r("xhat").alias("xhat"), _r("a_diag").alias("a"))


@query
def rescaled_jacobian(spark: SparkSession, d: str) -> DataFrame:
    """Every element of a reference Jacobian scaled to other perturbations; the last two have none and stay."""
    rows, layout = whole_jacobian(spark, d)
    eff = F.transform("k", lambda x: 2.0 + x * x)
    k = inversion.rescaled_jacobian(F.col("k"), F.array(*[F.lit(1.5 + 0.1 * e) for e in range(layout.n - 2)]), eff, 1e-8, 2e-8)
    return rows.select("vec_id", F.posexplode(k).alias("element", "v")).select("vec_id", "element", _r("v", 5).alias("k"))


# --- bias --------------------------------------------------------------------------------------


@query
def daily_bias(spark: SparkSession, d: str) -> DataFrame:
    return bias.daily_bias(model_pairs(spark, d)).select("day", "i", "j", _r("bias", 4).alias("bias"))


@query
def spatial_smooth(spark: SparkSession, d: str) -> DataFrame:
    return bias.smooth_in_space(bias.daily_bias(model_pairs(spark, d)), least=4).select("day", "i", "j", _r("bias", 4).alias("bias"))


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    daily = bias.daily_bias(model_pairs(spark, d))
    cells = table(spark, d, "state_vector").select("i", "j")
    return bias.trailing_means(bias.on_dense_days(daily, cells))


@query
def trailing_bias(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d).where("bias is not null").select("day", "i", "j", _r("bias", 4).alias("bias"))


@query
def lat_fill(spark: SparkSession, d: str) -> DataFrame:
    return bias.band_means(_trailing(spark, d), least=3).where("band is not null").select("day", "j", _r("band", 4).alias("band"))


@query
def corrected_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Boundary concentrations on three levels, corrected by the filled bias; mean per day and level."""
    filled = bias.filled_bias(_trailing(spark, d), least=3)
    levels = filled.select("day", "i", "j", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("lev")).withColumn("ppb", F.lit(1900.0) - 10 * F.col("lev"))
    return bias.corrected(levels, filled).groupBy("day", "lev").agg(_r(F.avg("ppb"), 4).alias("ppb"))


# --- sequential updates ------------------------------------------------------------------------


def _periods(spark: SparkSession, d: str, step_days: int = 30) -> tuple[DataFrame, int]:
    """Whole periods from the first to the last day of the emissions, and their number."""
    span = daily_emissions(spark, d).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    plan = kalman.periods(spark, span["a"], span["b"] + timedelta(days=1), step_days)
    return plan, plan.count()


@query
def kalman_periods(spark: SparkSession, d: str) -> DataFrame:
    """Emissions per whole 30-day period from the first day to the last."""
    plan, _ = _periods(spark, d)
    return kalman.in_periods(daily_emissions(spark, d), plan).groupBy("period_number").agg(F.count("*").alias("n"), _r(F.sum(F.col("flux") * F.col("area")), 2).alias("total"))


def _period_scale(spark: SparkSession, d: str, p: Column | int) -> Column:
    """Posterior factor of an element in a period, made of their numbers; some are negative."""
    return F.lit(0.75) + ((F.col("element") * 3 + p) % 5) * 0.125 - F.when(F.col("element") % 97 == p, 2.0).otherwise(0.0)


def _nudge_steps(spark: SparkSession, d: str, step_days: int) -> list[tuple[DataFrame, DataFrame]]:
    plan, n = _periods(spark, d, step_days)
    mean = kalman.in_periods(daily_emissions(spark, d).where(F.col("sector") != "Soil"), plan).groupBy("period_number", "i", "j").agg(F.avg("flux").alias("flux"), F.avg("area").alias("area"))
    mean = cut(mean)
    cells = table(spark, d, "state_vector").select("i", "j")
    post = lambda p: labelled(spark, d).select("i", "j", _period_scale(spark, d, p).alias("post"))
    return [(post(p), cells.join(mean.where(F.col("period_number") == p).drop("period_number"), ["i", "j"])) for p in range(1, n + 1)]


@query
def kalman_nudge(spark: SparkSession, d: str) -> DataFrame:
    """Scale factors after all periods of 360 days, each with its own posterior."""
    return kalman.fold(table(spark, d, "state_vector"), _nudge_steps(spark, d, 360), region(spark, d)).select("i", "j", _r("sf").alias("sf"))


@query
def kalman_restart(spark: SparkSession, d: str) -> DataFrame:
    """As kalman_nudge, stopped after three periods and taken up again from the archived states."""
    steps, sv, mask = _nudge_steps(spark, d, 360), table(spark, d, "state_vector"), region(spark, d)
    archive = f"{ensure_checkpoint_dir(spark)}/states-{uuid4().hex}"
    kalman.fold(sv, steps[:3], mask, archive=archive)
    return kalman.fold(sv, steps[3:], mask, first=4, archive=archive).select("i", "j", _r("sf").alias("sf"))


@query
def posterior_totals(spark: SparkSession, d: str) -> DataFrame:
    """Prior and posterior totals of the region per 30-day period."""
    plan, n = _periods(spark, d)
    scale = labelled(spark, d).select("i", "j", "element", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("period_number"))
    scale = scale.select("period_number", "i", "j", _period_scale(spark, d, F.col("period_number")).alias("sf"))
    out = emissions.posterior_totals(kalman.in_periods(daily_emissions(spark, d), plan), scale, region(spark, d))
    return out.select("period_number", _r("prior", 5).alias("prior"), _r("posterior", 5).alias("posterior"))


@query
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    """The region's cells clustered anew in every period of 720 days, by that period's share of the emissions."""
    steps = _nudge_steps(spark, d, 720)
    roi = table(spark, d, "state_vector").where("is_roi").select("i", "j", "lon", "lat")
    cells = [roi.join(em.select("i", "j", (F.col("flux") / 1000).alias("a")), ["i", "j"], "left").na.fill(0.0, ["a"]) for _, em in steps]
    return kalman.reclustered(cells, lambda c: statevector.reduce_by_information(c, "a", 0.05, statevector.MAX_CLUSTER[0.25]))


# --- plumes ------------------------------------------------------------------------------------


@query
def plume_cells(spark: SparkSession, d: str) -> DataFrame:
    """Plumes of space-borne instruments per cell and feed: detections, those without a rate, mean rate above a threshold."""
    p = units.with_kg_per_h(table(spark, d, "plumes"), table(spark, d, "sources")).where(~F.coalesce(F.col("instrument"), F.lit("")).isin("GAO", "ang", "av3"))
    at = p.withColumn("p", position(F.col("geometry"), F.col("lon"), F.col("lat")))
    cells = at.select("datasource", "kg_h", GRID.i_of(F.col("p.lon"), 0.5).alias("i"), GRID.j_of(F.col("p.lat"), 0.5).alias("j")).where(F.col("i").isNotNull() & F.col("j").isNotNull())
    each = cells.groupBy("i", "j", "datasource").agg(F.count("kg_h").alias("detect"), F.count(F.when(F.col("kg_h").isNull(), 1)).alias("blank"), F.avg("kg_h").alias("rate"))
    both = each.groupBy("i", "j").agg(F.sum("detect").alias("detect"), F.sum("blank").alias("blank"), F.avg("rate").alias("rate"))
    return both.where((F.col("rate") > 100) | (F.col("detect") > 10)).select("i", "j", "detect", "blank", _r("rate", 3).alias("rate"))


@query
def point_source_cells(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cells of the listed point sources on the domain, in descending order."""
    p = table(spark, d, "point_sources").select(GRID.i_of(finite(F.col("lon")), 0.5).alias("i"), GRID.j_of(finite(F.col("lat")), 0.5).alias("j"))
    return p.where(F.col("i").isNotNull() & F.col("j").isNotNull()).groupBy("i", "j").agg(F.count("*").alias("n")).orderBy(F.desc("j"), F.desc("i"))


# --- stations ----------------------------------------------------------------------------------


@query
def dataset_sigma(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation per dataset, and the readings beyond three deviations."""
    rows = readings(spark, d).where("ppb is not null")
    stats = rows.groupBy("dataset").agg(F.avg("ppb").alias("mean"), F.stddev_samp("ppb").alias("sd"))
    out = rows.join(stats, "dataset").groupBy("dataset").agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.count("*").alias("n"), F.count(F.when(F.abs(F.col("ppb") - F.col("mean")) > 3 * F.col("sd"), 1)).alias("beyond"))
    return out.select("dataset", _r("mean", 4).alias("mean"), _r("sd", 4).alias("sd"), "n", "beyond")


@query
def background_sites(spark: SparkSession, d: str) -> DataFrame:
    """Daily background means per flask dataset, on values converted to ppb."""
    o = units.with_ppb(table(spark, d, "obspack")).withColumn("dataset", dataset_of(F.col("obspack_id"))).withColumn("site", site_of(F.col("obspack_id")))
    kept = report.background(o.select("dataset", "site", "time", "utc_conv", "obs_flag", "ppb", "ch4_ppb", "latitude"))
    day = F.floor(F.unix_seconds("time") / 86400)
    return kept.where(F.col("dataset").contains("flask")).groupBy("site", "dataset", day.alias("day")).agg(F.count("*").alias("n"), _r(F.avg("ppb"), 3).alias("ppb"), _r(F.avg("ch4_ppb"), 3).alias("ch4_ppb"))


@query
def site_daily_means(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).where("ppb is not null and ch4_ppb is not null")
    return rows.groupBy("site", F.floor(F.unix_seconds("time") / 86400).alias("day")).agg(F.count("*").alias("n"), _r(F.avg("ppb"), 4).alias("ppb"), _r(F.avg("ch4_ppb"), 4).alias("ch4_ppb"))


@query
def latitude_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).where("ppb is not null")
    return rows.groupBy(F.floor(F.col("latitude") / 30).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"), _r(F.avg("ppb"), 4).alias("ppb"))


@query
def bias_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).where("ppb is not null and ch4_ppb is not null")
    out = report.error_statistics(rows, F.col("ppb"), F.col("ch4_ppb"), F.lit(1.0) + F.col("row_id") % 3, ["dataset"])
    return out.select("dataset", "n", _r("bias", 4).alias("bias"), _r("rmse", 4).alias("rmse"), _r("sd", 4).alias("sd"))


def _site_days(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).where("ppb is not null")
    return rows.groupBy("site", F.floor(F.unix_seconds("time") / 86400).alias("day")).agg(F.avg("ppb").alias("ppb"))


@query
def moving_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = _site_days(spark, d)
    return rows.select("site", "day", _r(report.centred_rows_mean(F.col("ppb"), ["site"], "day"), 4).alias("ppb"))


@query
def centered_30d(spark: SparkSession, d: str) -> DataFrame:
    rows = _site_days(spark, d).withColumn("s", F.col("day") * 86400)
    return rows.select("site", "day", _r(report.centred_days_mean(F.col("ppb"), ["site"], "s"), 4).alias("ppb"))


@query
def site_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Sites that have both in-situ and flask datasets."""
    o = readings(spark, d)
    return o.where(F.col("dataset").contains("insitu")).select("site").intersect(o.where(F.col("dataset").contains("flask")).select("site"))


@query
def model_obs_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered readings paired by id: number of deliveries and whether their model values agree."""
    o = table(spark, d, "obspack").groupBy("obspack_id").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"), F.max(finite(F.col("ch4"))).alias("hi"), F.min(finite(F.col("ch4"))).alias("lo"))
    return o.where(F.col("n") > 1).groupBy("n", "files").agg(F.count("*").alias("readings"), F.count(F.when(F.col("hi") == F.col("lo"), 1)).alias("same"))


# --- maps and state vector ---------------------------------------------------------------------


@query
def tenth_degree_means(spark: SparkSession, d: str) -> DataFrame:
    return report.tenth_degree(soundings_in(spark, d), "xch4").select("lon10", "lat10", "n", _r("mean", 4).alias("mean"))


@query
def dense_grid_left(spark: SparkSession, d: str) -> DataFrame:
    tenths = report.tenth_degree(soundings_in(spark, d), "xch4")
    out = report.dense_map(spark, tenths, (-1080, -1001), (280, 357))
    return out.groupBy("lat10").agg(F.count("*").alias("cells"), F.count("mean").alias("filled"), _r(F.avg("mean"), 4).alias("mean"))


@query
def conservative_regrid(spark: SparkSession, d: str) -> DataFrame:
    out = report.conservative_regrid(report.tenth_degree(soundings_in(spark, d), "xch4"), GRID.dlon, GRID.dlat)
    return out.select("I", "J", _r("mean", 4).alias("mean"), "n")


@query
def native_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "state_vector").where("is_roi").select("i", "j", "lon", "lat")
    return statevector.native_labels(cells).select("i", "j", "element")


def cell_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    counts = preview.daily_counts(soundings_in(spark, d)).groupBy((F.col("bi") + 346).alias("i"), (F.col("bj") - 112).alias("j")).agg(F.sum("obs_count").alias("n"))
    return table(spark, d, "state_vector").select("i", "j", "lon", "lat", "element", "is_roi").join(counts, ["i", "j"], "left").withColumn("a", F.coalesce(F.col("n") / (F.col("n") + 25), F.lit(0.0))).drop("n")


@query
def strongest_labels(spark: SparkSession, d: str) -> DataFrame:
    s = cell_sensitivity(spark, d)
    totals = statevector.label_totals(labelled(spark, d).select("element", "i", "j"), s.select("i", "j", "a"))
    return statevector.strongest_labels(totals.withColumn("total", _r("total", 8)), 40).select("element", "cells", _r("total").alias("total"))


@query
def forced_native(spark: SparkSession, d: str) -> DataFrame:
    s = cell_sensitivity(spark, d).select("i", "j", "a")
    p = table(spark, d, "point_sources").select(GRID.i_of(finite(F.col("lon")), 0.5).alias("i"), GRID.j_of(finite(F.col("lat")), 0.5).alias("j"))
    return statevector.forced_native(s, p.where(F.col("i").isNotNull() & F.col("j").isNotNull())).select("i", "j", _r("a").alias("a"))


@query
def reduced_state_vector(spark: SparkSession, d: str) -> DataFrame:
    cells = cell_sensitivity(spark, d).where("is_roi").select("i", "j", "lon", "lat", "a")
    return statevector.reduce_by_information(cells, "a", 0.15, statevector.MAX_CLUSTER[0.25]).select("i", "j", "label")


# --- model runs and streams --------------------------------------------------------------------


@query
def element_runs(spark: SparkSession, d: str) -> DataFrame:
    """Kind and perturbation run of every element when boundaries and OH are optimised too."""
    e = labelled(spark, d).select("element").distinct()
    n = 467
    kind = model.element_kind(F.col("element"), n, True, True, True)
    north = model.boundary_perturbation(F.col("element"), n, 10.0, True, True)
    return e.select("element", kind.alias("kind"), model.run_number(F.col("element"), n, 5, True, True, True).alias("run"), north[0].alias("north"), north[3].alias("west"))


@query
def first_hour(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals of a run whose first hour comes from the run before, per hour of day."""
    rows = table(spark, d, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), F.col("user_id").alias("cell"), "value").groupBy("hour", "cell").agg(F.sum("value").alias("v"))
    start = 19725 * 24  # 2024-01-03
    run, before = rows.where(F.col("hour") > start), rows.where(F.col("hour") <= start)
    return model.with_first_hour(run, before, ["cell"]).groupBy(F.pmod(F.col("hour"), F.lit(24)).alias("h")).agg(F.count("*").alias("n"), _r(F.sum("v"), 3).alias("v"))


@query
def tracer_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Change per unit of an element's tracer against the base run, value by value."""
    rows, _ = whole_jacobian(spark, d)
    base, moved = F.col("k"), F.transform("k", lambda x: x * 1.5 + 0.25)
    kind = model.element_kind((F.col("vec_id") % 12 + 1), 12, True, True, True)
    x = model.sensitivity(moved, base, kind, F.lit(0.5), 0.1, 10.0)
    return rows.select("vec_id", kind.alias("kind"), F.posexplode(x).alias("at", "v")).select("vec_id", "kind", "at", _r("v").alias("v"))


@query
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per 7-day window and type, read as a stream and drained through a checkpointed query."""
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parque[t]")  # as a pattern: one file or a folder
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    weeks = incremental.windowed_means(stream, "ts", "event_type", "value")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    incremental.drain_updates(weeks, write, f"{base}/state")
    # of a window updated in several batches the last state holds
    out = spark.read.parquet(f"{base}/out").groupBy("start", "key").agg(F.max_by(F.struct("n", "total"), "epoch").alias("s"))
    return out.select("start", F.col("key").alias("event_type"), "s.n", _r("s.total", 3).alias("total"))


# --- model state by hour, element axis, pairs -------------------------------------------------------


@query
def model_at_hours(spark: SparkSession, d: str) -> DataFrame:
    """Super-observations with the surface value of the model at their hour and cell; the model lacks some hours."""
    s = soundings.superobservations(soundings.center_weights(soundings_in(spark, d))).select("file_id", "i", "j", "hour", "xch4")
    state = s.select("hour", "i", "j").distinct().where(F.col("hour") % 17 != 0).withColumn("ppb", F.lit(1900.0) + F.col("i") % 5 + (F.col("hour") % 24) * 0.25)
    return model.at_hours(s, state).select("file_id", "i", "j", "hour", _r("xch4", 4).alias("xch4"), _r("ppb").alias("ppb"))


@query
def element_sensitivities(spark: SparkSession, d: str) -> DataFrame:
    """Change of the lowest satellite layer per unit of six elements (the last is OH, the four before it boundaries)."""
    cells = cut(model_cells(spark, d).withColumn("hour", F.lit(0)))
    element = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("element")
    moved = lambda c, e: F.transform(c, lambda x: x * (1 + 0.01 * e))
    tracers = cells.select("hour", "i", "j", "conc", element).select("hour", "i", "j", "element", moved(F.col("conc"), F.col("element")).alias("ch4"))
    bases = cells.select("hour", "i", "j", F.lit("0001").alias("run_id"), F.col("conc").alias("ch4")).unionByName(cells.select("hour", "i", "j", F.lit("0000").alias("run_id"), moved(F.col("conc"), F.lit(0.5)).alias("ch4")))
    kind = model.element_kind(F.col("element"), 6, True, True, True)
    axis = model.element_axis(tracers, bases, kind, F.lit(0.5), 0.1, 10.0).join(cells.select("i", "j", "pedge"), ["i", "j"])
    rows = soundings.center_weights(soundings_in(spark, d, "psurf", "dp")).join(axis, ["i", "j"])
    edges = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.greatest(F.col("psurf") - k * F.col("dp"), F.lit(0.0)))
    out = rows.select("file_id", "scanline", "pixel", "element", soundings.remapped(edges, F.col("pedge"), F.col("dch4")).alias("x"))
    return out.where(F.col("x").isNotNull()).select("file_id", "scanline", "pixel", "element", _r(F.col("x")[0] * 1e9, 4).alias("bottom"))


@query
def prior_posterior_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prior and posterior super-observations of the files that have both, averaged per file."""
    s = soundings.superobservations(soundings.center_weights(soundings_in(spark, d))).select("file_id", "i", "j", F.col("xch4").alias("value"))
    post = s.where(F.col("file_id").contains("OFFL")).withColumn("value", F.col("value") * 0.99 + F.col("i") * 0.5)
    out = report.paired(s, post, ["file_id", "i", "j"])
    return out.groupBy("file_id").agg(F.count("*").alias("n"), _r(F.avg("prior"), 4).alias("prior"), _r(F.avg("posterior"), 4).alias("posterior"))


@query
def total_without_sink(spark: SparkSession, d: str) -> DataFrame:
    out = emissions.without_sink(emissions.sector_mean(daily_emissions(spark, d)))
    return out.select("i", "j", _r("total").alias("total"), _r("total_without_sink").alias("total_without_sink"))


@query
def site_years(spark: SparkSession, d: str) -> DataFrame:
    out = report.site_years(readings(spark, d))
    return out.select("site", "year", "n", _r("mean", 4).alias("mean"), _r("first", 4).alias("first"))


@query
def grid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the grid's columns and rows."""
    sv = table(spark, d, "state_vector")
    return grid.axis_edges(sv, "lon").withColumn("axis", F.lit("lon")).unionByName(grid.axis_edges(sv, "lat").withColumn("axis", F.lit("lat")))


@query
def buffer_cells(spark: SparkSession, d: str) -> DataFrame:
    """Labelled cells within three cells of the inner part of the region, without that part."""
    cells = table(spark, d, "state_vector").where("element is not null")
    return statevector.buffer_cells(cells, cells.where("i between 8 and 17 and j between 10 and 21")).select("i", "j")


@query
def native_state_vector(spark: SparkSession, d: str) -> DataFrame:
    sv = table(spark, d, "state_vector").select("i", "j", "lon", "lat", F.col("element").isNotNull().alias("land"))
    return statevector.native_state_vector(sv, F.col("i").between(8, 17) & F.col("j").between(10, 21), F.col("land"), 8)


@query
def cell_regions(spark: SparkSession, d: str) -> DataFrame:
    """The polygon that each cell of the grid shares most area with, else the nearest within 100 km."""
    regions = table(spark, d, "roi_polygons").select(F.col("roi_id").alias("place_id"), "wkt")
    return statevector.cell_regions(table(spark, d, "state_vector").select("i", "j", "lon", "lat"), regions, GRID.dlon, GRID.dlat, 100_000.0)


#: Operators that settings may name, by what they make of the soundings.
DISPATCH: dict[str, Query] = {"centers": superobs_center, "overlaps": superobs_overlap, "pixels": pixel_model}


def observe(name: str, spark: SparkSession, d: str) -> DataFrame:
    """The observation operator ``name``; ValueError for a name that is not registered."""
    if name not in DISPATCH:
        raise ValueError(f"no such operator: {name!r}; known are {sorted(DISPATCH)}")
    return DISPATCH[name](spark, d)
