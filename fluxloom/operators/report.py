"""Validation reports: background sites, bias statistics, moving averages, coarse maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.timestamps import offset_minutes


def local_hour(time: Column, utc_conv: Column) -> Column:
    """Hour of day of the local standard time; the offset may be in any notation, none counts as UTC."""
    seconds = F.unix_seconds(time) + 60 * F.coalesce(offset_minutes(utc_conv), F.lit(0))
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def background(obs: DataFrame, least: float = 500.0) -> DataFrame:
    """Readings fit to represent the background: ``obs`` has dataset, site, time, utc_conv, obs_flag, ppb, ch4_ppb.

    In-situ readings of local hours 10 to 16 and all flasks, flagged representative, physical, and within three sample
    standard deviations of their dataset's mean. The deviation is taken per dataset by an aggregate and a join, which
    combines map-side where one dataset holds a third of the rows (a window would gather it in one task).
    """
    hour = local_hour(F.col("time"), F.col("utc_conv"))
    kind = (F.col("dataset").contains("insitu") & hour.between(10, 16)) | F.col("dataset").contains("flask")
    rows = obs.where((F.col("ppb") > least) & (F.col("ch4_ppb") > least) & (F.col("obs_flag") == 1) & kind)
    stats = rows.groupBy("dataset").agg(F.avg("ppb").alias("mean"), (3 * F.stddev_samp("ppb")).alias("sd3"))
    kept = rows.join(stats, "dataset")
    return kept.where(F.abs(F.col("ppb") - F.col("mean")) <= F.col("sd3")).drop("mean", "sd3")


def error_statistics(pairs: DataFrame, truth: Column, model: Column, weight: Column, by: list[str]) -> DataFrame:
    """n, bias, rmse (weighted) and population standard deviation of model minus truth, per ``by``."""
    d = model - truth
    return pairs.groupBy(*by).agg(
        F.count(d).alias("n"), (F.sum(weight * d) / F.sum(weight)).alias("bias"), F.sqrt(F.sum(weight * d * d) / F.sum(weight)).alias("rmse"), F.stddev_pop(d).alias("sd")
    )


def centred_rows_mean(value: Column, key: list[str], order: str, rows: int = 4) -> Column:
    """Centred mean over an even number of rows, from ``rows``/2 before to one less after."""
    half = rows // 2
    return F.avg(value).over(W.partitionBy(*key).orderBy(order).rowsBetween(-half, half - 1))


def centred_days_mean(value: Column, key: list[str], seconds: str, days: int = 30) -> Column:
    """Mean over the ``days`` centred on each row: later than half before, up to half after."""
    half = days * 43200
    return F.avg(value).over(W.partitionBy(*key).orderBy(seconds).rangeBetween(-half + 1, half))


def tenth_degree(soundings: DataFrame, value: str) -> DataFrame:
    """lon10, lat10 (tenths of a degree, half to even), n, mean of ``value``."""
    at = soundings.select(F.bround(F.col("lon") * 10, 0).cast("int").alias("lon10"), F.bround(F.col("lat") * 10, 0).cast("int").alias("lat10"), value)
    return at.groupBy("lon10", "lat10").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def dense_map(spark, tenths: DataFrame, lon: tuple[int, int], lat: tuple[int, int]) -> DataFrame:
    """Every tenth-degree cell of a box (tenths, inclusive) with its mean, NULL where there is none."""
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(lon[0]), F.lit(lon[1]))).alias("lon10")).select("lon10", F.explode(F.sequence(F.lit(lat[0]), F.lit(lat[1]))).alias("lat10"))
    return cells.join(tenths, ["lon10", "lat10"], "left")


def conservative_regrid(tenths: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """Coarse cells (I, J) with the mean of 0.1 degree cells weighted by the area they share with them.

    A fine cell is listed in every coarse cell it touches (at most four); weights of cells without a value do not count.
    """
    x0, x1, y0, y1 = F.col("lon10") / 10 - 0.05, F.col("lon10") / 10 + 0.05, F.col("lat10") / 10 - 0.05, F.col("lat10") / 10 + 0.05
    span = lambda a, b, d: F.sequence(F.floor(a / d + 1e-9), F.ceil(b / d - 1e-9) - 1)
    rows = tenths.where(F.col("mean").isNotNull()).withColumn("I", F.explode(span(x0, x1, dlon))).withColumn("J", F.explode(span(y0, y1, dlat)))
    share = lambda a, b, k, d: F.least(b, (k + 1) * d) - F.greatest(a, k * d)
    w = share(x0, x1, F.col("I"), dlon) * share(y0, y1, F.col("J"), dlat)
    return rows.withColumn("w", w).where(F.col("w") > 1e-12).groupBy("I", "J").agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("mean"), F.count("*").alias("n"))


def paired(prior: DataFrame, posterior: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``prior`` and ``posterior`` (keys, value) with equal keys: keys, prior, posterior; unpaired rows fall out."""
    return prior.select(*keys, F.col("value").alias("prior")).join(posterior.select(*keys, F.col("value").alias("posterior")), keys)


def site_years(readings: DataFrame) -> DataFrame:
    """site, year, n, mean and first value (by time, then row_id) of ``readings`` (site, time, row_id, ppb)."""
    first = F.min_by("ppb", F.struct("time", "row_id"))
    return readings.where(F.col("ppb").isNotNull()).groupBy("site", F.year("time").alias("year")).agg(F.count("*").alias("n"), F.avg("ppb").alias("mean"), first.alias("first"))
