"""Information content expected of an inversion before it is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.grid import GRID, Grid, dilate
from fluxloom.operators.soundings import superobs_error

# Wind (m/s), surface pressure (Pa), gravity, molar masses (kg/mol), turbulence parameter.
WIND, PRESSURE, GRAVITY, M_AIR, M_CH4, ALPHA = 5 * 1000 / 3600, 101325.0, 9.8, 0.029, 0.01604, 0.4


def daily_counts(soundings: DataFrame, grid: Grid = GRID) -> DataFrame:
    """bi, bj, day, obs_count: soundings per grid bin (floor of the coordinate over the step) and UTC day number."""
    bins = soundings.select(
        F.floor(F.col("lon") / grid.dlon).cast("int").alias("bi"), F.floor(F.col("lat") / grid.dlat).cast("int").alias("bj"), F.floor(F.unix_seconds("obs_time") / 86400).alias("day")
    )
    return bins.groupBy("bi", "bj", "day").agg(F.count("*").alias("obs_count"))


def element_counts(counts: DataFrame, elements: DataFrame, grid: Grid = GRID) -> DataFrame:
    """element, num_obs, num_days over the cells of each element grown by two rings; overlaps count for each element.

    Bins are keyed like the cells whose lower corner they start at (half a cell off the centre).
    """
    i = (F.col("bi") - round(grid.lon0 / grid.dlon)).cast("int")
    j = (F.col("bj") - round(grid.lat0 / grid.dlat)).cast("int")
    cells = counts.groupBy(i.alias("i"), j.alias("j")).agg(F.sum("obs_count").alias("obs"), F.count("*").alias("days"))
    grown = dilate(elements.select("element", "i", "j"), grid)
    return grown.join(cells, ["i", "j"]).groupBy("element").agg(F.sum("obs").alias("num_obs"), F.sum("days").alias("num_days"))


def sensitivity(emission_tg: Column, length_m: Column, num_obs: Column, num_days: Column, prior_error: float, sigma_ppb: float) -> Column:
    """Averaging-kernel sensitivity of an element; 0 where no day had a sounding."""
    rate = emission_tg * 1e9 / (3600 * 24 * 365) / (length_m * length_m)
    s_a = rate * prior_error
    k = length_m * (ALPHA * M_AIR * GRAVITY / (M_CH4 * WIND * PRESSURE))
    per_day = num_obs / num_days
    s_o = superobs_error(sigma_ppb, F.greatest(per_day, F.lit(1.0))) * 1e-9
    a = s_a * s_a / (s_a * s_a + (s_o / k) * (s_o / k) / num_days)
    return F.when(num_days > 0, a).otherwise(0.0)


def expected_dofs(soundings: DataFrame, elements: DataFrame, emissions: DataFrame, native_m: float = 25_000.0, prior_error: float = 0.5, sigma_ppb: float = 15.0, grid: Grid = GRID) -> DataFrame:
    """element, emission, cells, num_obs, num_days, sensitivity of every element of the region.

    ``elements`` has element, i, j (region only), ``emissions`` i, j, tg. Two aggregations on the few thousand cells
    of the grid follow one on the soundings; nothing is looped per element.
    """
    counts = element_counts(daily_counts(soundings, grid), elements, grid)
    size = elements.join(emissions, ["i", "j"], "left").groupBy("element").agg(F.coalesce(F.sum("tg"), F.lit(0.0)).alias("emission"), F.count("*").alias("cells"))
    out = size.join(counts, "element", "left").na.fill(0, ["num_obs", "num_days"])
    a = sensitivity(F.col("emission"), F.col("cells") * native_m, F.col("num_obs"), F.col("num_days"), prior_error, sigma_ppb)
    return out.withColumn("sensitivity", F.coalesce(a, F.lit(0.0)))
