"""Smooth bias fields between model and satellite for boundary conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.grid import GRID, Grid, ring_offsets


def daily_bias(pairs: DataFrame) -> DataFrame:
    """day, i, j, bias: mean model minus mean satellite per day and cell; ``pairs`` has day, i, j, model, satellite."""
    return pairs.groupBy("day", "i", "j").agg((F.avg("model") - F.avg("satellite")).alias("bias"))


def smooth_in_space(daily: DataFrame, rings: int = 2, least: int = 13, grid: Grid = GRID) -> DataFrame:
    """Mean over the square around each cell, where at least ``least`` of its cells have a value.

    The values are spread to their neighbours and averaged there: one explode and one combined aggregation, no window
    over a dense grid. Cells without a value of their own get one too; the square is cut at the grid's edge.
    """
    spread = daily.select("day", "i", "j", "bias", F.explode(ring_offsets(rings)).alias("o")).where(F.col("bias").isNotNull())
    at = spread.select("day", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "bias")
    at = at.where(F.col("i").between(0, grid.ni - 1) & F.col("j").between(0, grid.nj - 1))
    return at.groupBy("day", "i", "j").agg(F.count("bias").alias("n"), F.avg("bias").alias("bias")).where(F.col("n") >= least).drop("n")


def on_dense_days(values: DataFrame, cells: DataFrame) -> DataFrame:
    """``values`` on every cell of ``cells`` and every day from their first to their last (NULL where there is none).

    Only the two days reach the driver. Without values there are no days.
    """
    span = values.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    days = F.sequence(F.lit(span["a"]), F.lit(span["b"])) if span["a"] is not None else F.array().cast("array<bigint>")
    dense = cells.select("i", "j", F.explode(days).alias("day"))
    return dense.join(values, ["day", "i", "j"], "left")


def trailing_means(dense: DataFrame, short: int = 15, long: int = 30) -> DataFrame:
    """Trailing mean of the last ``short`` days, else of the last ``long`` days; one window per cell."""
    order = W.partitionBy("i", "j").orderBy("day")
    mean = lambda n: F.avg("bias").over(order.rowsBetween(-(n - 1), 0))
    return dense.select("day", "i", "j", F.coalesce(mean(short), mean(long)).alias("bias"))


def band_means(smooth: DataFrame, least: int = 15) -> DataFrame:
    """day, j, band: mean of a latitude row with at least ``least`` values, gaps in latitude filled.

    Inner gaps are interpolated linearly, the ends take the nearest band. Rows of every day and j are expected.
    """
    rows = smooth.groupBy("day", "j").agg(F.when(F.count("bias") >= least, F.avg("bias")).alias("v"))
    up = W.partitionBy("day").orderBy("j")
    below, above = up.rowsBetween(W.unboundedPreceding, 0), up.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("j", "v"))
    lo, hi = F.last(known, ignorenulls=True).over(below), F.first(known, ignorenulls=True).over(above)
    ends = rows.withColumn("lo", lo).withColumn("hi", hi)
    inner = F.col("lo.v") + (F.col("j") - F.col("lo.j")) / (F.col("hi.j") - F.col("lo.j")) * (F.col("hi.v") - F.col("lo.v"))
    return ends.select("day", "j", F.coalesce(F.col("v"), inner, F.col("hi.v"), F.col("lo.v")).alias("band"))


def filled_bias(smooth: DataFrame, least: int = 15) -> DataFrame:
    """``smooth`` with NULLs replaced by the band mean, and by 0 where a day has no band at all."""
    return smooth.join(band_means(smooth, least), ["day", "j"], "left").select("day", "i", "j", F.coalesce("bias", "band", F.lit(0.0)).alias("bias"))


def corrected(boundary: DataFrame, bias: DataFrame) -> DataFrame:
    """Boundary concentrations (day, lev, i, j, ppb) minus the bias of their day and cell, on every level."""
    return boundary.join(bias, ["day", "i", "j"], "left").withColumn("ppb", F.col("ppb") - F.coalesce("bias", F.lit(0.0))).drop("bias")
