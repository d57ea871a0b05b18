"""Sequential inversions over periods: a fold of state tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.session import cut


def periods(spark: SparkSession, first: date, last: date, step_days: int) -> DataFrame:
    """period_number, start, stop of whole periods from ``first`` up to ``last``; a trailing part is dropped.

    Raises ValueError when not even one period fits.
    """
    n = (last - first).days // step_days
    if n < 1:
        raise ValueError("the update interval is longer than the inversion")
    k = spark.range(n).select(F.col("id").cast("int").alias("k"))
    day = lambda c: F.date_add(F.lit(first), c)
    return k.select((F.col("k") + 1).alias("period_number"), day(F.col("k") * step_days).alias("start"), day((F.col("k") + 1) * step_days).alias("stop"))


def in_periods(rows: DataFrame, table: DataFrame, day: str = "d") -> DataFrame:
    """``rows`` with the period their day lies in (start inclusive, stop exclusive); others are left out."""
    spans = table.select("period_number", F.explode(F.sequence("start", F.date_sub("stop", 1))).alias(day))
    return rows.join(spans, day)


def nudge(state: DataFrame, posterior: DataFrame, emissions: DataFrame, mask: DataFrame, factor: float = 0.1) -> DataFrame:
    """Next scale factors (i, j, sf): the posterior applied to ``state``, nudged towards the prior.

    Negative posterior emissions are set to 0 before nudging, the region's total is conserved, cells outside the region
    go back to 1, and so do cells without emissions. ``state`` i, j, sf; ``posterior`` i, j, post; ``emissions`` i, j, flux, area; ``mask`` region cells.
    """
    rows = state.join(emissions, ["i", "j"], "left").join(posterior, ["i", "j"], "left").join(mask.select("i", "j", F.lit(True).alias("roi")), ["i", "j"], "left")
    current = F.col("flux") * F.col("sf") * F.coalesce("post", F.lit(1.0))
    rows = rows.withColumn("now", current).withColumn("nudged", factor * F.col("flux") + (1 - factor) * F.greatest(F.col("now"), F.lit(0.0)))
    total = lambda c: F.sum(F.col(c) * F.col("area"))
    share = rows.where("roi").agg((total("now") / total("nudged")).alias("share")).first()["share"]
    sf = F.when(F.col("roi") & (F.col("flux") != 0), F.col("nudged") * F.lit(share) / F.col("flux"))
    return rows.select("i", "j", F.coalesce(sf, F.lit(1.0)).alias("sf"))


def fold(
    cells: DataFrame, by_period: list[tuple[DataFrame, DataFrame]], mask: DataFrame, factor: float = 0.1, first: int = 1, archive: str | None = None
) -> DataFrame:
    """State after all periods: unit scale factors, then one nudge per (posterior, emissions) of a period.

    With an ``archive`` folder the state after each period is stored there as ``period=n``; a run that starts at
    ``first`` > 1 takes up the archived state of the period before (ValueError without an archive). ``by_period`` holds
    the periods from ``first`` on.
    """
    if first > 1 and archive is None:
        raise ValueError("a restart needs the archived states")
    spark = cells.sparkSession
    state = cells.select("i", "j", F.lit(1.0).alias("sf")) if first == 1 else spark.read.parquet(f"{archive}/period={first - 1}")
    for period, (posterior, emissions) in enumerate(by_period, first):
        state = nudge(state, posterior, emissions, mask, factor)
        if archive is None:
            state = cut(state)
        else:
            state.write.mode("overwrite").parquet(f"{archive}/period={period}")
            state = spark.read.parquet(f"{archive}/period={period}")
    return state


def reclustered(by_period: list[DataFrame], cluster: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """period, i, j, label: the state vector of every period, clustered anew by ``cluster`` on that period's cells."""
    out = None
    for period, cells in enumerate(by_period, 1):
        one = cluster(cells).select(F.lit(period).alias("period"), "i", "j", "label")
        out = one if out is None else out.unionByName(one)
    return out


def retained(states: DataFrame, first: date, last: date, day: str = "d") -> DataFrame:
    """States worth keeping once a period is done: all but those strictly between its first and last day."""
    return states.where(~((F.col(day) > F.lit(first)) & (F.col(day) < F.lit(last))))
