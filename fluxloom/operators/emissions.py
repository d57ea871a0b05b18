"""Emission algebra on long tables (d, i, j, sector, flux, area)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kg per second to Tg per year of 365 days.
TG_PER_YEAR = 86400 * 365 * 1e-9


def sector_mean(emissions: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Mean flux per cell and sector over days ``first`` <= d < ``last``; NULL fluxes are skipped."""
    rows = emissions
    if first:
        rows = rows.where(F.col("d") >= F.to_date(F.lit(first)))
    if last:
        rows = rows.where(F.col("d") < F.to_date(F.lit(last)))
    return rows.groupBy("i", "j", "sector").agg(F.avg("flux").alias("flux"), F.avg("area").alias("area"))


def total_tg(flux: Column, area: Column) -> Column:
    """Aggregate: total in Tg per year."""
    return F.sum(flux * area) * TG_PER_YEAR


def total_emissions(mean: DataFrame, mask: DataFrame) -> DataFrame:
    """One row with the total of all sectors over the cells (i, j) of ``mask``."""
    return mean.join(mask, ["i", "j"], "left_semi").agg(total_tg(F.col("flux"), F.col("area")).alias("total"))


def sector_totals(mean: DataFrame, mask: DataFrame) -> DataFrame:
    """sector, total over the cells of ``mask``: positive sectors only, in ascending order of total."""
    out = mean.join(mask, ["i", "j"], "left_semi").groupBy("sector").agg(total_tg(F.col("flux"), F.col("area")).alias("total"))
    return out.where(F.col("total") > 0).orderBy("total", "sector")


def posterior_emissions(mean: DataFrame, scale: DataFrame, sink: str = "Soil") -> DataFrame:
    """Scaled fluxes per cell and sector: the soil sink is kept as it was, and totals scale without it.

    ``scale`` has i, j, sf; cells without a scale factor keep their emissions.
    """
    sf = F.when(F.col("sector") == sink, 1.0).otherwise(F.coalesce(F.col("sf"), F.lit(1.0)))
    return mean.join(scale, ["i", "j"], "left").select("i", "j", "sector", "area", F.col("flux").alias("prior"), (F.col("flux") * sf).alias("posterior"))


def perturbation_factors(total: DataFrame, elements: DataFrame, target: float, ceiling: float = 1.5e7, prior: DataFrame | None = None) -> DataFrame:
    """element, jacobian_sf, effective_sf: median over an element's cells of target / flux, clipped, 1 where undefined.

    ``total`` has i, j, flux; ``elements`` i, j, element; ``prior`` optional element, prior_sf of a running filter.
    """
    ratio = F.when(F.col("flux") != 0, F.lit(target) / F.col("flux"))
    median = elements.where("element is not null").join(total, ["i", "j"], "left").groupBy("element").agg(F.median(ratio).alias("m"))
    out = median.select("element", F.coalesce(F.least(F.col("m"), F.lit(ceiling)), F.lit(1.0)).alias("jacobian_sf"))
    if prior is not None:
        out = out.join(prior, "element", "left")
    else:
        out = out.withColumn("prior_sf", F.lit(1.0))
    return out.select("element", "jacobian_sf", (F.col("jacobian_sf") / F.coalesce(F.col("prior_sf"), F.lit(1.0)) - 1).alias("effective_sf"))


def without_sink(mean: DataFrame, sink: str = "Soil") -> DataFrame:
    """i, j, total, total_without_sink: fluxes of all sectors, and of all but the soil sink, per cell."""
    return mean.groupBy("i", "j").agg(F.sum("flux").alias("total"), F.coalesce(F.sum(F.when(F.col("sector") != sink, F.col("flux"))), F.lit(0.0)).alias("total_without_sink"))


def posterior_totals(daily: DataFrame, scale: DataFrame, mask: DataFrame, sink: str = "Soil") -> DataFrame:
    """period_number, prior, posterior: totals (Tg per year) over ``mask`` of each period's mean emissions, scaled.

    ``daily`` has period_number, i, j, sector, flux, area; ``scale`` period_number, i, j, sf (missing factors are 1).
    """
    mean = daily.groupBy("period_number", "i", "j", "sector").agg(F.avg("flux").alias("flux"), F.avg("area").alias("area"))
    rows = mean.join(mask.select("i", "j").distinct(), ["i", "j"], "left_semi").join(scale, ["period_number", "i", "j"], "left")
    sf = F.when(F.col("sector") == sink, 1.0).otherwise(F.coalesce(F.col("sf"), F.lit(1.0)))
    return rows.groupBy("period_number").agg(total_tg(F.col("flux"), F.col("area")).alias("prior"), total_tg(F.col("flux") * sf, F.col("area")).alias("posterior"))
