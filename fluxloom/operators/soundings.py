"""Satellite soundings: choice of files, screening, super-observations, vertical remapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.operators.grid import GRID, Grid, overlap_cells
from fluxloom.sources.tables import finite

# Fixed value: the parts of an operational file name.
NAME = r"S5P_(\w{4})_L2__CH4____(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{5})_(\d{2})_(\d{6})_(\d{8}T\d{6})"


def file_parts(name: Column) -> list[Column]:
    """mode, start, stop, orbit, collection, version, modified of a file name."""
    labels = ("mode", "start", "stop", "orbit", "collection", "version", "modified")
    return [F.nullif(F.regexp_extract(name, NAME, k), F.lit("")).alias(n) for k, n in enumerate(labels, 1)]


def chosen_files(obs: DataFrame, collection: str = "03") -> DataFrame:
    """One file per orbit: reprocessed before near-real-time, then the latest modification, then the greatest name.

    Columns: orbit, file_id, mode, version, n_files. Names of another form and other collections are left out.
    """
    files = obs.select("file_id").distinct().select("file_id", *file_parts(F.col("file_id"))).where(F.col("collection") == collection)
    rank = F.struct(F.when(F.col("mode") == "RPRO", 1).otherwise(0), "modified", "file_id")
    best = F.max_by(F.struct("file_id", "mode", "version"), rank).alias("b")
    return files.groupBy("orbit").agg(best, F.count("*").alias("n_files")).select("orbit", "b.file_id", "b.mode", "b.version", "n_files")


def screened(obs: DataFrame, columns: list[str], lon: tuple[float, float], lat: tuple[float, float], qa: float = 0.5, water: bool = False) -> DataFrame:
    """Soundings fit for use, each pixel once: file_id, scanline, pixel, obs_time, lon, lat, xch4 and ``columns``.

    Of repeated pixels the first in the order of their values stays; of an orbit in several files the chosen file.
    Box bounds are exclusive, quality is inclusive, a missing surface class passes as land, fill values are no value.
    """
    # only what is asked for travels through the shuffle
    extra = [c for c in columns if c not in ("obs_time", "lon", "lat", "xch4", "qa", "surface_class")]
    ok = (
        (F.col("lon") > lon[0]) & (F.col("lon") < lon[1]) & (F.col("lat") > lat[0]) & (F.col("lat") < lat[1]) & (F.col("lat") > -60)
        & (F.col("qa") >= qa) & (F.array_max("lon_b") - F.array_min("lon_b") < 100) & finite(F.col("xch4")).isNotNull()
    )
    if not water:
        ok = ok & (F.coalesce(F.col("surface_class").bitwiseAND(3), F.lit(5)) != 1)
    rows = obs.where(ok).join(chosen_files(obs).select("file_id"), "file_id", "left_semi")
    value = F.min(F.struct("obs_time", "lon", "lat", "xch4", "qa", *extra)).alias("v")
    return rows.groupBy("file_id", "scanline", "pixel").agg(value).select("file_id", "scanline", "pixel", "v.*")


def blended(obs: DataFrame, chi2: Column, lon: tuple[float, float], lat: tuple[float, float], water: bool = False, worst: float = 20_000.0) -> DataFrame:
    """Screening of blended soundings, which carry no quality value: class 3 is out, class 2 where ``chi2`` is above ``worst``.

    A missing class or chi2 passes.
    """
    surface = F.coalesce(F.col("surface_class").bitwiseAND(3), F.lit(5))
    bad = (surface == 3) | ((surface == 2) & F.coalesce(chi2 > worst, F.lit(False)))
    if not water:
        bad = bad | (surface == 1)
    inside = (F.col("lon") > lon[0]) & (F.col("lon") < lon[1]) & (F.col("lat") > lat[0]) & (F.col("lat") < lat[1]) & (F.col("lat") > -60)
    return obs.where(inside & (F.array_max("lon_b") - F.array_min("lon_b") < 100) & finite(F.col("xch4")).isNotNull() & ~bad)


def pixel_values(weighted: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """file_id, scanline, pixel and the mean of a cell value over the cells each pixel covers, weighted by area.

    Pixels that cover no cell with a value are left out.
    """
    rows = weighted.join(cells.select("i", "j", F.col(value).alias("_value")), ["i", "j"]).where(F.col("_value").isNotNull())
    mean = F.sum(F.col("weight") * F.col("_value")) / F.sum("weight")
    return rows.groupBy("file_id", "scanline", "pixel").agg(mean.alias(value), F.count("*").alias("n_cells"))


def derived(obs: DataFrame) -> DataFrame:
    """Blended albedo, surface class (low two bits, 5 when missing) and the 13 pressure edges (hPa) of each sounding."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.col("psurf") - k * F.col("dp"))
    return obs.select(
        "file_id", "scanline", "pixel", (2.4 * F.col("nir") - 1.13 * F.col("swir")).alias("blended_albedo"),
        F.coalesce(F.col("surface_class").bitwiseAND(3), F.lit(5)).alias("surface"), edges.alias("edges"),
    )


def rounded_hour(seconds: Column, last_day: Column | None = None) -> Column:
    """Hour number since 1970 nearest to a time (ties to the even hour); one that would be hour 0 of ``last_day`` is floored."""
    hour = F.bround(seconds / 3600.0, 0).cast("bigint")
    return hour if last_day is None else F.when(hour == last_day * 24, F.floor(seconds / 3600.0)).otherwise(hour)


def superobservations(weighted: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Weighted means per file and cell: file_id, i, j, count, xch4, lon, lat, hour and the means of ``extra`` scalars.

    ``weighted`` has weight per pixel and cell. Everything is weighted but the time, whose plain mean is cut to seconds
    and rounded to an hour. One partially combined aggregation.
    """
    w = F.col("weight")
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    time = F.floor(F.avg(F.unix_seconds("obs_time"))).cast("bigint")
    agg = weighted.groupBy("file_id", "i", "j").agg(F.sum(w).alias("count"), mean("xch4"), mean("lon"), mean("lat"), time.alias("seconds"), *[mean(c) for c in extra or []])
    return agg.where(F.col("count") > 0).withColumn("hour", rounded_hour(F.col("seconds"))).drop("seconds")


def center_weights(pixels: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Each pixel with weight 1 in the cell nearest to its centre, left out beyond the tolerance."""
    cells = pixels.withColumn("i", grid.i_of(F.col("lon"), grid.lon_tolerance)).withColumn("j", grid.j_of(F.col("lat"), grid.lat_tolerance))
    return cells.where(F.col("i").isNotNull() & F.col("j").isNotNull()).withColumn("weight", F.lit(1.0))


def overlap_weights(pixels: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Each pixel in every cell it covers, weighted by the share of its covered area."""
    keys = ["file_id", "scanline", "pixel"]
    return pixels.drop("lon_b", "lat_b").join(overlap_cells(pixels, keys, grid), keys)


def profile_means(weighted: DataFrame, names: list[str], layers: int = 12) -> DataFrame:
    """Weighted means of array columns per file and cell, element by element, as one codegen'd aggregation."""
    w = F.col("weight")
    sums = [F.sum(w * F.col(n)[k]).alias(f"{n}_{k}") for n in names for k in range(layers)]
    agg = weighted.groupBy("file_id", "i", "j").agg(F.sum(w).alias("total"), *sums)
    return agg.select("file_id", "i", "j", *[F.array(*[F.col(f"{n}_{k}") / F.col("total") for k in range(layers)]).alias(n) for n in names])


def superobs_variance(sigma: float, p: Column, r: float = 0.55, transport: float = 4.5) -> Column:
    """Variance of a super-observation of ``p`` pixels (fewer than one count as one), relative to a single pixel's."""
    n = F.greatest(p, F.lit(1.0))
    error2 = F.lit(sigma**2) * ((1 - r) / n + r) + transport**2
    one = sigma**2 + transport**2
    value = F.lit(sigma**2) * error2 / F.lit(one)
    return F.when(value > 0, value).otherwise(1.0)


def superobs_error(sigma: float, p: Column, r: float = 0.55, transport: float = 4.5) -> Column:
    """Standard deviation of a super-observation of ``p`` pixels with error correlation ``r`` and transport error."""
    return F.sqrt(F.lit(sigma**2) * (F.lit(1 - r) / p + r) + transport**2)


def remap_layers(sat: np.ndarray, model: np.ndarray, conc: np.ndarray) -> np.ndarray:
    """Pressure-weighted means (n, layers) of model layers on satellite layers, edges falling with height.

    The lowest model layer reaches down to the satellite surface when that lies below it; NaN where the satellite top
    is above the model top. Vectorised over rows by integrating the model profile and interpolating the integral.
    """
    model = model.copy()
    model[:, 0] = np.maximum(model[:, 0], sat[:, 0])
    depth = model[:, :-1] - model[:, 1:]
    total = np.concatenate([np.zeros((len(model), 1)), np.cumsum(depth * conc, 1)], 1)
    at = np.empty_like(sat)
    for k in range(sat.shape[1]):
        x = sat[:, k][:, None]
        layer = np.clip((model > x).sum(1) - 1, 0, conc.shape[1] - 1)
        rows = np.arange(len(sat))
        at[:, k] = total[rows, layer] + (model[rows, layer] - sat[:, k]) * conc[rows, layer]
    out = (at[:, 1:] - at[:, :-1]) / (sat[:, :-1] - sat[:, 1:])
    out[sat[:, -1] < model[:, -1] - 1e-9] = np.nan
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def remapped(sat: pd.Series, model: pd.Series, conc: pd.Series) -> pd.Series:
    """Array column of ``remap_layers``; rows with a NULL profile give NULL."""
    out = pd.Series([None] * len(sat), dtype=object)
    ok = sat.notna() & model.notna() & conc.notna()
    if ok.any():
        stack = lambda s: np.stack(s[ok].to_numpy()).astype(float)
        done = remap_layers(stack(sat), stack(model), stack(conc))
        for k, row in zip(np.flatnonzero(ok), done):
            out.iloc[k] = None if np.isnan(row).any() else row.tolist()
    return out


def column_average(prior: Column, kernel: Column, layers: Column, subcolumns: Column) -> Column:
    """Column mole fraction in ppb: prior + kernel * (model - prior), weighted by dry-air subcolumns.

    ``prior`` is in column amounts like ``layers * subcolumns``; ``layers`` are mole fractions.
    """
    amount = F.zip_with(layers, subcolumns, lambda x, s: x * s)
    shift = F.zip_with(F.zip_with(amount, prior, lambda x, p: x - p), kernel, lambda d, a: a * d)
    total = F.aggregate(F.zip_with(prior, shift, lambda p, d: p + d), F.lit(0.0), lambda s, x: s + x)
    return total / F.aggregate(subcolumns, F.lit(0.0), lambda s, x: s + x) * 1e9
