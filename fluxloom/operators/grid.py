"""Regular model grids: integer cell keys, nearest cells, polygon overlap, dilation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Grid:
    """Cell centres at lon0 + i * dlon and lat0 + j * dlat."""

    lon0: float = -108.0
    lat0: float = 28.0
    dlon: float = 0.3125
    dlat: float = 0.25
    ni: int = 26
    nj: int = 32

    def lon(self, i: Column) -> Column:
        return F.lit(self.lon0) + i * F.lit(self.dlon)

    def lat(self, j: Column) -> Column:
        return F.lit(self.lat0) + j * F.lit(self.dlat)

    def _nearest(self, x: Column, x0: float, d: float, n: int, tolerance: float | None) -> Column:
        k = F.least(F.greatest(F.ceil((x - x0) / d - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
        return k if tolerance is None else F.when(F.abs(x - (x0 + k * d)) < tolerance, k)

    def i_of(self, lon: Column, tolerance: float | None = None) -> Column:
        """Index of the nearest column; ties take the lower one, NULL at ``tolerance`` or more from its centre."""
        return self._nearest(lon, self.lon0, self.dlon, self.ni, tolerance)

    def j_of(self, lat: Column, tolerance: float | None = None) -> Column:
        return self._nearest(lat, self.lat0, self.dlat, self.nj, tolerance)

    @property
    def lon_tolerance(self) -> float:
        return max(self.dlon, 0.5)

    @property
    def lat_tolerance(self) -> float:
        return max(self.dlat, 0.5)

    def inner(self, lon: Column, lat: Column, margin: int = 4) -> Column:
        """Whether a position lies within the centres of the grid without its outer ``margin`` cells (bounds inclusive)."""
        lon_ok = lon.between(self.lon0 + margin * self.dlon, self.lon0 + (self.ni - 1 - margin) * self.dlon)
        return lon_ok & lat.between(self.lat0 + margin * self.dlat, self.lat0 + (self.nj - 1 - margin) * self.dlat)

    def holds(self, lon: tuple[float, float], lat: tuple[float, float]) -> None:
        """ValueError unless the bounds lie on the grid."""
        ends = (self.lon0 + (self.ni - 1) * self.dlon, self.lat0 + (self.nj - 1) * self.dlat)
        if not (self.lon0 <= lon[0] <= lon[1] <= ends[0] and self.lat0 <= lat[0] <= lat[1] <= ends[1]):
            raise ValueError(f"bounds {lon}, {lat} lie outside the grid")

    def cells(self, df: DataFrame) -> DataFrame:
        """All cells (i, j, lon, lat) as a DataFrame of ``df``'s session."""
        n = df.sparkSession.range(self.ni * self.nj)
        ij = n.select((F.col("id") % self.ni).cast("int").alias("i"), F.floor(F.col("id") / self.ni).cast("int").alias("j"))
        return ij.withColumn("lon", self.lon(F.col("i"))).withColumn("lat", self.lat(F.col("j")))


GRID = Grid()


def ring_offsets(rings: int = 2) -> Column:
    """Array of struct<di, dj> of a square neighbourhood of ``rings`` rings, the cell itself included."""
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1)])


def dilate(cells: DataFrame, grid: Grid = GRID, rings: int = 2) -> DataFrame:
    """Distinct (element, i, j) of the cells of every element grown by ``rings`` rings, cut at the grid's edge."""
    near = cells.select("element", "i", "j", F.explode(ring_offsets(rings)).alias("o"))
    grown = near.select("element", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"))
    return grown.where(F.col("i").between(0, grid.ni - 1) & F.col("j").between(0, grid.nj - 1)).distinct()


def clip_area(lon_b: np.ndarray, lat_b: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Planar area of each convex quadrilateral (n, 4) inside its box, for all rows at once.

    Each half plane keeps at most one more corner than it was given; corners that fall away are replaced by their
    neighbour on the cut, so the shoelace sum needs no ragged arrays.
    """
    px, py = lon_b.astype(float), lat_b.astype(float)
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        c = (px, py)[axis]
        d = sign * (c - bound[:, None])
        nx, ny, nd = np.roll(px, -1, 1), np.roll(py, -1, 1), np.roll(d, -1, 1)
        crossing = (d < 0) != (nd < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(crossing, d / (d - nd), 0.0)
        cx, cy = px + t * (nx - px), py + t * (ny - py)
        # two slots per edge: the corner if it is inside, and the crossing; empty slots repeat the next filled one
        sx = np.stack([px, cx], 2).reshape(len(px), -1)
        sy = np.stack([py, cy], 2).reshape(len(px), -1)
        full = np.stack([d >= 0, crossing], 2).reshape(len(px), -1)
        n = full.shape[1]
        k = np.where(full, np.arange(n), -1)
        last = np.maximum.accumulate(np.concatenate([k, np.where(k >= 0, k + n, -1)], 1), 1)[:, n:]
        last = np.where(last < 0, 0, last % n)
        rows = np.arange(len(px))[:, None]
        px, py = sx[rows, last], sy[rows, last]
        gone = ~full.any(1)
        px[gone], py[gone] = 0.0, 0.0
    return 0.5 * np.abs((px * np.roll(py, -1, 1) - np.roll(px, -1, 1) * py).sum(1))


def overlap_cells(pixels: DataFrame, keys: list[str], grid: Grid = GRID) -> DataFrame:
    """(keys, i, j, area, weight) of the cells each pixel covers; ``weight`` is the share of its covered area.

    Candidates are the distinct nearest columns and rows of the four corners, so no pixel meets more than 16 cells and
    the overlap join is an explode, not a cross join. A pixel with a corner beyond the tolerance is left out, and so is
    one with NULL corners.
    """
    near_i = F.transform("lon_b", lambda x: grid.i_of(x, grid.lon_tolerance))
    near_j = F.transform("lat_b", lambda y: grid.j_of(y, grid.lat_tolerance))
    rows = pixels.select(*keys, "lon_b", "lat_b", near_i.alias("ii"), near_j.alias("jj"))
    rows = rows.where((F.size("ii") == 4) & (F.size("jj") == 4) & ~F.exists("ii", lambda k: k.isNull()) & ~F.exists("jj", lambda k: k.isNull()))
    rows = rows.withColumn("i", F.explode(F.array_distinct("ii"))).withColumn("j", F.explode(F.array_distinct("jj"))).drop("ii", "jj")

    @F.pandas_udf(T.DoubleType())
    def area(lon_b: pd.Series, lat_b: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
        if not len(lon_b):
            return pd.Series([], dtype=float)
        x, y, cx, cy = np.stack(lon_b.to_numpy()), np.stack(lat_b.to_numpy()), lon.to_numpy(), lat.to_numpy()
        return pd.Series(clip_area(x, y, cx - grid.dlon / 2, cx + grid.dlon / 2, cy - grid.dlat / 2, cy + grid.dlat / 2))

    rows = rows.withColumn("area", area("lon_b", "lat_b", grid.lon(F.col("i")), grid.lat(F.col("j")))).where(F.col("area") > 0)
    total = rows.groupBy(*keys).agg(F.sum("area").alias("total"))
    return rows.drop("lon_b", "lat_b").join(total, keys).withColumn("weight", F.col("area") / F.col("total")).drop("total")


def axis_edges(cells: DataFrame, axis: str) -> DataFrame:
    """k, mid, lower, upper of the distinct coordinates of ``axis``: edges lie midway, the outer ones as far out as in."""
    mids = cells.select(F.col(axis).alias("mid")).distinct()
    order = W.partitionBy(F.lit(0)).orderBy("mid")  # the coordinates of one axis only
    before, after = F.lag("mid").over(order), F.lead("mid").over(order)
    rows = mids.select((F.row_number().over(order) - 1).alias("k"), "mid", before.alias("before"), after.alias("after"))
    down, up = (F.col("mid") - F.col("before")) / 2, (F.col("after") - F.col("mid")) / 2
    return rows.select("k", "mid", (F.col("mid") - F.coalesce(down, up, F.lit(0.0))).alias("lower"), (F.col("mid") + F.coalesce(up, down, F.lit(0.0))).alias("upper"))


def eastern_edge(lon: Column, dlon: float) -> Column:
    """East edge of the cell centred at ``lon``: on a global grid of 2.5 degrees the easternmost cell reaches 180."""
    edge = lon + dlon / 2
    return F.when(lon == 177.5, F.lit(180.0)).otherwise(edge) if dlon == 2.5 else edge


def checked_cover(overlaps: DataFrame, pixel_area: Column, dlon: float, tolerance: float = 0.01) -> DataFrame:
    """``overlaps`` where the covered area must be the pixel's (global grids, ``dlon`` above 2): raises on a row that
    differs by ``tolerance`` or more; other grids pass unchecked."""
    if dlon <= 2.0:
        return overlaps
    off = F.abs(F.col("covered") - pixel_area) / pixel_area
    return overlaps.withColumn("covered", F.when(off < tolerance, F.col("covered")).otherwise(F.raise_error(F.lit("overlap and pixel area differ")).cast("double")))
