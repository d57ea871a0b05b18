"""Building and reducing the state vector."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.geo import polygon_edges
from fluxloom.operators.grid import ring_offsets
from fluxloom.operators.nearby import containing_regions, within_distance
from fluxloom.session import cut
from fluxloom.sources.tables import FILL

# Largest cluster by resolution (degrees latitude).
MAX_CLUSTER = {0.125: 128, 0.25: 64, 0.5: 32, 2.0: 16, 4.0: 8}


def numbered(rows: DataFrame, major: Column, minor: list[Column], name: str) -> DataFrame:
    """``rows`` numbered 1..N by ``major``, then ``minor``: counts per major value are summed up over the few major
    values, rows are numbered within theirs, so no window holds the whole table."""
    keyed = rows.withColumn("_major", major)
    counts = keyed.groupBy("_major").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_major")) - F.col("_n")).drop("_n")
    within = F.row_number().over(W.partitionBy("_major").orderBy(*minor))
    return keyed.join(before, "_major").withColumn(name, (F.col("_before") + within).cast("int")).drop("_major", "_before")


def native_labels(cells: DataFrame, descending: bool = True) -> DataFrame:
    """``cells`` (i, j, lon, lat) with element numbers 1..N by rows of the grid; descending gives the first cell N."""
    return numbered(cells, -F.col("j") if descending else F.col("j"), [F.desc("i") if descending else F.asc("i")], "element")


def buffer_cells(cells: DataFrame, core: DataFrame, rings: int = 3) -> DataFrame:
    """The cells within ``rings`` (three at least) of a cell of ``core`` that are not in it themselves."""
    if rings < 3:
        raise ValueError("the buffer must be at least three cells wide")
    near = core.select("i", "j", F.explode(ring_offsets(rings)).alias("o")).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j")).distinct()
    return cells.join(near, ["i", "j"], "left_semi").join(core.select("i", "j"), ["i", "j"], "left_anti")


def buffer_labels(buffer: DataFrame, k: int, offset: int, seed: int = 0) -> DataFrame:
    """``buffer`` cells with element: k-means clusters of their places, numbered after ``offset``; FILL without clusters."""
    if k == 0:
        return buffer.withColumn("element", F.lit(int(FILL)))
    return kmeans_labels(buffer, ["lon", "lat"], k, seed).withColumn("element", (F.col("label") + offset).cast("int")).drop("label")


def native_state_vector(cells: DataFrame, roi: Column, land: Column, k_buffer: int, rings: int = 3) -> DataFrame:
    """i, j, lon, lat, element, is_roi: region cells numbered by rows, then ``k_buffer`` clusters of the buffer around.

    ``roi`` says which cells lie in the region's bounds, ``land`` which are no water: water has no element.
    """
    dry = cells.where(land)
    core = dry.where(roi)
    n = core.count()
    inner = native_labels(core).withColumn("is_roi", F.lit(True))
    outer = buffer_labels(buffer_cells(dry, core, rings), k_buffer, n).withColumn("is_roi", F.lit(False))
    names = ["i", "j", "lon", "lat", "element", "is_roi"]
    return inner.select(*names).unionByName(outer.select(*names))


def check_feasible(n_cells: int, n_labels: int, resolution: float) -> None:
    """ValueError unless ``n_labels`` labels of the largest cluster size allowed at ``resolution`` can hold all cells."""
    most = MAX_CLUSTER[resolution]
    if n_labels < 1 or n_labels * most < n_cells:
        raise ValueError(f"{n_labels} labels of at most {most} cells cannot hold {n_cells} cells")


def scaled_buffer(elements: DataFrame, value: str, n_roi: int, factor: float = 0.0) -> DataFrame:
    """``elements`` with ``value`` of the elements beyond the region multiplied by ``factor`` (0 puts them out)."""
    return elements.withColumn(value, F.when(F.col("element") > n_roi, F.col(value) * factor).otherwise(F.col(value)))


def largest_overlap(pairs: DataFrame) -> DataFrame:
    """i, j, place_id, area: of the regions that share area with a cell the one that shares most (ties: the lower id)."""
    best = F.max_by(F.struct("place_id", "area"), F.struct("area", -F.col("place_id"))).alias("b")
    return pairs.where(F.col("area") > 0).groupBy("i", "j").agg(best).select("i", "j", "b.place_id", "b.area")


def region_overlaps(cells: DataFrame, regions: DataFrame, dlon: float, dlat: float, fine: int = 8) -> DataFrame:
    """i, j, place_id, area of the regions (place_id, wkt) that cover part of a cell (i, j, lon, lat).

    A cell is read at ``fine`` x ``fine`` points, which are joined with the regions by grid cells and tested exactly;
    ``area`` is the covered share in square kilometres of the cell at its latitude.
    """
    steps = F.sequence(F.lit(0), F.lit(fine - 1))
    points = cells.select("i", "j", "lon", "lat", F.explode(steps).alias("a")).select("*", F.explode(steps).alias("b"))
    at = lambda c, k, d: F.col(c) + (F.col(k) + 0.5 - fine / 2) * (d / fine)
    points = points.select(F.struct("i", "j", "a", "b").alias("id"), at("lon", "a", dlon).alias("lon"), at("lat", "b", dlat).alias("lat"))
    hits = containing_regions(points, regions).groupBy(F.col("id.i").alias("i"), F.col("id.j").alias("j"), "place_id").agg(F.count("*").alias("n"))
    cell = F.cos(F.radians("lat")) * (dlon * dlat * 111.195**2)
    return hits.join(cells.select("i", "j", "lat"), ["i", "j"]).select("i", "j", "place_id", (F.col("n") / fine**2 * cell).alias("area"))


def cell_regions(cells: DataFrame, regions: DataFrame, dlon: float, dlat: float, reach_m: float) -> DataFrame:
    """i, j, place_id of every cell: the region it shares most area with, else the nearest region's corner within
    ``reach_m``; cells farther away have none."""
    own = cut(largest_overlap(region_overlaps(cells, regions, dlon, dlat)).select("i", "j", "place_id"))
    rest = cells.join(own, ["i", "j"], "left_anti").select(F.struct("i", "j").alias("id"), "lon", "lat")
    corners = regions.select("place_id", F.explode(polygon_edges(F.col("wkt"))).alias("e")).select("place_id", F.col("e.x1").alias("lon"), F.col("e.y1").alias("lat"))
    near = within_distance(rest, corners, reach_m).groupBy("id").agg(F.min_by("place_id", F.struct("metres", "place_id")).alias("place_id"))
    return own.unionByName(near.select("id.i", "id.j", "place_id"))


def included(land: Column, offshore: Column, land_least: float = 0.25, emission_least: float = 0.0) -> Column:
    """Whether a cell belongs to the domain: land enough, or offshore emissions."""
    return (land > land_least) | (offshore > emission_least)


def label_totals(elements: DataFrame, sensitivities: DataFrame) -> DataFrame:
    """element, cells, total: size and summed sensitivity per label."""
    return elements.join(sensitivities, ["i", "j"]).groupBy("element").agg(F.count("*").alias("cells"), F.sum("a").alias("total"))


def strongest_labels(totals: DataFrame, n: int) -> DataFrame:
    """The ``n`` labels of highest total, ties to the lower label."""
    return totals.orderBy(F.desc("total"), F.asc("element")).limit(n)


def forced_native(sensitivities: DataFrame, points: DataFrame, value: float = 1.1) -> DataFrame:
    """Sensitivities with the cells of ``points`` (i, j) raised to ``value``, so that they stay native pixels."""
    marks = points.select("i", "j", F.lit(True).alias("forced")).distinct()
    return sensitivities.join(marks, ["i", "j"], "left").withColumn("a", F.when(F.col("forced"), value).otherwise(F.col("a"))).drop("forced")


def kmeans_labels(cells: DataFrame, features: list[str], k: int, seed: int = 0) -> DataFrame:
    """``cells`` with label 1..k of a k-means clustering on ``features`` (numbering is the algorithm's own)."""
    assembled = VectorAssembler(inputCols=features, outputCol="_v").transform(cells)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=20).fit(assembled)
    return model.transform(assembled).withColumn("label", F.col("_c") + 1).drop("_v", "_c")


def reduce_by_information(cells: DataFrame, sensitivity: str, threshold: float, max_cluster: int, n_labels: int | None = None) -> DataFrame:
    """``cells`` (i, j, lon, lat, sensitivity) with labels 1..N that each gather ``threshold`` of information where they can.

    Level by level, cells are grouped into ever larger clusters (1, 2, 4, ... ``max_cluster`` cells on average); at each
    level the groups that reach the threshold get a label, strongest first, and the others go on to the next level. What
    the last level leaves is labelled in clusters of ``max_cluster``, or, when only one of ``n_labels`` is left, as one.
    The driver holds counts only.
    """
    rest, out, used, size = cut(cells), None, 0, 1
    while n := rest.count():
        left = None if n_labels is None else n_labels - used
        last = size >= max_cluster or left == 1
        k = 1 if left == 1 else -(-n // min(size, max_cluster))
        if left is not None:
            k = min(k, max(1, left)) if last else k
        if size == 1 and not last:
            grouped = numbered(rest, F.col("j"), [F.asc("i")], "group")
        else:
            grouped = (kmeans_labels(rest, ["lon", "lat"], k) if 1 < k < n else rest.withColumn("label", F.lit(1)) if k == 1 else numbered(rest, F.col("j"), [F.asc("i")], "label")).withColumnRenamed("label", "group")
        grouped = cut(grouped)
        sums = grouped.groupBy("group").agg(F.sum(sensitivity).alias("total"))
        kept = sums if last else sums.where(F.col("total") >= threshold).orderBy(F.desc("total"), "group")
        if not last and left is not None:
            kept = kept.limit(left - 1)
        labels = cut(numbered(kept, -F.round(F.col("total"), 6), [F.asc("group")], "label"))
        done = grouped.join(labels.select("group", (F.col("label") + used).cast("int").alias("label")), "group").select(*cells.columns, "label")
        out = done if out is None else out.unionByName(done)
        used += labels.count()
        rest = cut(grouped.join(labels, "group", "left_anti").select(*cells.columns))
        size *= 2
    return cells.withColumn("label", F.lit(0)).limit(0) if out is None else out
