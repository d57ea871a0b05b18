"""Points near other points or regions (problem 7).

Points are hashed to grid cells sized by the radius, joined with the neighbouring cells of the other side, and every
candidate is verified by exact great-circle distance or point-in-polygon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.geo import RadiusGrid, great_circle_m, inside, polygon_edges, position
from fluxloom.session import broadcast_if_small, cut
from fluxloom.sources.tables import finite


def within_distance(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (id, place_id, metres) at most ``radius_m`` apart.

    ``points`` has id, lon, lat; ``places`` has place_id, lon, lat; rows without a position match nothing. Only
    ``places`` are copied to their nine neighbouring cells. The join is a broadcast while the places are counted to be
    few, else a shuffle on the cell that AQE splits where a cell is crowded. The grid closes across the antimeridian
    and at the poles. Repeated points and places give a row each.
    """
    grid = RadiusGrid(radius_m)
    p = points.select("id", "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    p = p.withColumn("row", grid.row(F.col("lat"))).withColumn("col", grid.column(F.col("lon"), F.col("row")))
    q = places.select("place_id", F.col("lon").alias("plon"), F.col("lat").alias("plat")).where(F.col("plon").isNotNull() & F.col("plat").isNotNull())
    q = q.withColumn("cell", F.explode(grid.around(F.col("plon"), F.col("plat")))).select("place_id", "plon", "plat", "cell.row", "cell.col")
    d = great_circle_m(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    return p.join(broadcast_if_small(q), ["row", "col"]).withColumn("metres", d).where(F.col("metres") <= radius_m).select("id", "place_id", "metres")


def containing_regions(points: DataFrame, regions: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Pairs (id, place_id) of a point and a polygon (planar degrees, holes excluded) that contains it.

    ``regions`` has place_id and wkt. A region is listed in the cells its bounding box touches, in each with only those
    edges that a ray to the east from a point of the cell can cross, so large outlines are not copied whole. Unreadable
    regions and points without a position match nothing; a polygon across the antimeridian is written in parts.
    """
    cell = lambda c: F.floor(c / cell_deg).cast("bigint")
    r = regions.select("place_id", polygon_edges(F.col("wkt")).alias("edges")).where(F.col("edges").isNotNull())
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    r = r.withColumn("cx", F.explode(F.sequence(cell(F.array_min(xs)), cell(F.array_max(xs))))).withColumn("cy", F.explode(F.sequence(cell(F.array_min(ys)), cell(F.array_max(ys)))))
    south, west = F.col("cy") * cell_deg, F.col("cx") * cell_deg
    crossed = lambda e: (F.least(e["y1"], e["y2"]) <= south + cell_deg) & (F.greatest(e["y1"], e["y2"]) >= south) & (F.greatest(e["x1"], e["x2"]) >= west)
    r = cut(r.select("place_id", "cx", "cy", F.filter("edges", crossed).alias("edges")).where(F.size("edges") > 0))
    p = points.select("id", "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("cx", cell(F.col("lon"))).withColumn("cy", cell(F.col("lat")))
    hit = p.join(broadcast_if_small(r), ["cx", "cy"])
    return hit.where(inside(F.col("lon"), F.col("lat"), F.col("edges"))).select("id", "place_id")


def plume_positions(plumes: DataFrame) -> DataFrame:
    """id, lon, lat of the plumes: ``geometry``, else the columns lon and lat."""
    at = plumes.select(F.col("plume_id").alias("id"), position(F.col("geometry"), F.col("lon"), F.col("lat")).alias("p"))
    return at.select("id", "p.lon", "p.lat")


def places_found(plumes: DataFrame, point_sources: DataFrame, polygons: DataFrame, radius_m: float = 2000.0) -> DataFrame:
    """kind, plume_id, place_id: point sources within ``radius_m`` of a plume, and polygons that contain it."""
    at = plume_positions(plumes)
    places = point_sources.select(F.col("source_id").alias("place_id"), finite(F.col("lon")).alias("lon"), finite(F.col("lat")).alias("lat"))
    near = within_distance(at, places, radius_m).select(F.lit("near").alias("kind"), F.col("id").alias("plume_id"), "place_id")
    within = containing_regions(at, polygons.select(F.col("roi_id").alias("place_id"), "wkt"))
    return near.unionByName(within.select(F.lit("inside").alias("kind"), F.col("id").alias("plume_id"), "place_id")).distinct()
