"""Positions, distances, regions."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import geo
from fluxloom.operators import nearby


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def wkb(x, y):
    return (b"\x01\x01\x00\x00\x00" + struct.pack("<dd", x, y)).hex().upper()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("POINT (-64.14792 9.13605)", (-64.14792, 9.13605)), ("SRID=4326;POINT(179.22729 -17.05338)", (179.22729, -17.05338)), ("POINT Z (139.44481 -35.01045 2.6)", (139.44481, -35.01045)),
        ("point(   0.140900   69.297530 )", (0.1409, 69.29753)), ('{"type": "Point", "coordinates": [-0.01845, -54.4705]}', (-0.01845, -54.4705)), (wkb(-103.5, 32.25), (-103.5, 32.25)), (wkb(0.0, -0.1), (0.0, -0.1)),
        ("POINT (35.60606 -97.32821)", (-97.32821, 35.60606)), ("POINT (250.5 31.25)", (-109.5, 31.25)), ("POINT (-17.5 182.25)", (-177.75, -17.5)), ("POINT (-270 10)", (90.0, 10.0)), ("POINT EMPTY", None), ("LINESTRING (0 0, 1 1)", None), ("POINT (200 300)", None), ("", None), (None, None),
    ],
)
def test_points(spark, text, want):
    got = one(spark, geo.parse_point(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def great_circle(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def test_within_distance_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-89.9, 89.9, 60)))]
    places += [(100, 179.995, 10.0), (101, -179.999, 65.0), (102, 20.0, 89.99), (103, 0.0, -90.0), (104, None, 1.0)]
    points = []
    for k, (_, x, y) in enumerate(p for p in places if p[1] is not None):
        for n in range(12):
            r, b = rng.uniform(0, 0.03), rng.uniform(0, 2 * math.pi)
            lat = max(-90.0, min(90.0, y + r * math.sin(b)))
            lon = x + r * math.cos(b) / max(0.01, math.cos(math.radians(min(89.0, abs(y)))))
            points.append((k * 100 + n, (lon + 180) % 360 - 180, lat))
    points.append((99999, None, None))
    want = {(i, j) for i, x, y in points if x is not None for j, a, b in places if a is not None and great_circle(x, y, a, b) <= 2000}
    p = spark.createDataFrame(points, "id long, lon double, lat double").withColumn("row", F.lit("clash"))
    q = spark.createDataFrame(places, "place_id long, lon double, lat double")
    got = [(r["id"], r["place_id"]) for r in nearby.within_distance(p, q, 2000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert nearby.within_distance(p.limit(0), q.limit(0), 2000.0).count() == 0


def test_regions_with_holes_and_parts(spark):
    regions = [
        (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (2, "MULTIPOLYGON (((179 0, 180 0, 180 1, 179 1, 179 0)), ((-180 0, -179 0, -179 1, -180 1, -180 0)))"), (3, "rubbish"), (4, None),
    ]
    points = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.9, 3.9), (4, 179.5, 0.5), (5, -179.5, 0.5), (6, 5.0, 5.0), (7, None, 0.0)]
    got = nearby.containing_regions(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(regions, "place_id long, wkt string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (3, 1), (4, 2), (5, 2)}


def test_longitudes_above_180_meet_regions_and_sources(spark):
    plumes = spark.createDataFrame([(1, "POINT (251.0 31.0)", None, None), (2, None, 251.0, 31.0), (3, "POINT (31.0 251.0)", None, None), (4, "POINT (-109.0 31.0)", None, None), (5, None, None, None)], "plume_id long, geometry string, lon double, lat double")
    sources = spark.createDataFrame([(7, -109.0, 31.001)], "source_id long, lon double, lat double")
    regions = spark.createDataFrame([(9, "POLYGON ((-110 30, -108 30, -108 32, -110 32, -110 30))")], "roi_id long, wkt string")
    got = {tuple(r) for r in nearby.places_found(plumes, sources, regions).collect()}
    assert got == {(kind, k, place) for k in (1, 2, 3, 4) for kind, place in (("near", 7), ("inside", 9))}


def test_large_region_keeps_its_shape_in_every_cell(spark):
    rng = np.random.default_rng(2)
    ring = [(float(30 * math.cos(a) * r), float(30 * math.sin(a) * r)) for a, r in zip(np.linspace(0, 2 * math.pi, 200, endpoint=False), rng.uniform(0.4, 1.0, 200))]
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))"
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-32, 32, (500, 2)))]
    want = set()
    for k, x, y in points:
        cross = sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]]))
        want |= {k} if cross % 2 else set()
    got = nearby.containing_regions(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame([(1, wkt)], "place_id long, wkt string"))
    assert {r["id"] for r in got.collect()} == want and len(want) > 50


def test_touched_cells_cover_the_circle(spark):
    grid = geo.RadiusGrid(2500)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        x, y = rng.uniform(-180, 180), rng.choice([rng.uniform(-89.99, 89.99), 0.0, 80.0])
        b = rng.uniform(0, 2 * math.pi)
        d = 499.0 / 6371000
        lat = math.asin(math.sin(math.radians(y)) * math.cos(d) + math.cos(math.radians(y)) * math.sin(d) * math.cos(b))
        lon = math.radians(x) + math.atan2(math.sin(b) * math.sin(d) * math.cos(math.radians(y)), math.cos(d) - math.sin(math.radians(y)) * math.sin(lat))
        rows.append((x, float(y), (math.degrees(lon) + 180) % 360 - 180, math.degrees(lat)))
    df = spark.createDataFrame(rows, "x double, y double, lon double, lat double")
    row = grid.row(F.col("lat"))
    home = F.struct(row.alias("row"), grid.column(F.col("lon"), row).alias("col"))
    assert df.where(~F.array_contains(grid.touched(F.col("x"), F.col("y"), 500.0), home)).count() == 0


def test_crowded_cell_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nearby, "broadcast_if_small", lambda df, *a: df)
    p = spark.range(3000).select("id", F.lit(10.0).alias("lon"), F.lit(10.0).alias("lat"))
    q = spark.createDataFrame([(1, 10.0, 10.001), (1, 10.0, 10.001), (2, 11.0, 10.0)], "place_id long, lon double, lat double")
    assert nearby.within_distance(p, q, 2000.0).count() == 6000
