"""Positions: reading points and polygons, great-circle distance, point in polygon. All JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxloom.functions.let import let
from fluxloom.sources.tables import finite

EARTH_M = 6_371_000.0
_NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"


def _double_of_hex(little_endian: Column) -> Column:
    """The double whose 8 bytes are written as 16 hex digits, lowest byte first."""
    return let(F.concat(*[F.substring(little_endian, k, 2) for k in range(15, 0, -2)]), _double_of_big)


def _double_of_big(big: Column) -> Column:
    top = F.conv(F.substring(big, 1, 3), 16, 10).cast("int")
    fraction = F.conv(F.substring(big, 4, 13), 16, 10).cast("double") / float(2**52)
    sign = F.when(top >= 2048, -1.0).otherwise(1.0)
    exponent = top % 2048
    return F.when(exponent == 0, 0.0).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))


def parse_point(text: Column) -> Column:
    """struct<lon, lat> of a point written as (E)WKT, GeoJSON or little-endian WKB in hex; NULL when unreadable.

    The first number is the longitude unless the second cannot be a latitude.
    """
    return let(F.trim(text), _point_of)


def _point_of(t: Column) -> Column:
    pair = rf"({_NUMBER})[\s,]+({_NUMBER})"
    spoken = rf"(?i)^(?:SRID=\d+;)?\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*{pair}"
    json = rf'(?i)"coordinates"\s*:\s*\[\s*{pair}'
    flagged = F.upper(F.substring(t, 9, 2)).isin("20", "60", "A0", "E0")  # an SRID follows the type
    at = F.when(flagged, 19).otherwise(11)
    wkb = t.rlike("^01[0-9A-Fa-f]{40,}$")
    number = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("double")
    a = F.when(wkb, _double_of_hex(t.substr(at, F.lit(16)))).when(t.rlike(spoken), number(spoken, 1)).when(t.rlike(json), number(json, 1))
    b = F.when(wkb, _double_of_hex(t.substr(at + 16, F.lit(16)))).when(t.rlike(spoken), number(spoken, 2)).when(t.rlike(json), number(json, 2))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: lon_lat(p["a"], p["b"]))


def lon_lat(a: Column, b: Column) -> Column:
    """struct<lon, lat> with ``a`` as the longitude unless ``b`` cannot be a latitude; NULL when neither order works.

    Longitudes counted from 0 to 360 are folded to -180 to 180.
    """
    straight = (F.abs(b) <= 90) & (F.abs(a) <= 360)
    swapped = (F.abs(a) <= 90) & (F.abs(b) <= 360)
    fold = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    return F.when(straight, F.struct(fold(a).alias("lon"), b.alias("lat"))).when(swapped, F.struct(fold(b).alias("lon"), a.alias("lat")))


def position(geometry: Column, lon: Column, lat: Column) -> Column:
    """struct<lon, lat> from ``geometry``, else from ``lon``/``lat``; NULL when neither gives a position."""
    return F.coalesce(parse_point(geometry), lon_lat(finite(lon), finite(lat)))


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance along the great circle on a sphere of 6371 km, in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


class RadiusGrid:
    """Cells at least ``radius_m`` wide in both directions; rows of latitude have their own number of columns."""

    def __init__(self, radius_m: float):
        self.step = math.degrees(radius_m / EARTH_M) * 1.000001

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.step).cast("bigint")

    def columns(self, row: Column) -> Column:
        """Number of cells around the globe in a row, from the row's edge farthest from the equator."""
        edge = F.greatest(F.abs(row * self.step - 90), F.abs((row + 1) * self.step - 90))
        # a circle of this radius reaches asin(sin r / cos lat) in longitude
        reach = F.when(edge + self.step >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(self.step))) / F.cos(F.radians(edge))))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / reach)).cast("bigint")

    def column(self, lon: Column, row: Column) -> Column:
        n = self.columns(row)
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("bigint"), n)

    def around(self, lon: Column, lat: Column) -> Column:
        """Array of struct<row, col> that can hold a point within the radius."""
        rows = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: self.row(lat) + k)

        def cells(row: Column) -> Column:
            n = self.columns(row)
            at = F.floor((lon + 180) / 360 * n).cast("bigint")
            cols = F.array_distinct(F.array(F.pmod(at - 1, n), F.pmod(at, n), F.pmod(at + 1, n)))
            return F.transform(cols, lambda c: F.struct(row.alias("row"), c.alias("col")))

        return F.flatten(F.transform(rows, cells))


    def touched(self, lon: Column, lat: Column, reach_m: float) -> Column:
        """Array of struct<row, col> that a circle of ``reach_m`` touches: one to four up to half the grid's radius."""
        reach = math.degrees(reach_m / EARTH_M) * 1.000001
        rows = F.sequence(self.row(lat - reach), self.row(lat + reach))

        def cells(row: Column) -> Column:
            edge = F.least(F.abs(lat) + reach, F.lit(90.0))
            dlon = F.when(edge >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(edge))))))
            n = self.columns(row)
            at = lambda x: F.floor((x + 180) / 360 * n).cast("bigint")
            cols = F.transform(F.sequence(at(lon - dlon), at(lon + dlon)), lambda c: F.pmod(c, n))
            every = F.sequence(F.lit(0).cast("bigint"), n - 1)
            cols = F.when(dlon >= 180, every).otherwise(F.array_distinct(cols))
            return F.transform(cols, lambda c: F.struct(row.alias("row"), c.alias("col")))

        return F.flatten(F.transform(rows, cells))


def polygon_edges(wkt: Column) -> Column:
    """Edges (x1, y1, x2, y2) of all rings of a POLYGON or MULTIPOLYGON; NULL when there is no ring."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def edges(ring: Column) -> Column:
        points = F.transform(F.split(F.trim(ring), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.try_cast("double")))
        ends = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
        return F.zip_with(
            F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
            ends,
            lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")),
        )

    out = F.flatten(F.transform(rings, edges))
    return F.when(F.size(out) > 0, out)


def inside(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside and the parts of a multipolygon are inside."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges, crosses)) % 2 == 1
