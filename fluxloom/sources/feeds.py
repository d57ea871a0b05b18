"""Plume and point-source connectors over local files, and other text sources.

A connector is a function (spark, path) -> DataFrame of COLUMNS; ``CONNECTORS`` maps names to them, so a run's settings
choose among registered functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["lon", "lat", "emission_rate", "emission_rate_std", "time", "instrument", "platform", "datasource"]


def _has(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _number(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("nan", ""), None).otherwise(c.try_cast("double"))


def weekly_list(spark: SparkSession, path: str) -> DataFrame:
    """Weekly CSV lists in t/h (column names of either generation): rows without a time are no detection."""
    raw = spark.read.option("header", True).csv(path)
    std = F.coalesce(_number(_has(raw, "uncertainty_t/h")), _number(_has(raw, "uncertainty")))
    time = F.try_to_timestamp(F.concat(_has(raw, "date"), F.lit(" "), _has(raw, "time_UTC")), F.lit("yyyyMMdd HH:mm:ss"))
    return raw.where(_has(raw, "time_UTC").isNotNull()).select(
        _number(_has(raw, "lon")).alias("lon"), _number(_has(raw, "lat")).alias("lat"), (_number(_has(raw, "source_rate_t/h")) * 1000).alias("emission_rate"), (std * 1000).alias("emission_rate_std"),
        time.alias("time"), F.lit("TROPOMI").alias("instrument"), F.lit(None).cast("string").alias("platform"), F.lit("SRON").alias("datasource"),
    )


def catalogue(spark: SparkSession, path: str, satellites_only: bool = False) -> DataFrame:
    """Catalogue export in kg/h, without first-light data and, on request, without aircraft instruments."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.where(~F.coalesce(_has(raw, "mission_phase"), F.lit("")).contains("first_light"))
    if satellites_only:
        rows = rows.where(~F.coalesce(_has(raw, "instrument"), F.lit("")).isin("GAO", "ang", "av3"))
    return rows.select(
        _number(_has(raw, "plume_longitude")).alias("lon"), _number(_has(raw, "plume_latitude")).alias("lat"), _number(_has(raw, "emission_auto")).alias("emission_rate"),
        _number(_has(raw, "emission_uncertainty_auto")).alias("emission_rate_std"), F.to_timestamp(_has(raw, "datetime")).alias("time"), _has(raw, "instrument").alias("instrument"),
        _has(raw, "platform").alias("platform"), F.lit("CarbonMapper").alias("datasource"),
    )


def portal(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON export in kg/h; the position is that of the properties, not of the plume's outline."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<lon: DOUBLE, lat: DOUBLE, ch4_fluxrate: DOUBLE, ch4_fluxrate_std: DOUBLE, tile_date: STRING, satellite: STRING>>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*")
    return p.select(
        "lon", "lat", F.col("ch4_fluxrate").alias("emission_rate"), F.col("ch4_fluxrate_std").alias("emission_rate_std"), F.to_timestamp("tile_date").alias("time"),
        F.col("satellite").alias("instrument"), F.lit(None).cast("string").alias("platform"), F.lit("IMEO").alias("datasource"),
    )


CONNECTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"weekly_list": weekly_list, "catalogue": catalogue, "portal": portal}


def all_plumes(spark: SparkSession, feeds: dict[str, str], first: str | None = None, last: str | None = None) -> DataFrame:
    """The named connectors' plumes in one table, with a rate, from ``first`` to ``last`` (inclusive timestamps)."""
    unknown = set(feeds) - set(CONNECTORS)
    if unknown:
        raise ValueError(f"no such connector: {sorted(unknown)}; known are {sorted(CONNECTORS)}")
    if not feeds:
        raise ValueError("no feed is named")
    out = None
    for name, path in feeds.items():
        one = CONNECTORS[name](spark, path).select(*COLUMNS)
        out = one if out is None else out.unionByName(one)
    out = out.where(F.col("emission_rate").isNotNull())
    if first:
        out = out.where(F.col("time") >= F.lit(first).cast("timestamp"))
    return out.where(F.col("time") <= F.lit(last).cast("timestamp")) if last else out


def point_sources(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon of a point-source CSV; ValueError unless it is a .csv with both columns."""
    if not path.endswith(".csv"):
        raise ValueError("point sources must be a .csv file")
    raw = spark.read.option("header", True).csv(path)
    if not {"lat", "lon"} <= set(raw.columns):
        raise ValueError("point sources need the columns lat and lon")
    return raw.select(_number(F.col("lat")).alias("lat"), _number(F.col("lon")).alias("lon"))


def paths_in_log(spark: SparkSession, path: str) -> DataFrame:
    """path, found: the files a dry run opened or missed, each once, read off its log."""
    lines = spark.read.text(path).select(F.replace("value", F.lit("//"), F.lit("/")).alias("line"))
    up = F.upper("line")
    found = F.when(up.contains(": OPENING") | up.contains(": READING"), True).when(up.contains("FILE NOT FOUND"), False)
    return lines.select(F.element_at(F.split(F.trim("line"), r"\s+"), -1).alias("path"), found.alias("found")).where(F.col("found").isNotNull()).distinct()


def any_line_contains(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a line of a text contains a token; reading stops at the first."""
    return spark.read.text(path).where(F.col("value").contains(token)).limit(1).count() > 0


def cached(spark: SparkSession, name: str, path: str, cache: str) -> DataFrame:
    """The plumes of a connector, kept as Parquet in ``cache``: read from there, else fetched from ``path`` and stored.

    A cache that cannot be read, for whatever reason, is fetched anew.
    """
    if name not in CONNECTORS:
        raise ValueError(f"no such connector: {name!r}; known are {sorted(CONNECTORS)}")
    try:
        held = spark.read.parquet(f"{cache}/{name}").select(*COLUMNS)
        held.limit(1).count()
        return held
    except Exception:
        CONNECTORS[name](spark, path).select(*COLUMNS).write.mode("overwrite").parquet(f"{cache}/{name}")
        return spark.read.parquet(f"{cache}/{name}")
