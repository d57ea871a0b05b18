"""The registered queries of the general data-quality problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import drift, nearby, regular, spikes, timestamps, units
from fluxloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(table(spark, d, "obspack")).select("row_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.schema_changes(drift.file_schemas(drift.tagged_fields(table(spark, d, "plume_raw"))))
    return changes.select("file_name", "field", "change").distinct()


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.unified_table(table(spark, d, "plume_raw"))
    return rows.select("feed", "file_name", "line_no", "lon", "lat", "obs_date", "obs_time", "instrument", "platform", "rate", "rate_unit", "rate_std", "kg_h", "kg_h_std", F.size("branches").alias("n_fields"), *drift.typed_branches(F.col("branches")))


def p2_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Types that a path of the feeds' lines takes up or gives up from file to file."""
    return drift.alternative_changes(table(spark, d, "plume_raw"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.units_found(table(spark, d, "obspack"), table(spark, d, "plumes"), table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return regular.missing_hours(table(spark, d, "obspack"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.times_found(table(spark, d, "plumes"), table(spark, d, "obspack"), table(spark, d, "sources"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nearby.places_found(table(spark, d, "plumes"), table(spark, d, "point_sources"), table(spark, d, "roi_polygons"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_table, p2_alternatives, p4_found, p5_found, p6_found, p7_found)}
