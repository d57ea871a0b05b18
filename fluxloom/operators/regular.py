"""Irregular readings onto a regular grid (problem 5).

Each source is cut into time shards. Per shard only its first and last occupied slot matter to its neighbours; a prefix
scan over those summaries gives every shard the state it inherits, after which all shards are filled independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.session import cut
from fluxloom.sources.tables import dataset_of, site_of, usable


def occupied_slots(df: DataFrame, source: Column, time: Column, value: Column, slot_s: int = 3600) -> DataFrame:
    """source, slot (slot number since 1970), n and mean value of the slots that hold a reading.

    One map-side combined aggregation; a source with a third of all rows shrinks to its slots before the shuffle. Rows
    without source, time or value are left out.
    """
    rows = df.select(source.alias("source"), F.floor(F.unix_seconds(time) / slot_s).alias("slot"), value.alias("v"))
    rows = rows.where(F.col("source").isNotNull() & F.col("slot").isNotNull() & F.col("v").isNotNull())
    return rows.groupBy("source", "slot").agg(F.count("*").alias("n"), F.avg("v").alias("value"))


def with_carry(slots: DataFrame, shard_slots: int = 240, slot_s: int = 3600, by_month: bool = True) -> DataFrame:
    """``slots`` with the occupied slot (and value) before each, found per shard plus a prefix scan over shards.

    Shards hold at most ``shard_slots`` slots of one source (and, with ``by_month``, of one UTC month, across which
    nothing is carried). Adds period, shard, prev_slot, prev_value (NULL for the first slot of the period).
    """
    month = F.date_format(F.timestamp_seconds(F.col("slot") * slot_s), "yyyy-MM") if by_month else F.lit("all")
    slots = cut(slots)  # read twice below, and far smaller than the readings
    rows = slots.withColumn("period", month).withColumn("shard", F.floor(F.col("slot") / shard_slots))
    key = ["source", "period"]
    ends = rows.groupBy(*key, "shard").agg(F.max(F.struct("slot", "value")).alias("last"))
    scan = W.partitionBy(*key).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*key, "shard", F.last("last").over(scan).alias("carry"))
    within = W.partitionBy(*key, "shard").orderBy("slot")
    joined = rows.join(carry, [*key, "shard"])
    prev = F.coalesce(F.lag(F.struct("slot", "value")).over(within), F.col("carry"))
    return joined.withColumn("p", prev).select(*rows.columns, F.col("p.slot").alias("prev_slot"), F.col("p.value").alias("prev_value"))


def regular_series(slots: DataFrame, slot_s: int = 3600, shard_slots: int = 240, by_month: bool = True, max_fill: int = 6) -> DataFrame:
    """A row for every slot between the first and last occupied one of each source (and UTC month).

    Columns: source, slot, slot_start, value, status, gap. ``observed`` slots keep their mean; in a gap of at most
    ``max_fill`` slots the value is interpolated between its ends (``filled``), in a longer one it stays NULL
    (``missing``). A source with one slot gives that one row; an empty table gives none.
    """
    rows = with_carry(slots, shard_slots, slot_s, by_month)
    gap = F.col("slot") - F.col("prev_slot") - 1
    fill = F.when(gap > 0, F.sequence(F.col("prev_slot") + 1, F.col("slot") - 1)).otherwise(F.array().cast("array<bigint>"))
    at = F.concat(fill, F.array("slot"))
    wide = rows.select("source", F.col("slot").alias("end"), "prev_slot", "value", "prev_value", F.coalesce(gap, F.lit(0)).alias("gap"), F.explode(at).alias("slot"))
    part = (F.col("slot") - F.col("prev_slot")) / (F.col("end") - F.col("prev_slot"))
    between = F.col("prev_value") + part * (F.col("value") - F.col("prev_value"))
    here = F.col("slot") == F.col("end")
    status = F.when(here, "observed").when(F.col("gap") <= max_fill, "filled").otherwise("missing")
    return wide.select(
        "source",
        "slot",
        F.timestamp_seconds(F.col("slot") * slot_s).alias("slot_start"),
        F.when(here, F.col("value")).when(F.col("gap") <= max_fill, between).alias("value"),
        status.alias("status"),
        F.when(here, 0).otherwise(F.col("gap")).alias("gap"),
    )


def hourly_insitu(obs: DataFrame, value: Column | None = None) -> DataFrame:
    """Regular hourly series per site (of the obspack id) and UTC month from the in-situ datasets' usable readings."""
    value = F.col("value") if value is None else value
    rows = obs.where(dataset_of(F.col("obspack_id")).contains("insitu") & usable(F.col("value")))
    return regular_series(occupied_slots(rows, site_of(F.col("obspack_id")), F.col("time"), value))


def missing_hours(obs: DataFrame) -> DataFrame:
    """sitecode, slot (``yyyy-MM-ddTHH``, UTC) of each hour without a usable in-situ reading inside a site's month."""
    series = hourly_insitu(obs.select("obspack_id", "time", "value")).where(F.col("status") != "observed")
    return series.select(F.col("source").alias("sitecode"), F.date_format("slot_start", "yyyy-MM-dd'T'HH").alias("slot"))
