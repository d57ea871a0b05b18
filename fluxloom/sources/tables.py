"""Readers of the landing tables, and the SQL NULL conventions applied on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the number that stands for "missing" beside NULL and NaN.
FILL = -9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(col: Column) -> Column:
    """NULL for NaN and for the fill value, else the number."""
    return F.when(F.isnan(col) | (col == FILL), None).otherwise(col)


def usable(col: Column, upper: float = 1e20) -> Column:
    """True for a number that can be a mole fraction at all: not NULL, not NaN, above 0, below ``upper``."""
    return col.isNotNull() & ~F.isnan(col) & (col > 0) & (col < upper)


def dataset_of(obspack_id: Column) -> Column:
    """Second ``~`` field of an observation id; NULL when there is none."""
    return F.try_element_at(F.split(obspack_id, "~"), F.lit(2))


def site_of(obspack_id: Column) -> Column:
    """Second ``_`` field of the dataset; NULL when there is none."""
    return F.try_element_at(F.split(dataset_of(obspack_id), "_"), F.lit(2))
