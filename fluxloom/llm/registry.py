"""The registered queries of the language-data subpackage."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import batch_dedup, leakage, packing, pii
from fluxloom.session import cut, ensure_checkpoint_dir
from fluxloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


#: Rows up to which p3_found accepts the batches that wait together.
TOGETHER = 4_000_000


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Group after group of batches through the persisted cells: probe, compare, append."""
    records = batch_dedup.plume_records(table(spark, d, "plumes"), table(spark, d, "sources"))
    return batch_dedup.find_duplicates(records, _folder(spark, "cells"), together=TOGETHER).select("kept_id", F.col("id").alias("plume_id"))


def p3_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The repeats of the last batch, checked against the persisted cells of all earlier ones and itself."""
    records = cut(batch_dedup.plume_records(table(spark, d, "plumes"), table(spark, d, "sources")))
    last = records.agg(F.max("batch")).first()[0]
    index = batch_dedup.CellIndex(spark, _folder(spark, "cells"))
    index.accept(records.where(F.col("batch") < last))
    index.compact()
    index.accept(records.where(F.col("batch") == last))
    return index.repeats().where(F.col("batch") == last).select("kept_id", F.col("id").alias("plume_id"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    index = leakage.PostingIndex(spark, _folder(spark, "postings")).add(table(spark, d, "documents"))
    return leakage.leaked_items(index, table(spark, d, "eval_items")).select("item_id", "doc_id").distinct()


#: Windows of the packing queries, in tokens.
TIERS = (512, 1024, 2048)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, d, "documents"), max(TIERS)), TIERS)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


_MODELS: dict[tuple[str, str], str] = {}


def _model(spark: SparkSession, d: str) -> pii.Model:
    """The model of a data folder, trained once per application and stored in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        path = _folder(spark, "pii-model")
        pii.train_model(table(spark, d, "documents")).save(spark, path)
        _MODELS[key] = path
    return pii.Model.load(spark, _MODELS[key])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal_data(table(spark, d, "documents"), _model(spark, d)).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), _model(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_new_batch, p8_packed, p8_fill, p9_found, p10_found, p10_redacted)}
ORACLE_SQL: dict[str, str] = {}
