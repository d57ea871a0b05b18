"""Session helpers: local sessions for tests, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = "*", app: str = "fluxloom", **conf: str) -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (no effect where it is installed)."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset and gets a temporary folder; on a cluster, whose executors do not
    share the driver's disk, a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fluxloom-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later stages survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row of ``df`` takes about: 8 per number, the length of texts, the sum over arrays, maps and structs."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
                return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 8
            return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda s, x: s + of(x, kind.elementType)), F.lit(8).cast("long"))
        if isinstance(kind, T.MapType):
            return of(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        return F.lit(8).cast("long")

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8).cast("long"))


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint when it is measured to hold at most ``max_rows`` rows and ``max_bytes`` bytes.

    Reading stops at ``max_rows + 1`` rows; beyond a bound ``df`` is left as it is and the join is a shuffle, which
    AQE splits where it is skewed. Pass a table or something already written (``cut``), as it is read once more here.
    """
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes else df
