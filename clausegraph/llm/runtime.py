"""Shared helpers of the training-data operators: durable lineage cuts, table reading, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast explicitly; larger sides are left to shuffled joins and AQE.
BROADCAST_ROWS = 100_000


_held: dict = {}


def held(key: tuple, build: Callable[[], Any]) -> Any:
    """The one model that a Python worker keeps between tasks; asking for another drops it."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Drop the kept model; for tasks that bring large tables of their own."""
    _held.clear()


def trim() -> None:
    """Give freed memory back to the system where the C library can (a worker that is used again would keep it)."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or an own temporary one where it is unset and
    driver and executors are one process. On a cluster an unset one is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="clausegraph-")
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut lineage, so that lost executors cost only a re-read."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Materialise as Parquet in the shared folder (columns can be pruned on each re-read); removed when Spark ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only if the counted rows are few; beyond that Spark's shuffled join (with skew handling) stays."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def apart(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column outside ``own`` under a name that no operator uses, and the expressions that give the
    columns of ``docs`` back, in order."""
    names = {c: c if c in own else f"_kept{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(own_name).alias(c) for c, own_name in names.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text (crc 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0).cast("long"))
