"""Helpers that several corpus operators use: the shared folder, materialised tables, table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where a local session has no such setting (a test) is a folder made and set here.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for a table that no later plan reads."""
    path = getattr(df, "_tramline_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_STATE: dict = {}


def worker_state(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under ``key``. Only the last key's is kept: workers outlive stages, and
    what an operator has remembered must not take the memory of the next one."""
    if key not in _STATE:
        _STATE.clear()
        pa.default_memory_pool().release_unused()
        _STATE[key] = make()
    return _STATE[key]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def ascii_lower(col):
    """A-Z to a-z, all else unchanged. ``lower`` does just that where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))
