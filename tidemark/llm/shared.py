"""Intermediate tables in the shared folder, and a per-process store for Python workers."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the session is gone; nothing can be removed any more
            return


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local session without it (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    if not _written:
        atexit.register(_remove_written)
    path = os.path.join(base, f"llm-{name}-{os.urandom(8).hex()}")
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps survive lost executors without redoing it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(path)


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python process, across the tasks a worker runs."""
    module = sys.modules.setdefault("_tidemark_worker_store", types.ModuleType("_tidemark_worker_store"))
    return module.__dict__.setdefault(name, {})
