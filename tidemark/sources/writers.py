"""Writers for feature tables, collected samples, study exports and small JSON documents."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BASE_FEATURES, FeatureConfig

# Metadata columns in front of a feature table.
METADATA = ["user_id", "task", "video", "label", "role", "t_start_s", "t_end_s"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the cluster's checkpoint folder.

    A session of one machine (tests) that names none gets a temporary folder; any other gets an error, because its
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, for results that several later steps read.

    Cuts the lineage in storage that survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def feature_rows(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Columns in sink order: metadata, model features, monitoring. Absent ones get '' or 0."""
    monitoring = [c for c in config.monitoring_features if c in df.columns]
    return df.select(
        *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in METADATA],
        *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in config.model_features],
        *monitoring,
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, doubled quotes, and empty fields for NULL and empty text."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_features(df: DataFrame, path: str, config: FeatureConfig = FeatureConfig(), fmt: str = "parquet") -> None:
    rows = feature_rows(df, config)
    if fmt == "csv":
        write_csv(rows, path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def collected_rows(samples: DataFrame, features: Sequence[str] = tuple(BASE_FEATURES)) -> DataFrame:
    """Training rows from collected samples (participant and sample columns, ``features`` as a map)."""
    return samples.select(
        F.col("participant_id").alias("user_id"),
        "timestamp",
        "window_index",
        F.when(F.col("label") == "high", 1).otherwise(0).alias("label"),
        "difficulty",
        "task_type",
        *[F.coalesce(F.try_element_at("features", F.lit(f)), F.lit(0.0)).alias(f) for f in features],
        F.lit("train").alias("role"),
    )


def flatten_collected(requests: DataFrame) -> DataFrame:
    """One row per sample of collection requests; a request without samples gives none."""
    return requests.select("participant_id", "session_notes", F.explode("samples").alias("s")).select(
        "participant_id", "session_notes", "s.*"
    )


def collected_counts(samples: DataFrame, keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Counts that accompany a collection: all samples, by label and by difficulty."""

    def count_of(column: str, value: str):
        return F.count(F.when(F.col(column) == value, 1)).alias(value)

    return samples.groupBy(*keys).agg(
        F.count("*").alias("total_samples"),
        *[count_of("label", v) for v in ("low", "high")],
        *[count_of("difficulty", v) for v in ("easy", "medium", "hard")],
    )


def write_export(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table of a study export as CSV below ``path``."""
    for name, table in tables.items():
        write_csv(table, os.path.join(path, name))


def write_bundles(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Participant packages as JSON lines, in buckets by participant: a package lies in one file, files stay few."""
    bucket = F.pmod(F.xxhash64("participant_id"), F.lit(buckets))
    dealt = rows.withColumn("bucket", bucket).repartition(F.col("bucket")).sortWithinPartitions("bucket", "participant_id")
    dealt.write.mode("overwrite").partitionBy("bucket").json(path)


def write_json(spark: SparkSession, data: Any, path: str) -> None:
    """A small JSON document as a single text file."""
    text = json.dumps(data, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
