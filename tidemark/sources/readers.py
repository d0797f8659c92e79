"""Readers for manifests, feature tables, signal recordings, labels and study records."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark import schemas
from tidemark.functions.numeric import finite
from tidemark.functions.text import file_stem, split_subject_task, task_of_video
from tidemark.operators.sequence import key_join, with_index
from tidemark.schemas import require_columns

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred from the data."""
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Video manifest; raises when a required column is absent. Optional columns become NULL."""
    df = require_columns(read_csv(spark, path), schemas.MANIFEST_REQUIRED, "manifest")
    for optional in ("task", "notes"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    return df


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` manifest rows in a stated order; 0 keeps all."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Feature table from parquet or CSV. Numbers are doubles, ids are text, NaN becomes NULL."""
    if path.rstrip("/").endswith(".csv"):
        df = read_csv(spark, path)
        text = {"user_id", "task", "video", "label", "role"}
        df = df.select(
            *[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in df.columns]
        )
    else:
        df = spark.read.parquet(path)
    doubles = {n for n, t in df.dtypes if t == "double"}
    df = df.select(*[finite(c).alias(c) if c in doubles else F.col(c) for c in df.columns])
    if "task" not in df.columns and "video" in df.columns:
        df = df.withColumn("task", task_of_video("video"))
    return require_columns(df, columns or [], "features")


def _recording(path: Column) -> tuple[Column, Column]:
    """Participant (directory) and task (file stem without the participant prefix) of a recording."""
    participant = F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    stem = F.url_decode(file_stem(path))
    prefix = F.concat(participant, F.lit("_"))
    task = F.when(F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1))
    return participant, task


def find_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Recordings below ``root``: ``<participant>/<participant>_<task>.txt``, hidden folders left out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .load(root)
        .select("path", "length")
    )
    participant, task = _recording(F.col("path"))
    return files.select("path", "length", participant.alias("user_id"), task.alias("task")).where(
        F.col("task").isNotNull() & ~F.startswith("user_id", F.lit("."))
    )


def _recording_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(lines, headers) of all text recordings below ``root``; lines carry their number in the file and what stands before it.

    Lines are numbered inside each file block and the sizes of the earlier blocks are added. A file of any size is read by as
    many tasks as it has blocks. Blank lines do not count.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(root)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("_at", F.monotonically_increasing_id())
        .where(F.length(F.trim("line")) > 0)
    )
    numbered = with_index(lines, ["path"], ["block", "_at"], F.col("block"), "_line")
    header = numbered.where("_line = 0").select("path", F.split("line", r"\s*,\s*").alias("names"))
    place = {s: F.array_position("names", s) for s in schemas.PHYSIO_SIGNALS}
    headers = header.select(
        "path",
        *[p.alias(f"_p_{s}") for s, p in place.items()],
        F.array_join("names", ",").alias("found"),
    )
    return numbered, headers


def _is_complete() -> Column:
    return (F.col("_p_ECG") > 0) & (F.col("_p_EDA") > 0) & (F.col("_p_RR") > 0)


def _cell(signal: str) -> Column:
    return F.get(F.split("line", ","), (F.col(f"_p_{signal}") - 1).cast("int"))


def _is_recording() -> Column:
    return F.col("task").isNotNull() & ~F.startswith("user_id", F.lit("."))


def read_recordings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected files) of all text recordings below ``root``.

    The row order inside a file is the time axis, so it is made explicit. A file without the three signal columns is
    rejected and the rest goes on; a cell that holds no finite number is NULL, and ``recording_faults`` says why.
    """
    numbered, headers = _recording_lines(spark, root)
    participant, task = _recording(F.col("path"))
    samples = (
        key_join(numbered.where("_line > 0"), headers.where(_is_complete()), ["path"])
        .select(
            participant.alias("user_id"),
            task.alias("task"),
            (F.col("_line") - 1).alias("sample_idx"),
            *[finite(_cell(s).try_cast("double")).alias(s) for s in schemas.PHYSIO_SIGNALS],
        )
        .where(_is_recording())
    )
    rejected = headers.where(~_is_complete()).select("path", "found")
    return samples, rejected


def recording_faults(spark: SparkSession, root: str) -> DataFrame:
    """Why cells of recordings are NULL, and why files are rejected: path, user_id, task, line, column, value, reason.

    ``line`` counts the lines that are not blank, the header being line 0. Reasons are ``missing column`` (of a file),
    ``missing cell``, ``empty cell``, ``no number`` and ``not finite``. Files that are no recordings are left out.
    """
    numbered, headers = _recording_lines(spark, root)
    participant, task = _recording(F.col("path"))

    def fault(signal: str) -> Column:
        cell = _cell(signal)
        number = cell.try_cast("double")
        reason = (
            F.when(cell.isNull(), "missing cell")
            .when(F.length(F.trim(cell)) == 0, "empty cell")
            .when(number.isNull(), "no number")
            .when(finite(number).isNull(), "not finite")
        )
        return F.struct(F.lit(signal).alias("column"), cell.alias("value"), reason.alias("reason"))

    def absent(signal: str) -> Column:
        reason = F.when(F.coalesce(F.col(f"_p_{signal}"), F.lit(0)) == 0, "missing column")
        return F.struct(F.lit(signal).alias("column"), F.lit(None).cast("string").alias("value"), reason.alias("reason"))

    cells = key_join(numbered.where("_line > 0"), headers.where(_is_complete()), ["path"])
    found = cells.select("path", F.col("_line").alias("line"), F.explode(F.array(*[fault(s) for s in schemas.PHYSIO_SIGNALS])).alias("f"))
    files = headers.where(~_is_complete()).select(
        "path", F.lit(0).cast("bigint").alias("line"), F.explode(F.array(*[absent(s) for s in schemas.PHYSIO_SIGNALS])).alias("f")
    )
    both = found.unionByName(files).where(F.col("f.reason").isNotNull())
    return both.select("path", participant.alias("user_id"), task.alias("task"), "line", "f.*").where(_is_recording())


def read_binary_labels(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(read_csv(spark, path), ["subject/task", "binary-stress"], "labels")
    return split_labels(df.withColumnsRenamed({"subject/task": "subject_task", "binary-stress": "binary_stress"})).withColumn(
        "binary_stress", F.col("binary_stress").cast("int")
    )


def split_labels(df: DataFrame, key: str = "subject_task", label: str = "binary_stress") -> DataFrame:
    user, task = split_subject_task(key)
    return df.select(user.alias("user_id"), task.alias("task"), F.col(label).alias("binary_stress"))


def parse_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Structs from JSON text; text that is no valid record is dropped."""
    fields = StructType.fromDDL(schema).fields + [StructField(CORRUPT, StringType())]
    parsed = F.from_json(column, StructType(fields), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (
        df.withColumn("_record", parsed)
        .where(F.col("_record").isNotNull() & F.col(f"_record.{CORRUPT}").isNull())
        .select(*df.columns, F.col("_record").dropFields(CORRUPT).alias("record"))
    )


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested records from JSON lines; broken lines are dropped."""
    return parse_records(spark.read.text(path), "value", schema).select("record.*")


def read_json(spark: SparkSession, path: str) -> Any:
    """A small JSON document (model specification, report) from any file system Spark can reach."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
