"""Upserts of session records from a stream into versioned snapshots of buckets.

A record is a draft until a final write of it arrives. The rows of a micro-batch are merged with the last snapshot of the
buckets they touch, other buckets are not read, and the result is written as that batch's version of these buckets. A version is
made from older versions only and replaces itself, so a batch that is run again gives the same table. Readers see versions up to
the last finished batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.sequence import latest_per_key
from tidemark.schemas import require_columns

BUCKET, VERSION = "_bucket", "_version"


def current_records(writes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """The row that counts of each record: of its final writes the one with the highest ``write_seq``, else its newest draft.

    The order of the writes does not matter, and merging parts first gives the same.
    """
    final = F.col("kind") == "final"
    others = [c for c in writes.columns if c not in keys]
    order = [F.desc(final), F.desc_nulls_last(F.when(final, F.col("write_seq"))), F.desc_nulls_last("saved_at"), F.xxhash64(*others)]
    return latest_per_key(writes, keys, order)


class Snapshots:
    """A table of records below ``path``, with columns record_id, kind (draft or final), saved_at, write_seq and any others."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _folders(self, parent: str, prefix: str) -> list[tuple[int, str]]:
        """(number, path) of the folders ``<prefix>=<number>`` in a folder."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(parent)
        system = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not system.exists(folder):
            return []
        found = [f.getPath() for f in system.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith(f"{prefix}=")]
        return [(int(p.getName().split("=")[1]), p.toString()) for p in found]

    def _latest(self, below: int) -> dict[int, str]:
        """Per bucket the folder of its newest version below a number."""
        out = {}
        for bucket, folder in self._folders(f"{self.path}/rows", BUCKET):
            versions = [v for v in self._folders(folder, VERSION) if v[0] < below]
            if versions:
                out[bucket] = max(versions)[1]
        return out

    def _read(self, folders: Sequence[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge the writes of micro-batch ``number``; writes without a record id are left out."""
        names = self.schema.names
        bucket = F.pmod(F.xxhash64("record_id"), F.lit(self.buckets)).cast("int")
        rows = require_columns(batch, names, "writes").select(*names).where(F.col("record_id").isNotNull())
        rows = current_records(rows)
        # At most one number a bucket.
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}
        if touched:
            before = self._read([folder for b, folder in self._latest(number).items() if b in touched])
            merged = current_records(before.unionByName(rows)).withColumns({BUCKET: bucket, VERSION: F.lit(number)})
            (
                merged.repartition(F.col(BUCKET))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(BUCKET, VERSION)
                .parquet(f"{self.path}/rows")
            )
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={number}")

    def read(self) -> DataFrame:
        """All records as of the last finished batch."""
        done = [n for n, _ in self._folders(f"{self.path}/done", "batch")]
        return self._read(list(self._latest(max(done) + 1).values()) if done else [])


def upsert_records(writes: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Merge all available writes of a stream and return the records."""
    table = Snapshots(writes.sparkSession, f"{path}/table", writes.schema, buckets)
    query = (
        writes.writeStream.foreachBatch(table.merge)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
