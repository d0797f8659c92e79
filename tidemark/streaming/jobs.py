"""Running streams to the end of what is available, with results in idempotent batch folders."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.writers import collected_counts, collected_rows, flatten_collected, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """The state store that keyed list and value states need, for the streams started inside.

    ``partitions`` is the number of state partitions: it is fixed when a stream first starts, so it should
    fit the cores that will run the stream rather than the session's batch shuffles.
    """
    wanted = {PROVIDER: ROCKSDB}
    if partitions is not None:
        wanted[PARTITIONS] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_available(
    stream: DataFrame,
    name: str,
    each: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Process all available input and return the written result.

    ``each`` turns a micro-batch into the rows to keep. A batch is written to a folder of its own number,
    so a repeated batch replaces itself. State is spread over ``partitions``, by default one per core.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    with state_store(spark, partitions or spark.sparkContext.defaultParallelism):
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")


def stream_table(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream.

    The keyed operators order rows inside a micro-batch and take batches as they come. Set ``files_per_trigger`` only
    for files that follow each other in time; without it all files that are there make one batch, in any order.
    """
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def replay_files(df: DataFrame, received: str, path: str, files: int = 5, silence_s: float = 1e6) -> DataFrame:
    """A table as a stream of files that arrive one a micro-batch, in the order of ``received`` (seconds).

    Inside a file rows stand in any order. A last file of one row, all NULL but for ``received``, moves the clock by
    ``silence_s``, as a source does that goes on after these sessions. Files are told apart by their times, which are set here.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, received).write.parquet(path)
    # The written rows are read, which costs less than to work ``df`` out again.
    end = spark.read.schema(df.schema).parquet(path).agg((F.max(received) + F.lit(silence_s)).alias(received))
    blank = [(F.col(received) if c == received else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes]
    # One row behind the last time of receipt.
    end.select(*blank).write.mode("append").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    # The parts of the table bear the numbers of their ranges; the row behind them was written in a second job.
    newest = max(found, key=lambda f: f.getModificationTime()).getPath().toString()
    names = sorted((f.getPath().toString() for f in found if f.getPath().toString() != newest)) + [newest]
    first = min(f.getModificationTime() for f in found) - 1000 * len(names)
    for i, name in enumerate(names):
        system.setTimes(hadoop.Path(name), first + 1000 * i, -1)
    return stream_table(spark, path, df.schema, files_per_trigger=1)


def ingest_collected(requests: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows and their counts per participant from a stream of collection requests."""
    spark = requests.sparkSession
    path = path or shared_folder(spark, "collected")
    samples = run_available(requests, "collected", flatten_collected, path)
    return collected_rows(samples), collected_counts(samples)


def frame_counts(frames: DataFrame, at: str = "at", interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Frames per tumbling interval of a stream; rows later than ``late`` behind the newest are left out."""
    return (
        frames.withWatermark(at, late)
        .groupBy("session_id", F.window(at, interval).alias("w"))
        .agg(F.count("*").alias("frames"))
        .select("session_id", F.col("w.start").alias("start"), "frames")
    )
