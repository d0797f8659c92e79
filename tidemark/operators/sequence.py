"""Ordered operators over long sequences that never hold one whole sequence in one task.

A sequence (all rows of one user, recording or session) may be a third of the data. Every operator
here therefore cuts a sequence into chunks derived from the data itself, works inside the chunks, and
carries what crosses a chunk border in one of two ways: by copying a few border rows into the
neighbour (``with_halo``) or by a summary row per chunk (``with_index``, ``with_previous``).
Chunk keys are plain expressions of the row, so a recomputed task gives the same chunks again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import decay_span

CHUNK = "_chunk"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on columns of the same name. A NULL key matches nothing; a left join keeps its rows."""
    return left.join(right, list(keys), how)


def time_chunk(ts: Column | str, seconds: int) -> Column:
    """Chunk number of a timestamp. A device's sampling rate bounds the rows of one chunk."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))


def number_chunk(c: Column | str, size: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size)))


def with_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "frame_idx"
) -> DataFrame:
    """0-based row number per key in the given order.

    ``chunk`` must not decrease along the order. Each chunk gets a head row with the number of rows in
    the earlier chunks (summed over one small row per chunk), so counting starts there. The rows
    themselves are shuffled once.
    """
    part = [*keys, CHUNK]
    rows = df.withColumn(CHUNK, chunk)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*part).agg(F.count("*").alias("_size"))
    heads = sizes.select(*part, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"), F.lit(1).alias("_head"))
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    along = Window.partitionBy(*part).orderBy(F.desc("_head"), *order)
    # The head is row 1 of its chunk, the first real row is row 2.
    number = F.first("_offset").over(along) + F.row_number().over(along) - 2
    return both.withColumn(name, number).where("_head = 0").drop("_head", "_offset", CHUNK)


def with_halo(df: DataFrame, idx: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut a 0-based index into chunks of ``size`` rows and copy border rows to the neighbours.

    Adds the chunk number and ``_own``, false for a copy. Chunk ``c`` sees the indices from
    ``c * size - before`` to ``(c + 1) * size - 1 + after``.
    """
    i, width = F.col(idx), F.lit(float(size))
    first = F.floor(F.greatest(i - after, F.lit(0)) / width)
    last = F.floor((i + before) / width)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        "_own", F.floor(i / width) == F.col(CHUNK)
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: Sequence[str], name: str = "_prev"
) -> DataFrame:
    """Struct of the previous row's ``columns`` along the order, NULL on the first row of a key.

    The last row of every chunk is put as a head row in front of the next chunk of its key.
    """
    part = [*keys, CHUNK]
    rows = df.withColumns({CHUNK: chunk, "_now": F.struct(*columns)})
    tails = rows.groupBy(*part).agg(F.max(F.struct(*order, "_now")).alias("_tail"))
    heads = tails.select(
        *keys,
        F.lead(CHUNK).over(Window.partitionBy(*keys).orderBy(CHUNK)).alias(CHUNK),
        F.col("_tail._now").alias("_now"),
        F.lit(1).alias("_head"),
    ).where(F.col(CHUNK).isNotNull())
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    along = Window.partitionBy(*part).orderBy(F.desc("_head"), *order)
    return both.withColumn(name, F.lag("_now").over(along)).where("_head = 0").drop("_head", "_now", CHUNK)


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    alpha: float,
    start: float,
    name: str,
) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y_previous along a 0-based index, beginning at ``start``.

    The recursion is unrolled into a weighted sum. After ``span`` rows a weight is below 1e-40, far under
    double precision, so a chunk needs that many rows of history from its neighbour and no more. The
    weights inside a chunk stay within the range of a double. ``value`` must not be NULL.
    """
    span = decay_span(alpha)
    size = 4 * span
    decay = F.lit(1.0 - alpha)
    rows = with_halo(df, idx, size, before=span)
    place = F.col(idx) - F.col(CHUNK) * size + span
    so_far = (
        Window.partitionBy(*keys, CHUNK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    )
    weighted = F.sum(F.col(value) * F.pow(decay, -place)).over(so_far)
    initial = F.when(F.col(CHUNK) == 0, F.pow(decay, F.col(idx) + 1) * F.lit(start)).otherwise(0.0)
    return (
        rows.withColumn(name, F.lit(alpha) * F.pow(decay, place) * weighted + initial)
        .where("_own")
        .drop("_own", CHUNK)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write per key. Spark keeps only the best row per key on the map side (rank limit)."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
