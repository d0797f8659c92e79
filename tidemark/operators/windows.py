"""Overlapping windows over an index, short-gap filling and the window quality gate.

Frame ``i`` lies in the windows ``ceil((i - L + 1) / P) .. floor(i / P)``. Exploding frames to windows
*before* the shuffle would send every frame L / P times. Instead neighbouring windows share one chunk:
a frame is sent once (twice near a chunk border), all windows of a chunk are built inside the same
task, and the later ``groupBy(keys, chunk, window)`` needs no exchange of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import CHUNK

WINDOW = "window_idx"
BRIDGED = "_bridge"

# Frame columns that are filled over a short gap. Pitch and yaw are not among them.
INTERPOLATED = (
    "ear_left",
    "ear_right",
    "ear_mean",
    "brightness",
    "eye_center_x",
    "eye_center_y",
    "mouth_mar",
    "roll",
)


def first_window(i: Column, length: int, step: int) -> Column:
    """Lowest window that holds frame ``i``."""
    return F.greatest(F.lit(0), F.ceil((i - (length - 1)) / F.lit(float(step)))).cast("bigint")


def last_window(i: Column, step: int) -> Column:
    return F.floor(i / F.lit(float(step))).cast("bigint")


def window_chunks(
    df: DataFrame, idx: str, length: int, step: int, windows_per_chunk: int = 64, pad: int = 0
) -> DataFrame:
    """Copy every frame to the chunks whose windows (widened by ``pad`` frames) contain it."""
    i, per = F.col(idx), F.lit(float(windows_per_chunk))
    first = F.floor(first_window(F.greatest(i - pad, F.lit(0)), length, step) / per)
    last = F.floor(last_window(i + pad, step) / per)
    targets = F.when(first <= last, F.sequence(first, last))
    return df.withColumn(CHUNK, F.explode(targets))


def explode_windows(
    chunked: DataFrame, idx: str, length: int, step: int, windows_per_chunk: int = 64
) -> DataFrame:
    """One row per frame and window, restricted to the windows of the row's own chunk."""
    i = F.col(idx)
    low = F.greatest(first_window(i, length, step), F.col(CHUNK) * windows_per_chunk)
    high = F.least(last_window(i, step), F.col(CHUNK) * windows_per_chunk + (windows_per_chunk - 1))
    return chunked.withColumn(WINDOW, F.explode(F.when(low <= high, F.sequence(low, high))))


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    length: int,
    step: int,
    aggregates: Sequence[Column],
    windows_per_chunk: int = 64,
) -> DataFrame:
    """Aggregate full windows of ``length`` rows every ``step`` rows; partial windows do not exist."""
    rows = window_chunks(df, idx, length, step, windows_per_chunk)
    # The explicit exchange comes before the explode, so frames travel once.
    rows = rows.repartition(*keys, CHUNK)
    return (
        explode_windows(rows, idx, length, step, windows_per_chunk)
        .groupBy(*keys, CHUNK, WINDOW)
        .agg(F.count("*").alias("_n"), *aggregates)
        .where(F.col("_n") == length)
        .drop("_n", CHUNK)
    )


def window_bounds(length: int, step: int, rate: float) -> tuple[Column, Column]:
    """Start and end second of a window."""
    start = F.col(WINDOW) * step
    return (start / F.lit(rate)).alias("t_start_s"), ((start + length) / F.lit(rate)).alias("t_end_s")


def window_stats(value: Column, prefix: str = "") -> list[Column]:
    """Mean, population deviation, extremes and median; 0 where the window holds no value."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(value), zero).alias(f"{prefix}mean"),
        F.coalesce(F.stddev_pop(value), zero).alias(f"{prefix}std"),
        F.coalesce(F.min(value), zero).alias(f"{prefix}min"),
        F.coalesce(F.max(value), zero).alias(f"{prefix}max"),
        F.coalesce(F.median(value), zero).alias(f"{prefix}median"),
    ]


def fill_short_gaps(
    chunked: DataFrame,
    part: Sequence[str],
    idx: str,
    max_gap: int,
    fields: Sequence[str] = INTERPOLATED,
) -> DataFrame:
    """Fill runs of at most ``max_gap`` invalid frames linearly between their valid neighbours.

    Both neighbours of such a run lie within ``max_gap`` rows, so the frame is bounded and ``chunked``
    only needs that many rows beyond its borders. Filled frames become valid with the lower quality.
    """
    fields = [f for f in fields if f in chunked.columns]
    valid = F.coalesce(F.col("valid"), F.lit(False))
    order = Window.partitionBy(*part).orderBy(idx)
    known = F.when(valid, F.struct(F.col(idx).alias("at"), F.col("quality").alias("quality"), *fields))
    rows = chunked.withColumn(BRIDGED, known).withColumns(
        {
            "_left": F.last(BRIDGED, ignorenulls=True).over(order.rowsBetween(-max_gap, -1)),
            "_right": F.first(BRIDGED, ignorenulls=True).over(order.rowsBetween(1, max_gap)),
        }
    )
    gap = F.col("_right.at") - F.col("_left.at") - 1
    bridged = ~valid & F.coalesce(gap <= max_gap, F.lit(False))
    share = (F.col(idx) - F.col("_left.at")) / (gap + 1)
    filled = {
        f: F.when(F.col("_fill"), (1 - F.col("_share")) * F.col(f"_left.{f}") + F.col("_share") * F.col(f"_right.{f}"))
        .otherwise(F.col(f))
        for f in fields
    }
    filled["quality"] = F.when(
        F.col("_fill"), F.least(F.col("_left.quality"), F.col("_right.quality"))
    ).otherwise(F.col("quality"))
    filled["valid"] = F.col("_fill") | valid
    return (
        rows.withColumns({"_fill": bridged, "_share": share})
        .withColumns(filled)
        .drop("_left", "_right", "_fill", "_share", BRIDGED)
    )


def interpolate_gaps(
    frames: DataFrame,
    keys: Sequence[str],
    max_gap: int = 3,
    idx: str = "frame_idx",
    chunk_rows: int = 16384,
    fields: Sequence[str] = INTERPOLATED,
) -> DataFrame:
    """Gap filling on its own, over a frame table that is cut into chunks with a narrow halo."""
    from tidemark.operators.sequence import with_halo

    rows = with_halo(frames, idx, chunk_rows, before=max_gap, after=max_gap)
    return fill_short_gaps(rows, [*keys, CHUNK], idx, max_gap, fields).where("_own").drop("_own", CHUNK)


def quality_gate(valid_frames: Column, frames: Column, max_bad_ratio: float) -> tuple[Column, Column]:
    """(passes, bad ratio) of a window; an empty window fails with ratio 1."""
    bad = F.when(frames > 0, (frames - valid_frames) / frames).otherwise(F.lit(1.0))
    return (frames > 0) & (bad <= max_bad_ratio), bad
