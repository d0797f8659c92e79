"""Window features of a frame table: blinks, closure, geometry, motion, brightness and quality.

The whole chain (gap filling, run detection, windows, gate) runs behind a single exchange. Runs of
closed eyes are found once per chunk; a window then counts the runs that end inside it and re-measures
only the one run that may reach back over its left border. No per-window sort is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.numeric import finite
from tidemark.operators.sequence import CHUNK, key_join
from tidemark.operators.windows import (
    WINDOW,
    explode_windows,
    fill_short_gaps,
    quality_gate,
    window_bounds,
    window_chunks,
)

SESSION = ("user_id", "task")


def mark_frames(rows: DataFrame, part: Sequence[str], idx: str, config: FeatureConfig) -> DataFrame:
    """Annotate valid frames with their rank, closed-eye runs and movement steps."""
    order = Window.partitionBy(*part).orderBy(idx)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.coalesce(F.col("valid"), F.lit(False))
    ear = finite("ear_mean")
    closed = F.when(valid, ear < config.ear_threshold)
    center = F.when(
        valid, F.struct(F.col(idx).alias("at"), F.col("eye_center_x").alias("x"), F.col("eye_center_y").alias("y"))
    )
    return (
        rows.withColumns({"valid": valid, "ear_mean": ear, "_closed": closed, "_center": center})
        .withColumns(
            {
                "_rank": F.sum(F.col("valid").cast("bigint")).over(upto),
                "_was_closed": F.coalesce(
                    F.last("_closed", ignorenulls=True).over(before), F.lit(False)
                ),
                "_from": F.lag("_center").over(order),
            }
        )
        .withColumn(
            "_start",
            F.when(F.col("_closed") & ~F.col("_was_closed"), F.struct(F.col("_rank").alias("rank"), F.col(idx).alias("at"))),
        )
        .withColumn("_start", F.last("_start", ignorenulls=True).over(upto))
        .withColumns(
            {
                # Set on the first open frame behind a closed run.
                "_run": F.when(~F.col("_closed") & F.col("_was_closed"), F.col("_rank") - F.col("_start.rank")),
                "_run_at": F.col("_start.at"),
                "_move": F.when(
                    F.col("valid") & (F.col("_from.at") == F.col(idx) - 1),
                    finite(
                        F.sqrt(
                            F.pow(F.col("eye_center_x") - F.col("_from.x"), 2)
                            + F.pow(F.col("eye_center_y") - F.col("_from.y"), 2)
                        )
                        * F.lit(config.fps)
                    ),
                ),
            }
        )
        .drop("_start", "_was_closed", "_center", "_from")
    )


def _blink_aggregates(config: FeatureConfig, idx: str) -> list[Column]:
    start = F.col(WINDOW) * config.step
    kept = F.col("_run").between(config.min_blink_frames, config.max_blink_frames)
    inside = F.when(F.col("_run_at") >= start, F.when(kept, F.col("_run")))
    return [
        F.count(inside).alias("_runs"),
        F.coalesce(F.sum(inside), F.lit(0)).alias("_run_frames"),
        F.min(F.when(F.col("_closed"), F.col("_rank"))).alias("_first_closed"),
        F.max(F.when(F.col("_run").isNotNull() & (F.col("_run_at") < start), F.col("_rank"))).alias("_cut_end"),
    ]


def _frame_aggregates(config: FeatureConfig, idx: str) -> list[Column]:
    valid = F.col("valid")

    def of_valid(c: Column) -> Column:
        return F.when(valid, c)

    aggs = [F.count("*").alias("_n"), F.count(of_valid(F.lit(1))).alias("_valid")]
    if config.blinks:
        aggs += _blink_aggregates(config, idx)
        aggs.append(F.stddev_pop(of_valid(F.when(F.col("ear_mean") > 0, F.col("ear_mean")))).alias("ear_std"))
    if config.perclos:
        aggs.append(F.count(F.when(F.col("_closed"), 1)).alias("_closed_frames"))
    if config.brightness:
        aggs += [
            F.avg(of_valid(F.col("brightness"))).alias("mean_brightness"),
            F.stddev_pop(of_valid(F.col("brightness"))).alias("std_brightness"),
        ]
    aggs.append(F.avg(of_valid(F.col("quality"))).alias("mean_quality"))
    if config.geometry:
        inner = F.when(F.col(idx) > F.col(WINDOW) * config.step, F.col("_move"))
        mouth = of_valid(finite("mouth_mar"))
        aggs += [
            F.avg(mouth).alias("mouth_open_mean"),
            F.stddev_pop(mouth).alias("mouth_open_std"),
            *[F.stddev_pop(of_valid(finite(c))).alias(f"{c}_std") for c in ("roll", "pitch", "yaw")],
            F.avg(inner).alias("motion_mean"),
            F.stddev_pop(inner).alias("motion_std"),
        ]
    return aggs


def finished_features(config: FeatureConfig) -> dict[str, Column]:
    """Final feature values: NULL throughout for a window without valid frames, else 0 for 'none'."""
    some = F.col("_valid") > 0

    def value(c: Column) -> Column:
        return F.when(some, F.coalesce(c, F.lit(0.0)))

    out: dict[str, Column] = {}
    if config.blinks:
        cut = F.col("_cut_end") - F.col("_first_closed")
        cut = F.when(cut.between(max(config.min_blink_frames, 1), config.max_blink_frames), cut)
        runs = F.col("_runs") + F.when(cut.isNotNull(), 1).otherwise(0)
        frames = F.col("_run_frames") + F.coalesce(cut, F.lit(0))
        minutes = F.col("_valid") / F.lit(config.fps) / F.lit(60.0)
        out["blink_rate"] = F.when(some, runs / minutes)
        out["blink_count"] = F.when(some, runs.cast("double"))
        out["mean_blink_duration"] = F.when(
            some, F.when(runs > 0, frames / runs / F.lit(config.fps) * 1000).otherwise(F.lit(0.0))
        )
        out["ear_std"] = value(F.col("ear_std"))
    if config.perclos:
        out["perclos"] = F.when(some, F.col("_closed_frames") / F.col("_valid"))
    for name in config.monitoring_features:
        if name != "valid_frame_ratio":
            out[name] = F.when(some, F.col(name))
    out["valid_frame_ratio"] = F.when(some, F.col("_valid") / F.col("_n"))
    if config.geometry:
        for name in config.model_features:
            if name not in out:
                out[name] = value(F.col(name))
    return out


def window_features(
    frames: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    keys: Sequence[str] = SESSION,
    idx: str = "frame_idx",
    gate: bool = True,
) -> DataFrame:
    """All features of all full windows, one exchange from frames to windows.

    ``frames`` holds one row per frame with a dense 0-based index per key. With ``gate`` the windows
    above the allowed share of bad frames are left out.
    """
    part = [*keys, CHUNK]
    length, step, per = config.length, config.step, config.windows_per_chunk
    rows = window_chunks(frames, idx, length, step, per, pad=config.max_gap)
    if config.max_gap > 0:
        rows = fill_short_gaps(rows, part, idx, config.max_gap)
        # Padding rows beyond the chunk have done their part.
        low = F.col(CHUNK) * per * step
        high = low + (per - 1) * step + length
        rows = rows.where((F.col(idx) >= low) & (F.col(idx) < high))
    marked = mark_frames(rows, part, idx, config)
    windows = (
        explode_windows(marked, idx, length, step, per)
        .groupBy(*part, WINDOW)
        .agg(*_frame_aggregates(config, idx))
        .where(F.col("_n") == length)
    )
    passes, bad = quality_gate(F.col("_valid"), F.col("_n"), config.max_bad_ratio)
    if gate:
        windows = windows.where(passes)
    t_start, t_end = window_bounds(length, step, config.fps)
    values = finished_features(config)
    ordered = [*config.model_features, *config.monitoring_features]
    return windows.select(
        *keys, WINDOW, t_start, t_end, bad.alias("bad_ratio"), *[values[n].alias(n) for n in ordered]
    )


def features_of_cut_windows(
    rows: DataFrame, config: FeatureConfig, keys: Sequence[str], place: str = "place"
) -> DataFrame:
    """The same features for frames that already carry their window: one group of rows per window.

    ``keys`` identify a window, ``place`` is the 0-based position inside it. Windows of any size count.
    """
    marked = mark_frames(rows, list(keys), place, config).withColumn(WINDOW, F.lit(0))
    windows = marked.groupBy(*keys).agg(*_frame_aggregates(config, place), F.max(WINDOW).alias(WINDOW))
    _, bad = quality_gate(F.col("_valid"), F.col("_n"), config.max_bad_ratio)
    values = finished_features(config)
    ordered = [*config.model_features, *config.monitoring_features]
    return windows.select(*keys, bad.alias("bad_ratio"), *[values[n].alias(n) for n in ordered])


def blink_runs(
    frames: DataFrame,
    config: FeatureConfig,
    keys: Sequence[str] = SESSION,
    idx: str = "frame_idx",
    chunk_rows: int = 16384,
) -> DataFrame:
    """Accepted closed-eye runs of whole recordings: start and end frame, length in valid frames.

    A run that is longer than the limit is rejected whatever its start, so a halo of ``max + 1`` measured
    frames before a chunk decides every run that ends in it. A valid frame without a measurement counts
    for the length of a run but neither starts nor ends one.
    """
    from tidemark.operators.sequence import number_chunk, with_halo, with_index

    chunk = number_chunk(idx, chunk_rows)
    valid = frames.where(F.coalesce(F.col("valid"), F.lit(False)))
    ranked = with_index(valid, keys, [idx], chunk, "_rank")
    measured = ranked.withColumn("ear_mean", finite("ear_mean")).where(F.col("ear_mean").isNotNull())
    measured = with_index(measured, keys, [idx], chunk, "_seq")
    longest = config.max_blink_frames
    rows = with_halo(measured, "_seq", chunk_rows, before=longest + 1)
    order = Window.partitionBy(*keys, CHUNK).orderBy("_seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        rows.withColumn("_closed", F.col("ear_mean") < config.ear_threshold)
        .withColumn("_was_closed", F.coalesce(F.lag("_closed").over(order), F.lit(False)))
        .withColumn(
            "_start",
            F.when(F.col("_closed") & ~F.col("_was_closed"), F.struct(F.col("_rank").alias("rank"), F.col(idx).alias("at"))),
        )
        .withColumn("_start", F.last("_start", ignorenulls=True).over(upto))
    )
    run = F.col("_rank") - F.col("_start.rank")
    return marked.where(
        F.col("_own")
        & ~F.col("_closed")
        & F.col("_was_closed")
        & run.between(config.min_blink_frames, longest)
    ).select(*keys, F.col("_start.at").alias("start_idx"), F.col(idx).alias("end_idx"), run.alias("frames"))


def series_features(
    frames: DataFrame, config: FeatureConfig, keys: Sequence[str] = SESSION, idx: str = "frame_idx"
) -> DataFrame:
    """Blink, closure and brightness features of whole recordings (one row per key)."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    ear = finite("ear_mean")
    base = frames.groupBy(*keys).agg(
        F.count(F.when(valid, 1)).alias("_valid"),
        F.coalesce(F.stddev_pop(F.when(valid & (ear > 0), ear)), F.lit(0.0)).alias("ear_std"),
        F.count(F.when(valid & (ear < config.ear_threshold), 1)).alias("_closed"),
        F.coalesce(F.avg(F.when(valid, F.col("brightness"))), F.lit(0.0)).alias("mean_brightness"),
        F.coalesce(F.stddev_pop(F.when(valid, F.col("brightness"))), F.lit(0.0)).alias("std_brightness"),
    )
    runs = (
        blink_runs(frames, config, keys, idx)
        .groupBy(*keys)
        .agg(F.count("*").alias("_runs"), F.sum("frames").alias("_frames"))
    )
    runs_n = F.coalesce(F.col("_runs"), F.lit(0))
    minutes = F.col("_valid") / F.lit(config.fps) / F.lit(60.0)
    zero = F.lit(0.0)
    return key_join(base, runs, list(keys), "left").select(
        *keys,
        F.when(F.col("_valid") > 0, runs_n / minutes).otherwise(zero).alias("blink_rate"),
        runs_n.cast("double").alias("blink_count"),
        F.when(runs_n > 0, F.col("_frames") / runs_n / F.lit(config.fps) * 1000)
        .otherwise(zero)
        .alias("mean_blink_duration"),
        "ear_std",
        F.when(F.col("_valid") > 0, F.col("_closed") / F.col("_valid")).otherwise(zero).alias("perclos"),
        "mean_brightness",
        "std_brightness",
    )


def blink_onsets(
    frames: DataFrame,
    keys: Sequence[str] = SESSION,
    idx: str = "frame_idx",
    threshold: float = 0.21,
    first_previous: float = 0.3,
    chunk_rows: int = 16384,
) -> DataFrame:
    """Falling edges per key: valid frame below the threshold, previous frame (valid or not) at or above."""
    from tidemark.operators.sequence import with_halo

    rows = with_halo(frames, idx, chunk_rows, before=1)
    order = Window.partitionBy(*keys, CHUNK).orderBy(idx)
    previous = F.lag("ear_mean").over(order)
    edges = rows.withColumn(
        "_before", F.when(F.col(idx) == 0, F.lit(first_previous)).otherwise(previous)
    ).where("_own")
    falling = (
        F.coalesce(F.col("valid"), F.lit(False))
        & (finite("ear_mean") < threshold)
        & (finite("_before") >= threshold)
    )
    return edges.groupBy(*keys).agg(F.count(F.when(falling, 1)).alias("blink_onsets"))
