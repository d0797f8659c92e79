"""Labelling one window table with another: exact starts, overlap weights, or whichever fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import key_join

KEYS = ("user_id", "task")
SCORE = "physio_stress_score"


def _tick(dp: int):
    return F.round(F.col("t_start_s") * F.lit(float(10**dp))).cast("bigint")


def exact_join(
    video: DataFrame, physio: DataFrame, round_dp: int = 3, values: Sequence[str] = (SCORE,)
) -> DataFrame:
    """Inner join on user, task and the rounded start, compared as whole numbers."""
    left = video.withColumn("_tick", _tick(round_dp))
    right = physio.select(*KEYS, _tick(round_dp).alias("_tick"), *values)
    return left.join(right, [*KEYS, "_tick"]).drop("_tick")


def overlap_join(
    video: DataFrame, physio: DataFrame, bucket_s: float = 10.0, value: str = SCORE
) -> DataFrame:
    """Every window with the overlap-weighted mean of the scores it meets, NULL where it meets none.

    Both sides are expanded to the time buckets they touch, so the join is a hash join on (user, task,
    bucket) even for one endless recording. A pair that shares several buckets counts only in the first.
    ``bucket_s`` should be near the window length.
    """
    width = F.lit(float(bucket_s))

    def buckets(start: str, end: str):
        first = F.floor(F.col(start) / width)
        # The end is exclusive: a window that stops on a border does not touch the next bucket.
        last = F.ceil(F.col(end) / width) - 1
        return first, F.explode(F.sequence(first, F.greatest(first, last)))

    v_first, v_bucket = buckets("t_start_s", "t_end_s")
    spans = video.select(*KEYS, "t_start_s", "t_end_s").distinct()
    left = spans.select(*KEYS, "t_start_s", "t_end_s", v_first.alias("_vf"), v_bucket.alias("_bucket"))
    p_first, p_bucket = buckets("_ps", "_pe")
    right = (
        physio.where(F.col(value).isNotNull())
        .select(*KEYS, F.col("t_start_s").alias("_ps"), F.col("t_end_s").alias("_pe"), F.col(value).alias("_score"))
        .select(*KEYS, "_ps", "_pe", "_score", p_first.alias("_pf"), p_bucket.alias("_bucket"))
    )
    overlap = F.least("t_end_s", "_pe") - F.greatest("t_start_s", "_ps")
    met = (
        left.join(right, [*KEYS, "_bucket"])
        .where(F.col("_bucket") == F.greatest("_vf", "_pf"))
        .withColumn("_overlap", overlap)
        .where("_overlap > 0")
        .groupBy(*KEYS, "t_start_s", "t_end_s")
        .agg((F.sum(F.col("_score") * F.col("_overlap")) / F.sum("_overlap")).alias(value))
    )
    return key_join(video, met, [*KEYS, "t_start_s", "t_end_s"], "left")


def match_ratio(video: DataFrame, physio: DataFrame, round_dp: int = 3) -> DataFrame:
    """One row: video windows, exactly matched rows and their ratio."""
    matched = exact_join(video, physio, round_dp).agg(F.count("*").alias("matched"))
    return video.agg(F.count("*").alias("windows")).select(
        "windows",
        matched.scalar().alias("matched"),
        F.when(F.col("windows") > 0, matched.scalar() / F.col("windows")).otherwise(F.lit(0.0)).alias("ratio"),
    )


def label_windows(
    video: DataFrame,
    physio: DataFrame,
    mode: str = "auto",
    round_dp: int = 3,
    min_ratio: float = 0.8,
    bucket_s: float = 10.0,
) -> DataFrame:
    """Labelled windows. ``auto`` counts the exact matches (one row) and falls back to overlaps."""
    if mode not in ("auto", "exact", "overlap"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "auto":
        found = match_ratio(video, physio, round_dp).first()
        mode = "exact" if found["matched"] > 0 and found["ratio"] >= min_ratio else "overlap"
    if mode == "exact":
        return exact_join(video, physio, round_dp)
    return overlap_join(video, physio, bucket_s)


def drop_unlabelled(df: DataFrame, column: str = SCORE) -> DataFrame:
    return df.dropna(subset=[column])


def ensure_rows(df: DataFrame, message: str = "no labelled rows; check windows and join keys") -> DataFrame:
    """Raise when the table is empty (looks at one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df
