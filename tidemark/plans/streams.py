"""Streams over the given tables, run to the end of the available input."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BASE_FEATURES, EngineeredFeatures
from tidemark.operators.sequence import number_chunk, with_index
from tidemark.plans.tables import DAY_US, EVENTS_SQL, FRAMES_SQL, VIDEO, events, frames, rounded
from tidemark.plans.video import _round, _windows_sql
from tidemark.sources.writers import shared_folder
from tidemark.streaming.controller import SAMPLE_COLUMNS, controller_events, smoothed_scores
from tidemark.streaming.frames import (
    FRAME_VALUES,
    calibrated_features,
    cut_windows,
    live_features,
    throttled,
    throttled_stream,
)
from tidemark.streaming.jobs import ingest_collected, run_available, state_store, stream_table

LIVE = replace(VIDEO, max_gap=0)
PICKED = ["perclos", "ear_std", "motion_mean", "blink_count"]


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return stream_table(df.sparkSession, path, df.schema)


def _live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "task").alias("session_id"),
        F.col("frame_idx").cast("double").alias("at"),
        *FRAME_VALUES,
        "valid",
    )


def _streamed_windows(spark: SparkSession, sf_dir: str, preview_s: float | None = None) -> DataFrame:
    stream = _as_stream(_live_frames(spark, sf_dir), "frames")
    return run_available(cut_windows(stream, LIVE, preview_s), "windows", lambda batch: live_features(batch, LIVE))


def streamed_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed_windows(spark, sf_dir)
    return rounded(out.select("session_id", "t_start_s", "t_end_s", *LIVE.model_features, *LIVE.monitoring_features))


def streamed_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the partly filled buffer, every four seconds."""
    out = _streamed_windows(spark, sf_dir, preview_s=4.0).where("kind = 'preview'")
    return rounded(out.select("session_id", "emitted_at", "perclos", "mean_brightness", "valid_frame_ratio"))


def streamed_engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to windows to calibrated features: two streams, the second reads what the first wrote."""
    windows = _streamed_windows(spark, sf_dir).select("session_id", "emitted_at", *PICKED)
    out = run_available(calibrated_features(_as_stream(windows, "cut"), PICKED, n_windows=2), "engineered")
    return rounded(out.select("session_id", "emitted_at", *EngineeredFeatures(PICKED).all))


def streamed_calibrated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all base features and the operator's own number of calibration windows."""
    windows = _streamed_windows(spark, sf_dir).select("session_id", "emitted_at", *BASE_FEATURES)
    out = run_available(calibrated_features(_as_stream(windows, "cut"), BASE_FEATURES), "engineered")
    return rounded(out.select("session_id", "emitted_at", *EngineeredFeatures().all))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as load scores, one every 2.5 seconds and a bit."""
    df = events(spark, sf_dir)
    indexed = with_index(df, ["user_id"], ["ts_us", "event_id"], number_chunk("ts_us", DAY_US), "n")
    at = F.col("n") * 2500 + (F.col("k") % 7) * 300
    return indexed.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("user_id") % 3 == 0, "baseline").otherwise("adaptive").alias("condition"),
        at.alias("timestamp_ms"),
        F.least(F.lit(1.0), F.col("value") / F.lit(45.0)).alias("cli"),
        (F.lit(1.0) - F.col("k") / F.lit(1500.0)).alias("valid_frame_ratio"),
        (F.col("k") * F.lit(0.35)).alias("illumination_std"),
        (at / F.lit(1000.0)).alias("session_time_s"),
        F.when(F.col("event_type") == "error", "break").otherwise("learning_easy").alias("phase"),
    )


def controller_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controller_events(_scores(spark, sf_dir).where(F.startswith("phase", F.lit("learning"))))
    return rounded(out)


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed samples, quality flags and controller actions from keyed state."""
    out = run_available(smoothed_scores(_as_stream(_scores(spark, sf_dir), "scores")), "smoothed")
    return rounded(
        out.select(
            "session_id", "timestamp_ms", "smoothed_cli", "low_vfr_flag", "unstable_illumination_flag", "event_type", "low_confidence", "pacing_offset_s"
        )
    )


def _requests(spark: SparkSession, sf_dir: str, features: Column) -> DataFrame:
    """Collection requests, one per event."""
    ev = events(spark, sf_dir)
    sample = F.struct(
        F.col("ts_us").alias("timestamp"),
        F.col("k").alias("window_index"),
        F.when(F.col("value") > 60, "high").otherwise("low").alias("label"),
        F.when(F.col("k") < 30, "easy").when(F.col("k") < 60, "medium").otherwise("hard").alias("difficulty"),
        F.col("event_type").alias("task_type"),
        features.alias("features"),
        F.lit(1.0).alias("valid_frame_ratio"),
    )
    return ev.select(
        F.col("user_id").cast("string").alias("participant_id"), F.lit(None).cast("string").alias("session_notes"), F.array(sample).alias("samples")
    )


def streamed_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection requests arriving as files, flattened into training rows."""
    requests = _requests(spark, sf_dir, F.create_map(F.lit("perclos"), F.col("value")))
    rows, _ = ingest_collected(_as_stream(requests, "requests"))
    return rows.select("user_id", "timestamp", "window_index", "label", "difficulty", "task_type", "blink_rate", "perclos", "role")


def _full_collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and counts of requests whose samples carry every base feature."""
    features = F.create_map(*[c for i, f in enumerate(BASE_FEATURES) for c in (F.lit(f), F.col("value") * F.lit(float(i + 1)))])
    return ingest_collected(_as_stream(_requests(spark, sf_dir, features), "requests"))


def streamed_collection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_full_collection(spark, sf_dir)[0])


def streamed_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_collection(spark, sf_dir)[1]


def _camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times squeezed to camera times; some pictures repeat."""
    df = events(spark, sf_dir)
    indexed = with_index(df, ["user_id"], ["ts_us", "event_id"], number_chunk("ts_us", DAY_US), "n")
    return indexed.select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.col("n") * 20 + F.col("k") % 13).cast("double").alias("at_ms"),
        F.floor(F.col("n") / F.lit(2.5)).cast("double").alias("video_time"),
    )


def throttled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttled(_camera(spark, sf_dir), 30.0)


def streamed_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    with state_store(spark):
        stream = throttled_stream(_as_stream(_camera(spark, sf_dir), "camera"), 30.0)
    return run_available(stream, "throttled")


QUERIES = {
    "streamed_window_features": streamed_window_features,
    "streamed_previews": streamed_previews,
    "streamed_engineered_features": streamed_engineered_features,
    "streamed_calibrated_features": streamed_calibrated_features,
    "controller_actions": controller_actions,
    "streamed_scores": streamed_scores,
    "streamed_collection": streamed_collection,
    "streamed_collection_rows": streamed_collection_rows,
    "streamed_collection_counts": streamed_collection_counts,
    "throttled_frames": throttled_frames,
    "streamed_throttle": streamed_throttle,
}

_LIVE_SQL = _windows_sql(fill=False)
_ALL = [*LIVE.model_features, *LIVE.monitoring_features]

_SCORES_SQL = (
    EVENTS_SQL
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS n FROM ev),
scores AS (
  SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'baseline' ELSE 'adaptive' END AS condition, n * 2500 + (k % 7) * 300 AS ms, n,
         least(1.0::DOUBLE, value / 45.0) AS cli, 1.0 - k / 1500.0 AS ratio, k * 0.35::DOUBLE AS light, event_type <> 'error' AS learning
  FROM numbered),
fed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS r FROM scores WHERE learning),
walk AS (
  SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS ms, NULL::BIGINT AS opened, 0::BIGINT AS c, 0::DOUBLE AS s1, 0::DOUBLE AS s2, 0::DOUBLE AS s3,
         []::DOUBLE[] AS recent, 0 AS strained, 0 AS poor, 0 AS breaks, 0 AS pacing, NULL::BIGINT AS acted,
         NULL::VARCHAR AS type, NULL::DOUBLE AS load, NULL::DOUBLE AS sm, NULL::DOUBLE AS share
  FROM (SELECT DISTINCT user_id FROM fed)
  UNION ALL
  SELECT user_id, r, ms, CASE WHEN closed THEN NULL ELSE o END, CASE WHEN closed THEN 0 ELSE c1 END,
         CASE WHEN closed THEN 0 ELSE t1 END, CASE WHEN closed THEN 0 ELSE t2 END, CASE WHEN closed THEN 0 ELSE t3 END,
         recent2, strained2, poor2,
         CASE WHEN fire AND condition = 'adaptive' AND breaks < 2 THEN breaks + 1 ELSE breaks END,
         CASE WHEN fire AND condition = 'adaptive' AND breaks >= 2 AND pacing < 2 THEN pacing + 1 ELSE pacing END,
         CASE WHEN fire THEN ms ELSE acted END,
         CASE WHEN closed AND poor < 2 AND poor2 >= 2 THEN 'low_confidence_pause'
              WHEN fire AND condition = 'baseline' THEN 'suppressed_trigger' WHEN fire AND breaks < 2 THEN 'micro_break_60s'
              WHEN fire AND pacing < 2 THEN 'pacing_change' WHEN fire THEN 'difficulty_step_down' END,
         t1 / c1, sm2, t2 / c1
  FROM (SELECT *, closed AND poor2 < 2 AND strained2 >= 2 AND NOT coalesce(ms - acted < 120000, false) AS fire
  FROM (SELECT *, CASE WHEN NOT closed OR poor2 >= 2 THEN strained WHEN sm2 > 0.7 THEN strained + 1 ELSE 0 END AS strained2
  FROM (SELECT *, list_sum(recent2) / len(recent2) AS sm2,
               CASE WHEN NOT closed THEN poor WHEN t2 / c1 < 0.95 OR t3 / c1 > 28 THEN poor + 1 ELSE 0 END AS poor2
  FROM (SELECT *, CASE WHEN closed THEN list_concat(recent, [t1 / c1])[-3:] ELSE recent END AS recent2
  FROM (SELECT *, ms - o >= 5000 AS closed
  FROM (SELECT f.user_id, f.condition, f.r, f.ms, coalesce(w.opened, f.ms) AS o, w.c + 1 AS c1, w.s1 + f.cli AS t1, w.s2 + f.ratio AS t2,
               w.s3 + f.light AS t3, w.recent, w.strained, w.poor, w.breaks, w.pacing, w.acted
        FROM walk w JOIN fed f ON f.user_id = w.user_id AND f.r = w.r + 1))))))),
actions AS (SELECT * FROM walk WHERE type IS NOT NULL)
"""
)

_DETAILS = """CASE type WHEN 'low_confidence_pause' THEN 'Adaptation paused due to low signal quality.'
  WHEN 'suppressed_trigger' THEN 'Overload trigger detected but suppressed in baseline condition.'
  WHEN 'micro_break_60s' THEN 'Prompting a 60 second micro-break due to sustained overload.'
  WHEN 'pacing_change' THEN 'Increased item exposure by +' || pacing || 's cumulative.'
  ELSE 'Stepped down hard-block interference profile for remaining items.' END"""

_CAMERA_SQL = (
    EVENTS_SQL
    + """,
camera AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS n, k FROM ev),
shots AS (SELECT user_id, n, CAST(n * 20 + k % 13 AS DOUBLE) AS at_ms, CAST(floor(n / 2.5) AS DOUBLE) AS video_time FROM camera),
walk AS (
  SELECT user_id, n, at_ms, video_time, true AS passed, at_ms AS la, video_time AS lv FROM shots WHERE n = 0
  UNION ALL
  SELECT user_id, n, at_ms, video_time, ok, CASE WHEN ok THEN at_ms ELSE la END, CASE WHEN ok THEN video_time ELSE lv END
  FROM (SELECT s.*, la, lv, NOT (s.at_ms - la < 1000.0::DOUBLE / 30 OR s.video_time = lv) AS ok
        FROM walk w JOIN shots s ON s.user_id = w.user_id AND s.n = w.n + 1))
SELECT CAST(user_id AS VARCHAR) AS session_id, at_ms, video_time FROM walk WHERE passed
"""
)

_BASE = ", ".join(f"median({p}) AS b_{p}" for p in PICKED)
_CENTERED = ", ".join(f"{p} - b_{p} AS {p}_centered" for p in PICKED)
_DELTA = ", ".join(
    f"coalesce({p}_centered - lag({p}_centered) OVER (PARTITION BY user_id, task ORDER BY t_start_s), 0) AS {p}_delta" for p in PICKED
)

ORACLES = {
    "streamed_window_features": f"WITH {_LIVE_SQL} SELECT user_id || '/' || task AS session_id, t_start_s, t_end_s, {_round(_ALL)} FROM wide",
    "streamed_previews": f"""WITH {FRAMES_SQL},
        p AS (SELECT a.user_id, a.task, a.frame_idx AS spot, b.valid, b.ear_mean, b.brightness
              FROM frames a JOIN frames b ON b.user_id = a.user_id AND b.task = a.task AND b.frame_idx BETWEEN a.frame_idx - {LIVE.length - 1} AND a.frame_idx
              WHERE a.frame_idx % 4 = 0)
        SELECT user_id || '/' || task AS session_id, CAST(spot AS DOUBLE) AS emitted_at,
               round(CASE WHEN count(*) FILTER (valid) > 0 THEN count(*) FILTER (valid AND ear_mean < {LIVE.ear_threshold}) / count(*) FILTER (valid) END, 6) AS perclos,
               round(avg(brightness) FILTER (valid), 6) AS mean_brightness,
               round(CASE WHEN count(*) FILTER (valid) > 0 THEN count(*) FILTER (valid) / count(*) END, 6) AS valid_frame_ratio
        FROM p GROUP BY user_id, task, spot""",
    "streamed_engineered_features": f"""WITH {_LIVE_SQL},
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY t_start_s) AS rn FROM wide),
        b AS (SELECT user_id, task, {_BASE} FROM r WHERE rn <= 2 GROUP BY ALL),
        c AS (SELECT r.*, {_CENTERED} FROM r JOIN b USING (user_id, task) WHERE rn > 2),
        d AS (SELECT *, {_DELTA} FROM c)
        SELECT user_id || '/' || task AS session_id, t_end_s - 1 AS emitted_at, {_round(EngineeredFeatures(PICKED).all)} FROM d""",
    "controller_actions": f"""WITH RECURSIVE {_SCORES_SQL}
        SELECT CAST(user_id AS VARCHAR) AS session_id, ms AS timestamp_ms, ms / 1000.0 AS session_time_s, 'learning_easy' AS phase, type,
               CASE type WHEN 'low_confidence_pause' THEN 'paused' WHEN 'suppressed_trigger' THEN 'suppressed' ELSE 'applied' END AS outcome,
               round(load, 6) AS cli, round(sm, 6) AS smoothed_cli, round(share, 6) AS valid_frame_ratio, {_DETAILS} AS details FROM actions""",
    "streamed_scores": f"""WITH RECURSIVE {_SCORES_SQL},
        smooth AS (
          SELECT user_id, n, ms, 0.4 * cli + 0.6 * 0.5 AS y FROM scores WHERE n = 0
          UNION ALL
          SELECT s.user_id, s.n, s.ms, 0.4 * s.cli + 0.6 * y FROM smooth w JOIN scores s ON s.user_id = w.user_id AND s.n = w.n + 1),
        j AS (
          SELECT s.user_id, s.n, s.ms, y, ratio, light, w.type, w.poor, w.pacing FROM scores s JOIN smooth USING (user_id, n)
          LEFT JOIN walk w ON w.user_id = s.user_id AND w.ms = s.ms)
        SELECT CAST(user_id AS VARCHAR) AS session_id, ms AS timestamp_ms, round(y, 6) AS smoothed_cli, ratio < 0.95 AS low_vfr_flag,
               light > 28 AS unstable_illumination_flag, type AS event_type,
               coalesce(last_value(poor IGNORE NULLS) OVER p, 0) >= 2 AS low_confidence, coalesce(last_value(pacing IGNORE NULLS) OVER p, 0) AS pacing_offset_s
        FROM j WINDOW p AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)""",
    "streamed_collection": f"""WITH {EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS user_id, ts_us AS timestamp, k AS window_index, CASE WHEN value > 60 THEN 1 ELSE 0 END AS label,
        CASE WHEN k < 30 THEN 'easy' WHEN k < 60 THEN 'medium' ELSE 'hard' END AS difficulty, event_type AS task_type, 0.0::DOUBLE AS blink_rate, value AS perclos, 'train' AS role FROM ev""",
    "throttled_frames": f"WITH RECURSIVE {_CAMERA_SQL}",
    "streamed_throttle": f"WITH RECURSIVE {_CAMERA_SQL}",
}

_ALL_BASE = ", ".join(f"median({p}) AS b_{p}" for p in BASE_FEATURES)
_ALL_CENTERED = ", ".join(f"{p} - b_{p} AS {p}_centered" for p in BASE_FEATURES)
_ALL_DELTA = ", ".join(
    f"coalesce({p}_centered - lag({p}_centered) OVER (PARTITION BY user_id, task ORDER BY t_start_s), 0) AS {p}_delta" for p in BASE_FEATURES
)
_DIFFICULTY = "CASE WHEN k < 30 THEN 'easy' WHEN k < 60 THEN 'medium' ELSE 'hard' END"
_VALUES = ", ".join(f"round(value * {i + 1}, 6) AS {f}" for i, f in enumerate(BASE_FEATURES))

ORACLES |= {
    "streamed_calibrated_features": f"""WITH {_LIVE_SQL},
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY t_start_s) AS rn FROM wide),
        b AS (SELECT user_id, task, {_ALL_BASE} FROM r WHERE rn <= 4 GROUP BY ALL),
        c AS (SELECT r.*, {_ALL_CENTERED} FROM r JOIN b USING (user_id, task) WHERE rn > 4),
        d AS (SELECT *, {_ALL_DELTA} FROM c)
        SELECT user_id || '/' || task AS session_id, t_end_s - 1 AS emitted_at, {_round(EngineeredFeatures().all)} FROM d""",
    "streamed_collection_rows": f"""WITH {EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS user_id, ts_us AS timestamp, k AS window_index,
        CASE WHEN value > 60 THEN 1 ELSE 0 END AS label, {_DIFFICULTY} AS difficulty, event_type AS task_type, {_VALUES}, 'train' AS role FROM ev""",
    "streamed_collection_counts": f"""WITH {EVENTS_SQL}, s AS (SELECT *, {_DIFFICULTY} AS d FROM ev)
        SELECT CAST(user_id AS VARCHAR) AS participant_id, count(*) AS total_samples, count(*) FILTER (NOT coalesce(value > 60, false)) AS low,
        count(*) FILTER (value > 60) AS high, count(*) FILTER (d = 'easy') AS easy, count(*) FILTER (d = 'medium') AS medium,
        count(*) FILTER (d = 'hard') AS hard FROM s GROUP BY user_id""",
}
