"""Frame windows, blinks, gap filling, baselines, engineered features and targets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BASE_FEATURES, EngineeredFeatures
from tidemark.operators import baseline, features, study, windows
from tidemark.operators.sequence import number_chunk, with_index
from tidemark.plans.tables import (
    DAY_US,
    EVENTS_SQL,
    FRAMES_SQL,
    VIDEO,
    events,
    frames,
    load,
    rounded,
)
from tidemark.sources.writers import feature_rows, staged

KEYS = ["user_id", "task"]
UNGATED = replace(VIDEO, max_bad_ratio=1.0)


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.window_features(frames(spark, sf_dir), VIDEO))


def window_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad-frame ratio and gate of every window, without gap filling."""
    valid = F.count(F.when(F.coalesce("valid", F.lit(False)), 1)).alias("good")
    out = windows.sliding_windows(
        frames(spark, sf_dir), KEYS, "frame_idx", VIDEO.length, VIDEO.step, [valid, F.count("*").alias("all")]
    )
    passes, bad = windows.quality_gate(F.col("good"), F.col("all"), VIDEO.max_bad_ratio)
    return rounded(out.select(*KEYS, "window_idx", passes.alias("passes"), bad.alias("bad_ratio")))


def sliding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, extremes and median of valid brightness per window."""
    value = F.when(F.col("valid"), F.col("brightness"))
    out = windows.sliding_windows(
        frames(spark, sf_dir), KEYS, "frame_idx", VIDEO.length, VIDEO.step, windows.window_stats(value)
    )
    t0, t1 = windows.window_bounds(VIDEO.length, VIDEO.step, VIDEO.fps)
    return rounded(out.select(*KEYS, t0, t1, "mean", "std", "min", "max", "median"))


def gap_filled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.interpolate_gaps(frames(spark, sf_dir), KEYS, max_gap=3, chunk_rows=4096)
    return rounded(
        out.select(*KEYS, "frame_idx", "valid", "ear_mean", "brightness", "quality", "eye_center_x", "mouth_mar", "roll", "pitch")
    )


def blink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.blink_runs(frames(spark, sf_dir), VIDEO)


def recording_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.series_features(frames(spark, sf_dir), VIDEO))


def blink_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.blink_onsets(frames(spark, sf_dir))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(frames(spark, sf_dir), VIDEO)


def _stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features as a written table: baselines and deltas read them several times."""
    return staged(_wide(spark, sf_dir), "windows")


def user_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.user_baseline(_stored_windows(spark, sf_dir)))


def live_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four windows of each recording, as a running session calibrates itself."""
    return rounded(baseline.live_baseline(_wide(spark, sf_dir), BASE_FEATURES, KEYS, ["t_start_s"]))


def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _stored_windows(spark, sf_dir)
    out = baseline.add_centered_and_delta(wide, baseline.user_baseline(wide))
    return rounded(out.select(*KEYS, "t_start_s", *EngineeredFeatures().all))


def engineered_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to features, baseline, centred and delta values and the per-user target."""
    wide = _stored_windows(spark, sf_dir)
    out = baseline.add_centered_and_delta(wide, baseline.user_baseline(wide))
    out = baseline.add_target(out, "z01", "mean_brightness")
    picked = ["perclos", "ear_std", "motion_mean"]
    return rounded(
        out.select(*KEYS, "t_start_s", *[f"{p}{s}" for p in picked for s in ("", "_centered", "_delta")], "y_true")
    )


def engineered_with_target_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every engineered feature."""
    wide = _stored_windows(spark, sf_dir)
    out = baseline.add_centered_and_delta(wide, baseline.user_baseline(wide))
    out = baseline.add_target(out, "z01", "mean_brightness")
    return rounded(out.select(*KEYS, "t_start_s", *EngineeredFeatures().all, "y_true"))


def target_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _stored_windows(spark, sf_dir).select(*KEYS, "t_start_s", "perclos")
    return rounded(baseline.add_target(wide, "delta", "perclos"))


def feature_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the feature sink writes them, metadata and absent features filled in."""
    wide = _wide(spark, sf_dir).drop("yaw_std", "bad_ratio", "window_idx")
    return rounded(feature_rows(wide.withColumn("label", F.lit("low")), VIDEO))


def task_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the tasks used for training, model features only."""
    wide = _wide(spark, sf_dir).where(F.col("task").isin(["Math", "Counting1", "Counting2", "Speaking"]))
    return rounded(wide.select(*KEYS, "t_start_s", *VIDEO.model_features))


def bucket_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.recent_mean(frames(spark, sf_dir), KEYS, "frame_idx", "brightness", rows=3)
    return rounded(out.select(*KEYS, "frame_idx", "recent_mean"))


def smoothed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.sequence import ewma

    load_index = frames(spark, sf_dir).select(*KEYS, "frame_idx", (F.col("quality")).alias("cli"))
    return rounded(ewma(load_index, KEYS, "frame_idx", "cli", 0.4, 0.5, "smoothed"))


def frame_rate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Times cut to the day: many are equal. Rates per hour keep six digits meaningful.
    df = events(spark, sf_dir).select("user_id", "event_id", F.date_trunc("day", "ts").alias("at"))
    out = study.frame_rate(df, ["user_id"], "at")
    return rounded(out.select("user_id", "event_id", (F.col("fps") * 3600).alias("per_hour")))


def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count per tumbling interval, rounded to a rate as the live display shows it."""
    hour = F.floor(F.col("ts_us") / F.lit(3.6e9))
    return (
        events(spark, sf_dir)
        .groupBy(hour.alias("hour"))
        .agg(F.count("*").alias("n"), F.max("ts_us").alias("last_us"))
        .select("hour", "n", F.round(F.col("n") / ((F.col("last_us") - F.col("hour") * 3.6e9) / 1e6) * 60).cast("bigint").alias("per_minute"))
    )


def manifest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row limit of a manifest run: the first rows in a stated order."""
    from tidemark.sources.readers import first_rows

    return first_rows(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 25, ["doc_id"])


def _windows_sql(fill: bool = True) -> str:
    """Windows straight from their definition: every window sees its own frames and its own runs."""
    c = VIDEO
    gate = f"WHERE (n - valid_n) / n <= {c.max_bad_ratio}"
    bridged = "coalesce(NOT valid AND pv AND nv, false)" if fill else "false"
    return (
        FRAMES_SQL
        + f""",
near AS (
  SELECT *, lag(valid) OVER w AS pv, lead(valid) OVER w AS nv,
         lag(ear_mean) OVER w AS p1, lead(ear_mean) OVER w AS n1, lag(brightness) OVER w AS p2, lead(brightness) OVER w AS n2,
         lag(eye_center_x) OVER w AS p3, lead(eye_center_x) OVER w AS n3, lag(eye_center_y) OVER w AS p4, lead(eye_center_y) OVER w AS n4,
         lag(mouth_mar) OVER w AS p5, lead(mouth_mar) OVER w AS n5, lag(roll) OVER w AS p6, lead(roll) OVER w AS n6,
         lag(quality) OVER w AS p7, lead(quality) OVER w AS n7
  FROM frames WINDOW w AS (PARTITION BY user_id, task ORDER BY frame_idx)),
filled AS (
  SELECT user_id, task, frame_idx, valid OR f AS valid,
         CASE WHEN f THEN 0.5 * p1 + 0.5 * n1 ELSE ear_mean END AS ear_mean,
         CASE WHEN f THEN 0.5 * p2 + 0.5 * n2 ELSE brightness END AS brightness,
         CASE WHEN f THEN 0.5 * p3 + 0.5 * n3 ELSE eye_center_x END AS ex,
         CASE WHEN f THEN 0.5 * p4 + 0.5 * n4 ELSE eye_center_y END AS ey,
         CASE WHEN f THEN 0.5 * p5 + 0.5 * n5 ELSE mouth_mar END AS mouth_mar,
         CASE WHEN f THEN 0.5 * p6 + 0.5 * n6 ELSE roll END AS roll, pitch, yaw,
         CASE WHEN f THEN least(p7, n7) ELSE quality END AS quality
  FROM (SELECT *, {bridged} AS f FROM near)),
win AS (
  SELECT f.*, k FROM filled f,
         unnest(range(greatest(0, CAST(ceil((frame_idx - {c.length - 1}) / {c.step}.0) AS BIGINT)), frame_idx // {c.step} + 1)) AS r(k)),
good AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(frame_idx) OVER w AS pi, lag(ex) OVER w AS px, lag(ey) OVER w AS py,
         ear_mean < {c.ear_threshold} AS closed
  FROM win WHERE valid WINDOW w AS (PARTITION BY user_id, task, k ORDER BY frame_idx)),
edges AS (
  SELECT *, lag(closed) OVER (PARTITION BY user_id, task, k ORDER BY pos) AS pc FROM good WHERE closed IS NOT NULL),
started AS (
  SELECT *, max(CASE WHEN closed AND NOT coalesce(pc, false) THEN pos END)
              OVER (PARTITION BY user_id, task, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s
  FROM edges),
blinks AS (
  SELECT user_id, task, k, count(*) AS runs, avg(pos - s) AS frames
  FROM started WHERE NOT closed AND pc AND pos - s BETWEEN {c.min_blink_frames} AND {c.max_blink_frames} GROUP BY ALL),
sizes AS (
  SELECT user_id, task, k, count(*) AS n, count(*) FILTER (valid) AS valid_n FROM win GROUP BY ALL HAVING count(*) = {c.length}),
stats AS (
  SELECT user_id, task, k, coalesce(stddev_pop(ear_mean) FILTER (ear_mean > 0), 0) AS ear_std,
         count(*) FILTER (closed) / count(*) AS perclos,
         coalesce(avg(mouth_mar), 0) AS mouth_open_mean, coalesce(stddev_pop(mouth_mar), 0) AS mouth_open_std,
         coalesce(stddev_pop(roll), 0) AS roll_std, coalesce(stddev_pop(pitch), 0) AS pitch_std, coalesce(stddev_pop(yaw), 0) AS yaw_std,
         coalesce(avg(sqrt((ex - px) * (ex - px) + (ey - py) * (ey - py))) FILTER (pi = frame_idx - 1), 0) AS motion_mean,
         coalesce(stddev_pop(sqrt((ex - px) * (ex - px) + (ey - py) * (ey - py))) FILTER (pi = frame_idx - 1), 0) AS motion_std,
         avg(brightness) AS mean_brightness, stddev_pop(brightness) AS std_brightness, avg(quality) AS mean_quality
  FROM good GROUP BY ALL),
wide AS (
  SELECT z.user_id, z.task, z.k AS window_idx, z.k * {c.step}::DOUBLE AS t_start_s, z.k * {c.step}::DOUBLE + {c.length} AS t_end_s,
         (n - valid_n) / n AS bad_ratio,
         CASE WHEN valid_n > 0 THEN coalesce(runs, 0) / (valid_n / 60.0) END AS blink_rate,
         CASE WHEN valid_n > 0 THEN CAST(coalesce(runs, 0) AS DOUBLE) END AS blink_count,
         CASE WHEN valid_n > 0 THEN coalesce(b.frames, 0.0) * 1000 END AS mean_blink_duration,
         ear_std, perclos, mouth_open_mean, mouth_open_std, roll_std, pitch_std, yaw_std, motion_mean, motion_std,
         mean_brightness, std_brightness, mean_quality,
         CASE WHEN valid_n > 0 THEN valid_n / n END AS valid_frame_ratio
  FROM sizes z LEFT JOIN stats s USING (user_id, task, k) LEFT JOIN blinks b USING (user_id, task, k)
  {gate})
"""
    )


WIDE_SQL = _windows_sql()


def _round(names: list[str], source: str = "") -> str:
    return ", ".join(f"round({source}{n}, 6) AS {n}" for n in names)


def _baseline_sql(names: list[str]) -> str:
    medians = ", ".join(f"median({n}) AS {n}" for n in names)
    return f""",
calm AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_start_s, task) AS rn
  FROM wide WHERE task IN ('Relax', 'Breathing', 'Video1')),
base AS (
  SELECT user_id, {medians} FROM calm WHERE rn <= 4 GROUP BY user_id
  UNION ALL
  SELECT user_id, {medians} FROM wide WHERE user_id NOT IN (SELECT user_id FROM calm) GROUP BY user_id)
"""


def _engineered_sql(names: list[str]) -> str:
    centered = ", ".join(f"w.{n} - b.{n} AS {n}_centered" for n in names)
    delta = ", ".join(
        f"coalesce({n}_centered - lag({n}_centered) OVER (PARTITION BY user_id, task ORDER BY t_start_s), 0) AS {n}_delta"
        for n in names
    )
    return (
        _baseline_sql(names)
        + f""",
centered AS (SELECT w.*, {centered} FROM wide w LEFT JOIN base b USING (user_id)),
engineered AS (SELECT *, {delta} FROM centered)
"""
    )


_PICKED = ["perclos", "ear_std", "motion_mean"]
_ALL = [*VIDEO.model_features, *VIDEO.monitoring_features]

QUERIES = {
    "window_features": window_features,
    "window_quality": window_quality,
    "sliding_window_stats": sliding_window_stats,
    "gap_filled_frames": gap_filled_frames,
    "blink_runs": blink_runs,
    "recording_features": recording_features,
    "blink_onsets": blink_onsets,
    "user_baselines": user_baselines,
    "live_baselines": live_baselines,
    "engineered_features": engineered_features,
    "engineered_with_target": engineered_with_target,
    "engineered_with_target_all": engineered_with_target_all,
    "target_delta": target_delta,
    "feature_sink_rows": feature_sink_rows,
    "task_selection": task_selection,
    "bucket_means": bucket_means,
    "smoothed_load": smoothed_load,
    "frame_rate_estimate": frame_rate_estimate,
    "events_per_hour": events_per_hour,
    "manifest_head": manifest_head,
}

_MEDIAN_BRIGHT = "coalesce(median(brightness) FILTER (valid), 0)"
_RUNS_SQL = f"""
good AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY frame_idx) - 1 AS pos,
         ear_mean < {VIDEO.ear_threshold} AS closed
  FROM frames WHERE valid),
edges AS (
  SELECT *, lag(closed) OVER (PARTITION BY user_id, task ORDER BY pos) AS pc FROM good WHERE closed IS NOT NULL),
started AS (
  SELECT *, last_value(CASE WHEN closed AND NOT coalesce(pc, false) THEN pos END IGNORE NULLS) OVER w AS s,
         last_value(CASE WHEN closed AND NOT coalesce(pc, false) THEN frame_idx END IGNORE NULLS) OVER w AS si
  FROM edges WINDOW w AS (PARTITION BY user_id, task ORDER BY pos ROWS UNBOUNDED PRECEDING)),
runs AS (
  SELECT user_id, task, si AS start_idx, frame_idx AS end_idx, pos - s AS frames FROM started
  WHERE NOT closed AND pc AND pos - s BETWEEN {VIDEO.min_blink_frames} AND {VIDEO.max_blink_frames})
"""

ORACLES = {
    "window_features": f"WITH {WIDE_SQL} SELECT user_id, task, window_idx, t_start_s, t_end_s, {_round(['bad_ratio', *_ALL])} FROM wide",
    "window_quality": f"""WITH {FRAMES_SQL},
        win AS (SELECT f.*, k FROM frames f,
          unnest(range(greatest(0, CAST(ceil((frame_idx - {VIDEO.length - 1}) / {VIDEO.step}.0) AS BIGINT)), frame_idx // {VIDEO.step} + 1)) AS r(k))
        SELECT user_id, task, k AS window_idx, 1 - count(*) FILTER (valid) / count(*) <= {VIDEO.max_bad_ratio} + 1e-12 AS passes,
               round(1 - count(*) FILTER (valid) / count(*), 6) AS bad_ratio
        FROM win GROUP BY ALL HAVING count(*) = {VIDEO.length}""",
    "sliding_window_stats": f"""WITH {FRAMES_SQL},
        win AS (SELECT f.*, k FROM frames f,
          unnest(range(greatest(0, CAST(ceil((frame_idx - {VIDEO.length - 1}) / {VIDEO.step}.0) AS BIGINT)), frame_idx // {VIDEO.step} + 1)) AS r(k))
        SELECT user_id, task, k * {VIDEO.step}::DOUBLE AS t_start_s, k * {VIDEO.step}::DOUBLE + {VIDEO.length} AS t_end_s,
               round(coalesce(avg(brightness) FILTER (valid), 0), 6) AS mean,
               round(coalesce(stddev_pop(brightness) FILTER (valid), 0), 6) AS std,
               coalesce(min(brightness) FILTER (valid), 0) AS min, coalesce(max(brightness) FILTER (valid), 0) AS max,
               round({_MEDIAN_BRIGHT}, 6) AS median
        FROM win GROUP BY user_id, task, k HAVING count(*) = {VIDEO.length}""",
    "gap_filled_frames": f"""WITH {FRAMES_SQL},
        ends AS (
          SELECT *, max(CASE WHEN valid THEN frame_idx END) OVER (PARTITION BY user_id, task ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                 min(CASE WHEN valid THEN frame_idx END) OVER (PARTITION BY user_id, task ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
          FROM frames),
        pairs AS (
          SELECT e.*, coalesce(NOT e.valid AND e.b - e.a - 1 <= 3, false) AS f, (e.frame_idx - e.a) / (e.b - e.a) AS w,
                 l.ear_mean AS l1, r.ear_mean AS r1, l.brightness AS l2, r.brightness AS r2, l.quality AS l3, r.quality AS r3,
                 l.eye_center_x AS l4, r.eye_center_x AS r4, l.mouth_mar AS l5, r.mouth_mar AS r5, l.roll AS l6, r.roll AS r6
          FROM ends e LEFT JOIN frames l ON l.user_id = e.user_id AND l.task = e.task AND l.frame_idx = e.a
                      LEFT JOIN frames r ON r.user_id = e.user_id AND r.task = e.task AND r.frame_idx = e.b)
        SELECT user_id, task, frame_idx, valid OR f AS valid,
               round(CASE WHEN f THEN (1 - w) * l1 + w * r1 ELSE ear_mean END, 6) AS ear_mean,
               round(CASE WHEN f THEN (1 - w) * l2 + w * r2 ELSE brightness END, 6) AS brightness,
               round(CASE WHEN f THEN least(l3, r3) ELSE quality END, 6) AS quality,
               round(CASE WHEN f THEN (1 - w) * l4 + w * r4 ELSE eye_center_x END, 6) AS eye_center_x,
               round(CASE WHEN f THEN (1 - w) * l5 + w * r5 ELSE mouth_mar END, 6) AS mouth_mar,
               round(CASE WHEN f THEN (1 - w) * l6 + w * r6 ELSE roll END, 6) AS roll, round(pitch, 6) AS pitch
        FROM pairs""",
    "blink_runs": f"WITH {FRAMES_SQL}, {_RUNS_SQL} SELECT * FROM runs",
    "recording_features": f"""WITH {FRAMES_SQL}, {_RUNS_SQL},
        totals AS (SELECT user_id, task, count(*) FILTER (valid) AS n,
            coalesce(stddev_pop(ear_mean) FILTER (valid AND ear_mean > 0), 0) AS ear_std,
            count(*) FILTER (valid AND ear_mean < {VIDEO.ear_threshold}) AS closed,
            coalesce(avg(brightness) FILTER (valid), 0) AS mean_brightness, coalesce(stddev_pop(brightness) FILTER (valid), 0) AS std_brightness
          FROM frames GROUP BY ALL),
        counted AS (SELECT user_id, task, count(*) AS c, avg(frames) AS d FROM runs GROUP BY ALL)
        SELECT user_id, task, round(CASE WHEN n > 0 THEN coalesce(c, 0) / (n / 60.0) ELSE 0 END, 6) AS blink_rate,
               CAST(coalesce(c, 0) AS DOUBLE) AS blink_count, round(coalesce(d, 0) * 1000, 6) AS mean_blink_duration,
               round(ear_std, 6) AS ear_std, round(CASE WHEN n > 0 THEN closed / n ELSE 0 END, 6) AS perclos,
               round(mean_brightness, 6) AS mean_brightness, round(std_brightness, 6) AS std_brightness
        FROM totals LEFT JOIN counted USING (user_id, task)""",
    "blink_onsets": f"""WITH {FRAMES_SQL},
        p AS (SELECT *, lag(ear_mean, 1, 0.3) OVER (PARTITION BY user_id, task ORDER BY frame_idx) AS pe FROM frames)
        SELECT user_id, task, count(*) FILTER (valid AND ear_mean < 0.21 AND pe >= 0.21) AS blink_onsets FROM p GROUP BY ALL""",
    "user_baselines": f"WITH {WIDE_SQL}{_baseline_sql(BASE_FEATURES)} SELECT user_id, "
    + ", ".join(f"round({n}, 6) AS baseline_{n}" for n in BASE_FEATURES)
    + " FROM base",
    "live_baselines": f"WITH {WIDE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY t_start_s) AS rn FROM wide) SELECT user_id, task, "
    + ", ".join(f"round(coalesce(median({n}), 0), 6) AS baseline_{n}" for n in BASE_FEATURES)
    + " FROM r WHERE rn <= 4 GROUP BY ALL",
    "engineered_features": f"WITH {WIDE_SQL}{_engineered_sql(BASE_FEATURES)} SELECT user_id, task, t_start_s, {_round(EngineeredFeatures().all)} FROM engineered",
    "engineered_with_target": f"""WITH {WIDE_SQL}{_engineered_sql(_PICKED)},
        m AS (SELECT user_id, avg(mean_brightness) AS mu, stddev_pop(mean_brightness) AS sigma FROM wide GROUP BY ALL)
        SELECT user_id, task, t_start_s, {_round([f"{p}{s}" for p in _PICKED for s in ("", "_centered", "_delta")])},
               round(1 / (1 + exp(-CASE WHEN sigma >= 1e-6 THEN (mean_brightness - mu) / sigma ELSE 0 END)), 6) AS y_true
        FROM engineered JOIN m USING (user_id)""",
    "target_delta": f"""WITH {WIDE_SQL}{_baseline_sql(["perclos"])}
        SELECT w.user_id, w.task, w.t_start_s, round(w.perclos, 6) AS perclos,
               round(least(greatest(0.5 + 0.5 * (w.perclos - b.perclos), 0.0), 1.0), 6) AS y_true
        FROM wide w LEFT JOIN base b USING (user_id)""",
    "feature_sink_rows": f"""WITH {WIDE_SQL}
        SELECT user_id, task, '' AS video, 'low' AS label, '' AS role, t_start_s, t_end_s,
               {_round([n for n in _ALL if n != "yaw_std"])}, 0.0::DOUBLE AS yaw_std FROM wide""",
    "task_selection": f"WITH {WIDE_SQL} SELECT user_id, task, t_start_s, {_round(VIDEO.model_features)} FROM wide WHERE task IN ('Math', 'Counting1', 'Counting2', 'Speaking')",
    "bucket_means": f"""WITH {FRAMES_SQL}
        SELECT user_id, task, frame_idx, round(avg(brightness) OVER (PARTITION BY user_id, task ORDER BY frame_idx ROWS 2 PRECEDING), 6) AS recent_mean FROM frames""",
    "smoothed_load": f"""WITH RECURSIVE {FRAMES_SQL},
        walk AS (
          SELECT user_id, task, frame_idx, quality AS cli, 0.4 * quality + 0.6 * 0.5 AS smoothed FROM frames WHERE frame_idx = 0
          UNION ALL
          SELECT f.user_id, f.task, f.frame_idx, f.quality, 0.4 * f.quality + 0.6 * w.smoothed
          FROM walk w JOIN frames f ON f.user_id = w.user_id AND f.task = w.task AND f.frame_idx = w.frame_idx + 1)
        SELECT user_id, task, frame_idx, round(cli, 6) AS cli, round(smoothed, 6) AS smoothed FROM walk""",
    "frame_rate_estimate": f"""WITH RECURSIVE {EVENTS_SQL},
        d AS (SELECT event_id, user_id, ts_us // 86400000000 AS day FROM ev),
        n AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i FROM (SELECT DISTINCT user_id, day FROM d)),
        walk AS (
          SELECT user_id, i, day, CAST(0.0 AS DOUBLE) AS fps FROM n WHERE i = 0
          UNION ALL
          SELECT n.user_id, n.i, n.day, 0.1 * (1.0 / ((n.day - w.day) * 86400)) + 0.9 * w.fps
          FROM walk w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
        SELECT user_id, event_id, round(fps * 3600, 6) AS per_hour FROM d JOIN walk USING (user_id, day)""",
    "events_per_hour": f"""WITH {EVENTS_SQL},
        h AS (SELECT ts_us // 3600000000 AS hour, count(*) AS n, max(ts_us) AS last_us FROM ev GROUP BY ALL)
        SELECT hour, n, CAST(round(n / ((last_us - hour * 3.6e9) / 1e6) * 60) AS BIGINT) AS per_minute FROM h""",
    "manifest_head": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 25",
}

ORACLES["engineered_with_target_all"] = f"""WITH {WIDE_SQL}{_engineered_sql(BASE_FEATURES)},
        m AS (SELECT user_id, avg(mean_brightness) AS mu, stddev_pop(mean_brightness) AS sigma FROM wide GROUP BY ALL)
        SELECT user_id, task, t_start_s, {_round(EngineeredFeatures().all)},
               round(1 / (1 + exp(-CASE WHEN sigma >= 1e-6 THEN (mean_brightness - mu) / sigma ELSE 0 END)), 6) AS y_true
        FROM engineered JOIN m USING (user_id)"""
