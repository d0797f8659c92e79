"""Signal windows, stress scores, summaries, alignment, ranks, geometry and plain column functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PHYSIO_FEATURES
from tidemark.functions import geometry, numeric, text
from tidemark.functions.geometry import LandmarkIndices
from tidemark.operators import alignment, ranks, scoring, signals, sketches, windows
from tidemark.plans.tables import (
    EVENTS_SQL,
    FRAMES_SQL,
    PHYSIO,
    SAMPLES_SQL,
    events,
    frames,
    instant,
    load,
    rounded,
    samples,
)
from tidemark.sources import readers, writers

KEYS = ["user_id", "task"]


def physio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.physio_windows(samples(spark, sf_dir), PHYSIO))


def normalized_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.normalized_windows(samples(spark, sf_dir), "EDA", PHYSIO.length, PHYSIO.step)
    return rounded(out)


def stress_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = writers.staged(signals.physio_windows(samples(spark, sf_dir), PHYSIO), "physio")
    out = scoring.stress_score(wide)
    return rounded(out.select(*KEYS, "t_start_s", "t_end_s", "physio_stress_score", "ecg_quality"))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = signals.physio_windows(samples(spark, sf_dir), PHYSIO)
    return rounded(scoring.extraction_summary(wide, PHYSIO_FEATURES))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: score, median and summary all read the finished windows.
    wide = writers.staged(signals.physio_windows(samples(spark, sf_dir), PHYSIO), "physio")
    wide = scoring.stress_score(wide)
    return rounded(scoring.label_summary(wide, "physio_stress_score", ["hr", "sdnn", "scr_amplitude_mean"]))


def windows_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.windows_per_task(_labels(spark, sf_dir, 12, 3))


def score_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score_by_task(_labels(spark, sf_dir, 12, 3), "physio_stress_score"))


# --- alignment -----------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str, length: int, step: int) -> DataFrame:
    """Scored windows of another grid than the frame windows."""
    score = F.avg(F.when(F.col("quality") != 0.5, F.col("quality"))).alias("physio_stress_score")
    out = windows.sliding_windows(frames(spark, sf_dir), KEYS, "frame_idx", length, step, [score])
    return out.select(*KEYS, *windows.window_bounds(length, step, 1.0), "physio_stress_score")


def _video(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.avg("brightness").alias("level")
    out = windows.sliding_windows(frames(spark, sf_dir), KEYS, "frame_idx", 12, 3, [level])
    return out.select(*KEYS, *windows.window_bounds(12, 3, 1.0), "level")


def exact_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alignment.exact_join(_video(spark, sf_dir), _labels(spark, sf_dir, 12, 3)))


def overlap_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alignment.overlap_join(_video(spark, sf_dir), _labels(spark, sf_dir, 7, 2), bucket_s=8.0))


def match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alignment.match_ratio(_video(spark, sf_dir), _labels(spark, sf_dir, 12, 4)))


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic choice between both joins; rows without a label are dropped."""
    out = alignment.label_windows(_video(spark, sf_dir), _labels(spark, sf_dir, 5, 4), bucket_s=12.0)
    return rounded(alignment.drop_unlabelled(out))


# --- ranks and binary labels ---------------------------------------------------------------------


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(ranks.spearman(line, "l_quantity", "l_extendedprice"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_ranks(load(spark, sf_dir, "events"), "value", "rank")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled_documents(spark, sf_dir).withColumn("score", F.col("n_chars").cast("double"))
    return rounded(ranks.roc_auc(df, "quality", "score"))


def session_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session means of truth and prediction, joined to binary labels; incomplete rows dropped."""
    docs = load(spark, sf_dir, "documents").withColumns(
        {
            "user_id": F.col("lang"),
            "task": F.col("source"),
            "y_true": F.col("n_chars") / F.lit(1000.0),
            "y_pred": F.length("text") / F.lit(900.0),
        }
    )
    means = scoring.session_means(docs)
    labels = (
        _labelled_documents(spark, sf_dir)
        .groupBy(F.col("lang").alias("user_id"), F.col("source").alias("task"))
        .agg(F.max("toxic").alias("binary_stress"))
    )
    return rounded(means.join(labels, ["user_id", "task"]).dropna(subset=["binary_stress", "y_pred"]))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.latency_stats(load(spark, sf_dir, "events"), "value"))


RANK_ERROR = 0.015
POINTS = (0.5, 0.95, 0.99)


def sketched_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every day and of all days from sketches stored by the hour, and whether each estimated quantile lies
    within the rank error of the exact one."""
    ev = load(spark, sf_dir, "events").select(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH").alias("hour"), "value")
    hours = writers.staged(sketches.sketched(ev, "value", ["hour"]), "hours").withColumn("day", F.substring("hour", 1, 10))
    days = sketches.merged(hours, ["day"]).unionByName(sketches.merged(hours).withColumn("day", F.lit("all")))
    found = writers.staged(sketches.estimates(days, POINTS, ["day"]), "estimates")
    rows = ev.select(F.explode(F.array(F.substring("hour", 1, 10), F.lit("all"))).alias("day"), "value").join(found, "day")
    shares = [F.avg((F.col("value") < F.col(f"q{i}")).cast("int")).alias(f"lo{i}") for i in range(len(POINTS))]
    shares += [F.avg((F.col("value") <= F.col(f"q{i}")).cast("int")).alias(f"hi{i}") for i in range(len(POINTS))]
    close = [
        ((F.col(f"lo{i}") - RANK_ERROR <= q) & (F.col(f"hi{i}") + RANK_ERROR >= q)).alias(n) for i, (q, n) in enumerate(zip(POINTS, ("median_close", "p95_close", "p99_close")))
    ]
    out = found.join(rows.groupBy("day").agg(*shares), "day")
    return rounded(out.select("day", "count", "mean", "max", *close))


# --- geometry ------------------------------------------------------------------------------------

# Small positions: embeddings of 64 entries give 21 points each; the last entry is no whole point.
POINTS_21 = LandmarkIndices(
    left_eye=(0, 1, 2, 3, 4, 5),
    right_eye=(6, 7, 8, 9, 10, 11),
    left_eye_outer=0,
    right_eye_outer=9,
    mouth_left=12,
    mouth_right=13,
    mouth_upper=14,
    mouth_lower=15,
    nose_tip=16,
    forehead=17,
    chin=18,
    left_ear=19,
    right_ear=20,
)


def _landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(n):
        return F.get("embedding", n).cast("double")

    points = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(F.size("embedding") / F.lit(3)).cast("int")), lambda i: i * 3 + 2 < F.size("embedding")),
        lambda i: F.struct(at(i * 3).alias("x"), at(i * 3 + 1).alias("y"), at(i * 3 + 2).alias("z")),
    )
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_idx"),
        F.lit("u").alias("user_id"),
        F.col("label").cast("string").alias("task"),
        (F.col("vec_id") % 10 != 3).alias("detected"),
        F.lit(0.9).alias("quality"),
        F.lit(100.0).alias("brightness"),
        points.alias("points"),
    )


def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.frame_features(_landmarks(spark, sf_dir), POINTS_21, fps=30.0)
    return rounded(out.drop("user_id"))


def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in whole pixels of a 640 x 640 picture centred on the origin, and in plain units."""
    pixels = F.transform(
        "points",
        lambda p: F.struct((p["x"] * 640 + 320).alias("x"), (p["y"] * 640 + 320).alias("y"), p["z"].alias("z")),
    )
    out = _landmarks(spark, sf_dir).select(
        "frame_idx", geometry.face_box(pixels).alias("p"), geometry.face_box("points", pixels=False).alias("u")
    )
    return rounded(out.select("frame_idx", "p.x", "p.y", "p.w", "p.h", F.col("u.x").alias("ux"), F.col("u.w").alias("uw")))


# --- collected samples and plain functions -------------------------------------------------------


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.select(
        F.col("user_id").alias("participant_id"),
        F.col("ts_us").alias("timestamp"),
        F.col("event_id").alias("window_index"),
        F.when(F.col("value") > 60, "high").otherwise("low").alias("label"),
        F.when(F.col("k") < 30, "easy").when(F.col("k") < 60, "medium").otherwise("hard").alias("difficulty"),
        F.col("event_type").alias("task_type"),
        F.when(F.col("k") % 2 == 0, F.create_map(F.lit("blink_rate"), "value", F.lit("perclos"), F.col("k") / F.lit(100.0)))
        .otherwise(F.create_map(F.lit("ear_std"), F.col("value")))
        .alias("features"),
    )


def collected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(writers.collected_rows(_collected(spark, sf_dir), ["blink_rate", "ear_std", "perclos"]))


def collected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.collected_counts(_collected(spark, sf_dir))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties as records; broken texts are dropped (every one cut before its end is broken)."""
    props = load(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") > 300, F.substr("props", F.lit(1), F.lit(4))).otherwise(F.col("props")).alias("props")
    )
    return readers.parse_records(props, "props", "k int").select("event_id", F.col("record.k").alias("k"))


def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "part").select(
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_type").alias("subject_task"), "p_partkey"
    )
    return readers.split_labels(keyed, label="p_partkey")


def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both task rules on file paths made from document fields."""
    stem = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    plain = F.col("lang") == "en"
    path = F.concat(F.lit("data/v.1/"), F.when(plain, F.col("source")).otherwise(stem), F.lit(".mp4"))
    own = F.when(F.col("n_chars") > 5000, F.lit("Own"))
    df = load(spark, sf_dir, "documents").select("doc_id", path.alias("path"), own.alias("own"))
    return df.select(
        "doc_id", text.task_of_video("path").alias("training_task"), text.task_of_recording("path", "own").alias("task")
    )


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoid, clip, zero guard, load level, eye state and quality flags on event values."""
    ev = events(spark, sf_dir)
    x = F.col("value") / F.lit(100.0)
    broken = F.when(F.col("k") == 5, F.lit(float("nan"))).when(F.col("k") == 6, F.lit(float("inf"))).otherwise(x)
    out = ev.select(
        "event_id",
        numeric.sigmoid(x - 0.5).alias("sigmoid"),
        numeric.clip(x, 0.2, 1.0).alias("clipped"),
        numeric.zero_if_missing(broken).alias("safe"),
        numeric.finite(broken).alias("finite"),
        numeric.load_level(x).alias("level"),
        numeric.eye_state(F.when(F.col("k") == 5, F.lit(float("nan"))).otherwise(x)).alias("eye"),
        numeric.low_valid_ratio(x).alias("low_ratio"),
        numeric.unstable_illumination(F.col("value")).alias("unstable"),
        numeric.effective_exposure(F.lit(5.5), F.col("k")).alias("exposure"),
    )
    return rounded(out)


def vector_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs by name in specification order, absent names as 0."""
    names = ["ear_std", "blink_rate", "perclos"]
    return rounded(
        _collected(spark, sf_dir).select(
            "window_index", *[F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)).alias(n) for n in names]
        )
    )


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with white space and capitals around them, compared to the target."""
    part = load(spark, sf_dir, "part")
    answer = F.concat(F.lit(" \t"), F.upper("p_type"), F.lit("\n"))
    return part.select(
        "p_partkey", text.answer_is_correct(answer, F.split("p_name", " ").getItem(0)).alias("name_right"), text.answer_is_correct(answer, F.initcap("p_type")).alias("type_right")
    )


def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("at", instant("o_orderdate"))
    ms = F.unix_millis("at")
    who = F.concat(F.lit("  C"), F.col("o_custkey").cast("string"), F.lit(" "))
    number = F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)
    return orders.select(
        "o_orderkey",
        text.record_id(who, "s", number, F.lit("adaptive"), ms).alias("session_id"),
        text.record_id(who, "d", number, F.lit("baseline"), ms).alias("delayed_id"),
        text.interference_group(F.col("o_orderpriority")).alias("grp"),
        text.interference_group(F.concat_ws("-", "o_orderstatus", F.lit("g"), "o_orderkey")).alias("item_group"),
        text.join_choices(F.array("o_orderstatus", "o_orderpriority")).alias("choices"),
    )


def stacked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two sources put below each other."""
    a = _labels(spark, sf_dir, 12, 3).withColumn("origin", F.lit("a"))
    b = _labels(spark, sf_dir, 7, 2).withColumn("origin", F.lit("b"))
    return rounded(a.unionByName(b))


QUERIES = {
    "physio_windows": physio_windows,
    "normalized_signal": normalized_signal,
    "stress_scores": stress_scores,
    "extraction_summary": extraction_summary,
    "label_summary": label_summary,
    "windows_per_task": windows_per_task,
    "score_by_task": score_by_task,
    "exact_window_join": exact_window_join,
    "overlap_window_join": overlap_window_join,
    "match_ratio": match_ratio,
    "labelled_windows": labelled_windows,
    "spearman": spearman,
    "average_ranks": average_ranks,
    "roc_auc": roc_auc,
    "session_label_join": session_label_join,
    "label_counts": label_counts,
    "latency_stats": latency_stats,
    "sketched_latency": sketched_latency,
    "frame_geometry": frame_geometry,
    "face_boxes": face_boxes,
    "collected_rows": collected_rows,
    "collected_counts": collected_counts,
    "json_records": json_records,
    "split_labels": split_labels,
    "task_names": task_names,
    "scalar_functions": scalar_functions,
    "vector_inputs": vector_inputs,
    "answer_scores": answer_scores,
    "record_names": record_names,
    "stacked_windows": stacked_windows,
}


def _spread(length: int, step: int, i: str = "frame_idx") -> str:
    """Range of the windows that hold row ``i``."""
    return f"range(greatest(0, CAST(ceil(({i} - {length - 1}) / {step}.0) AS BIGINT)), {i} // {step} + 1)"


def _labels_sql(name: str, length: int, step: int) -> str:
    return f"""
{name} AS (
  SELECT user_id, task, k * {step}::DOUBLE AS t_start_s, k * {step}::DOUBLE + {length} AS t_end_s,
         avg(CASE WHEN quality <> 0.5 THEN quality END) AS physio_stress_score
  FROM frames, unnest({_spread(length, step)}) AS r(k) GROUP BY user_id, task, k HAVING count(*) = {length})
"""


_VIDEO_SQL = f"""
video AS (
  SELECT user_id, task, k * 3::DOUBLE AS t_start_s, k * 3::DOUBLE + 12 AS t_end_s, avg(brightness) AS level
  FROM frames, unnest({_spread(12, 3)}) AS r(k) GROUP BY user_id, task, k HAVING count(*) = 12)
"""

_OVERLAP = """
  SELECT v.user_id, v.task, v.t_start_s, v.t_end_s, v.level,
         sum(p.physio_stress_score * (least(v.t_end_s, p.t_end_s) - greatest(v.t_start_s, p.t_start_s)))
           / sum(least(v.t_end_s, p.t_end_s) - greatest(v.t_start_s, p.t_start_s)) AS physio_stress_score
  FROM video v LEFT JOIN labels_b p ON p.user_id = v.user_id AND p.task = v.task
    AND p.t_start_s < v.t_end_s AND p.t_end_s > v.t_start_s AND p.physio_stress_score IS NOT NULL
  GROUP BY ALL
"""


def _peak(column: str, half: int, sign: str = "") -> str:
    """A sample above all earlier and not below any later neighbour, both neighbours existing."""
    v = f"{sign}{column}"
    earlier = f"max({v}) OVER (PARTITION BY user_id, task ORDER BY sample_idx ROWS BETWEEN {half} PRECEDING AND 1 PRECEDING)"
    later = f"max({v}) OVER (PARTITION BY user_id, task ORDER BY sample_idx ROWS BETWEEN 1 FOLLOWING AND {half} FOLLOWING)"
    inner = "sample_idx > 0 AND sample_idx < max(sample_idx) OVER (PARTITION BY user_id, task)"
    return f"coalesce({v} > coalesce({earlier}, '-inf'::DOUBLE) AND {v} >= coalesce({later}, '-inf'::DOUBLE) AND {inner}, false)"


def _physio_sql() -> str:
    c = PHYSIO
    return (
        SAMPLES_SQL
        + f""",
levels AS (
  SELECT *, avg(eda) OVER (PARTITION BY user_id, task ORDER BY sample_idx
                           ROWS BETWEEN {c.tonic_half_width} PRECEDING AND {c.tonic_half_width} FOLLOWING) AS tonic
  FROM samples),
phases AS (SELECT *, eda - tonic AS phasic FROM levels),
marks AS (
  SELECT *, {_peak('ecg', c.ecg_half_width)} AS beat, {_peak('phasic', c.eda_half_width)} AS scr,
         {_peak('rr', c.resp_half_width)} AS peak, {_peak('rr', c.resp_half_width, '-')} AS trough
  FROM phases),
win AS (SELECT m.*, k FROM marks m, unnest({_spread(c.length, c.step, 'sample_idx')}) AS r(k)),
size AS (
  SELECT user_id, task, k, avg(ecg) AS m1, stddev_pop(ecg) AS s1, count(ecg) AS n1, avg(eda) AS m2, stddev_pop(eda) AS s2, count(eda) AS n2,
         avg(rr) AS m3, stddev_pop(rr) AS s3, count(rr) AS n3, avg(tonic) AS tonic
  FROM win GROUP BY ALL HAVING count(*) = {c.length}),
beats AS (
  SELECT w.user_id, w.task, w.k, sample_idx, (sample_idx - lag(sample_idx) OVER b) / {c.rate} * 1000.0 AS rr_ms,
         count(*) OVER (PARTITION BY w.user_id, w.task, w.k) AS nb
  FROM win w JOIN size s USING (user_id, task, k) WHERE beat AND ecg > m1 + {c.ecg_height} * s1
  WINDOW b AS (PARTITION BY w.user_id, w.task, w.k ORDER BY sample_idx)),
kept AS (
  SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id, task, k ORDER BY sample_idx) AS d
  FROM beats WHERE nb >= 3 AND rr_ms > 300 AND rr_ms < 2000),
heart AS (
  SELECT user_id, task, k, 60000.0 / avg(rr_ms) AS hr, stddev_samp(rr_ms) AS sdnn, sqrt(avg(d * d)) AS rmssd
  FROM kept GROUP BY ALL HAVING count(*) >= 2),
skin AS (
  SELECT w.user_id, w.task, w.k, CAST(count(*) AS DOUBLE) AS c, avg(phasic / s2) AS a
  FROM win w JOIN size s USING (user_id, task, k) WHERE scr AND phasic > {c.scr_height} * s2 GROUP BY ALL),
breath AS (
  SELECT w.user_id, w.task, w.k, sample_idx, rr, s3,
         (sample_idx - lag(sample_idx) OVER (PARTITION BY w.user_id, w.task, w.k ORDER BY sample_idx)) / {c.rate} AS cycle
  FROM win w JOIN size s USING (user_id, task, k) WHERE peak AND rr > m3 + {c.resp_height} * s3),
deep AS (
  SELECT b.user_id, b.task, b.k, b.sample_idx, b.cycle, (b.rr - arg_max(t.rr, t.sample_idx)) / b.s3 AS depth
  FROM breath b LEFT JOIN win t ON t.user_id = b.user_id AND t.task = b.task AND t.k = b.k AND t.trough AND t.sample_idx < b.sample_idx
  GROUP BY b.user_id, b.task, b.k, b.sample_idx, b.cycle, b.rr, b.s3),
resp AS (
  SELECT user_id, task, k, 60.0 / avg(cycle) AS rate, avg(depth) AS amp, stddev_samp(depth) AS sd FROM deep GROUP BY ALL),
physio AS (
  SELECT z.user_id, z.task, z.k AS window_idx, z.k * {c.step} / {c.rate}.0 AS t_start_s, (z.k * {c.step} + {c.length}) / {c.rate}.0 AS t_end_s,
         CASE WHEN n1 >= {c.rate} AND s1 >= 1e-6 THEN hr END AS hr, CASE WHEN n1 >= {c.rate} AND s1 >= 1e-6 THEN rmssd END AS rmssd,
         CASE WHEN n1 >= {c.rate} AND s1 >= 1e-6 THEN sdnn END AS sdnn,
         CASE WHEN n2 >= {c.rate} AND s2 >= 1e-6 THEN (tonic - m2) / s2 END AS scl,
         CASE WHEN n2 >= {c.rate} AND s2 >= 1e-6 THEN coalesce(skin.c, 0.0) END AS scr_count,
         CASE WHEN n2 >= {c.rate} AND s2 >= 1e-6 THEN skin.a END AS scr_amplitude_mean,
         CASE WHEN n3 >= {c.rate} AND s3 >= 1e-6 THEN rate END AS resp_rate,
         CASE WHEN n3 >= {c.rate} AND s3 >= 1e-6 THEN amp END AS resp_amplitude_mean,
         CASE WHEN n3 >= {c.rate} AND s3 >= 1e-6 THEN sd END AS resp_variability,
         CASE WHEN n1 >= {c.rate} AND s1 >= 1e-6 AND hr IS NOT NULL THEN
           CASE WHEN hr BETWEEN 40 AND 180 AND rmssd IS NOT NULL THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END ELSE 0.0::DOUBLE END AS ecg_quality
  FROM size z LEFT JOIN heart USING (user_id, task, k) LEFT JOIN skin USING (user_id, task, k) LEFT JOIN resp USING (user_id, task, k))
"""
    )


_PHYSIO_SQL = _physio_sql()
_SCORED_SQL = (
    _PHYSIO_SQL
    + """,
m AS (SELECT avg(hr) AS a1, stddev_pop(hr) AS b1, avg(sdnn) AS a2, stddev_pop(sdnn) AS b2, avg(scr_amplitude_mean) AS a3,
             stddev_pop(scr_amplitude_mean) AS b3, avg(resp_amplitude_mean) AS a4, stddev_pop(resp_amplitude_mean) AS b4 FROM physio),
scored AS (
  SELECT physio.*, 1 / (1 + exp(-(
    CASE WHEN b1 > 1e-6 THEN (hr - a1) / b1 ELSE 0 END * 0.452 - CASE WHEN b2 > 1e-6 THEN (sdnn - a2) / b2 ELSE 0 END * 0.320
    + CASE WHEN b3 > 1e-6 THEN (scr_amplitude_mean - a3) / b3 ELSE 0 END * 0.405
    + CASE WHEN b4 > 1e-6 THEN (resp_amplitude_mean - a4) / b4 ELSE 0 END * 0.623) / (0.452 + 0.320 + 0.405 + 0.623))) AS physio_stress_score
  FROM physio, m)
"""
)

_COLLECTED_SQL = (
    EVENTS_SQL
    + """,
collected AS (
  SELECT user_id AS participant_id, ts_us AS timestamp, event_id AS window_index, CASE WHEN value > 60 THEN 'high' ELSE 'low' END AS label,
         CASE WHEN k < 30 THEN 'easy' WHEN k < 60 THEN 'medium' ELSE 'hard' END AS difficulty, event_type AS task_type,
         CASE WHEN k % 2 = 0 THEN value ELSE 0 END AS blink_rate, CASE WHEN k % 2 = 0 THEN 0 ELSE value END AS ear_std,
         CASE WHEN k % 2 = 0 THEN k / 100.0 ELSE 0 END AS perclos
  FROM ev)
"""
)


def _point(i: int, axis: str) -> str:
    return f"e[{3 * i + {'x': 1, 'y': 2, 'z': 3}[axis]}]"


def _dist(a: int, b: int) -> str:
    dx = f"({_point(a, 'x')} - {_point(b, 'x')})"
    dy = f"({_point(a, 'y')} - {_point(b, 'y')})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _ear(p: tuple[int, ...]) -> str:
    w = _dist(p[0], p[3])
    return f"CASE WHEN {w} >= 1e-6 THEN ({_dist(p[1], p[5])} + {_dist(p[2], p[4])}) / (2 * {w}) ELSE 0 END"


_P = POINTS_21
_GEOMETRY_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (
  SELECT vec_id AS frame_idx, CAST(label AS VARCHAR) AS task, vec_id % 10 <> 3 AS valid,
         {_ear(_P.left_eye)} AS ear_left, {_ear(_P.right_eye)} AS ear_right,
         ({_point(0, 'x')} + {_point(9, 'x')}) / 2 AS eye_center_x, ({_point(0, 'y')} + {_point(9, 'y')}) / 2 AS eye_center_y,
         CASE WHEN {_dist(12, 13)} >= 1e-6 THEN {_dist(14, 15)} / {_dist(12, 13)} ELSE 0 END AS mouth_mar,
         atan2({_point(9, 'y')} - {_point(0, 'y')}, {_point(9, 'x')} - {_point(0, 'x')}) AS roll,
         CASE WHEN abs({_point(18, 'y')} - {_point(17, 'y')}) >= 1e-6
              THEN atan2({_point(18, 'z')} - {_point(17, 'z')}, {_point(18, 'y')} - {_point(17, 'y')}) ELSE 0 END AS pitch,
         CASE WHEN abs({_point(20, 'x')} - {_point(19, 'x')}) >= 1e-6
              THEN atan2({_point(16, 'x')} - ({_point(19, 'x')} + {_point(20, 'x')}) / 2, abs({_point(20, 'x')} - {_point(19, 'x')}) / 2) ELSE 0 END AS yaw
  FROM v)
SELECT frame_idx, task, round(frame_idx / 30.0, 6) AS timestamp_s, valid,
       round(CASE WHEN valid THEN ear_left ELSE 0 END, 6) AS ear_left, round(CASE WHEN valid THEN ear_right ELSE 0 END, 6) AS ear_right,
       round(CASE WHEN valid THEN (ear_left + ear_right) / 2 ELSE 0 END, 6) AS ear_mean,
       CASE WHEN valid THEN 100.0::DOUBLE ELSE 0 END AS brightness, CASE WHEN valid THEN 0.9::DOUBLE ELSE 0 END AS quality,
       round(CASE WHEN valid THEN eye_center_x ELSE 0 END, 6) AS eye_center_x, round(CASE WHEN valid THEN eye_center_y ELSE 0 END, 6) AS eye_center_y,
       round(CASE WHEN valid THEN mouth_mar ELSE 0 END, 6) AS mouth_mar, round(CASE WHEN valid THEN roll ELSE 0 END, 6) AS roll,
       round(CASE WHEN valid THEN pitch ELSE 0 END, 6) AS pitch, round(CASE WHEN valid THEN yaw ELSE 0 END, 6) AS yaw
FROM g
"""

_BOX_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT vec_id, list_transform(range(21), lambda i: e[3 * i + 1]) AS xs, list_transform(range(21), lambda i: e[3 * i + 2]) AS ys FROM v),
b AS (
  SELECT vec_id, list_min(xs) AS ux0, list_max(xs) - list_min(xs) AS uw0,
         CAST(trunc(list_min(xs) * 640 + 320) AS BIGINT) AS x0, CAST(trunc(list_max(xs) * 640 + 320) AS BIGINT) AS x1,
         CAST(trunc(list_min(ys) * 640 + 320) AS BIGINT) AS y0, CAST(trunc(list_max(ys) * 640 + 320) AS BIGINT) AS y1
  FROM c),
m AS (SELECT *, CAST(trunc((x1 - x0) * 0.2::DOUBLE) AS BIGINT) AS mx, CAST(trunc((y1 - y0) * 0.2::DOUBLE) AS BIGINT) AS my FROM b)
SELECT vec_id AS frame_idx, greatest(0, x0 - mx) AS x, greatest(0, y0 - my) AS y, x1 - x0 + 2 * mx AS w, y1 - y0 + 2 * my AS h,
       round(greatest(0, ux0 - 0.2 * uw0), 6) AS ux, round(1.4 * uw0, 6) AS uw
FROM m
"""

_PF = ", ".join(f"round({n}, 6) AS {n}" for n in PHYSIO_FEATURES)

ORACLES = {
    "physio_windows": f"WITH {_PHYSIO_SQL} SELECT user_id, task, window_idx, t_start_s, t_end_s, {_PF} FROM physio",
    "normalized_signal": f"""WITH {SAMPLES_SQL},
        win AS (SELECT s.*, k FROM samples s, unnest({_spread(PHYSIO.length, PHYSIO.step, 'sample_idx')}) AS r(k)),
        z AS (SELECT *, count(*) OVER w AS n, avg(eda) OVER w AS m, stddev_pop(eda) OVER w AS s FROM win WINDOW w AS (PARTITION BY user_id, task, k))
        SELECT user_id, task, k AS window_idx, sample_idx, round(CASE WHEN s < 1e-6 THEN 0 ELSE (eda - m) / s END, 6) AS z FROM z WHERE n = {PHYSIO.length}""",
    "stress_scores": f"WITH {_SCORED_SQL} SELECT user_id, task, t_start_s, t_end_s, round(physio_stress_score, 6) AS physio_stress_score, ecg_quality FROM scored",
    "extraction_summary": f"""WITH {_PHYSIO_SQL}
        SELECT count(*) AS windows, count(DISTINCT user_id) AS users, count(DISTINCT task) AS tasks, round(avg(ecg_quality), 6) AS quality_mean,
               round(stddev_samp(ecg_quality), 6) AS quality_std, min(ecg_quality) AS quality_min, max(ecg_quality) AS quality_max,
               round(100.0 * count(*) FILTER (ecg_quality >= 0.5) / count(*), 6) AS pct_good, """
    + ", ".join(f"round(100.0 * count({n}) / count(*), 6) AS pct_{n}" for n in PHYSIO_FEATURES)
    + " FROM physio",
    "label_summary": f"""WITH {_SCORED_SQL}
        SELECT count(*) - count(hr) AS missing_hr, count(*) - count(sdnn) AS missing_sdnn, count(*) - count(scr_amplitude_mean) AS missing_scr_amplitude_mean,
               count(physio_stress_score) AS scored, round(avg(physio_stress_score), 6) AS score_mean, round(stddev_samp(physio_stress_score), 6) AS score_std,
               round(min(physio_stress_score), 6) AS score_min, round(max(physio_stress_score), 6) AS score_max, round(median(physio_stress_score), 6) AS score_median
        FROM scored""",
    "windows_per_task": f"WITH {FRAMES_SQL}, {_labels_sql('labels_a', 12, 3)} SELECT task, count(*) AS windows FROM labels_a GROUP BY task",
    "score_by_task": f"WITH {FRAMES_SQL}, {_labels_sql('labels_a', 12, 3)} SELECT task, round(avg(physio_stress_score), 6) AS score_mean FROM labels_a GROUP BY task",
    "exact_window_join": f"""WITH {FRAMES_SQL}, {_VIDEO_SQL}, {_labels_sql('labels_a', 12, 3)}
        SELECT v.user_id, v.task, v.t_start_s, v.t_end_s, round(level, 6) AS level, round(physio_stress_score, 6) AS physio_stress_score
        FROM video v JOIN labels_a p ON v.user_id = p.user_id AND v.task = p.task AND round(v.t_start_s * 1000) = round(p.t_start_s * 1000)""",
    "overlap_window_join": f"""WITH {FRAMES_SQL}, {_VIDEO_SQL}, {_labels_sql('labels_b', 7, 2)}, o AS ({_OVERLAP})
        SELECT user_id, task, t_start_s, t_end_s, round(level, 6) AS level, round(physio_stress_score, 6) AS physio_stress_score FROM o""",
    "match_ratio": f"""WITH {FRAMES_SQL}, {_VIDEO_SQL}, {_labels_sql('labels_a', 12, 4)},
        j AS (SELECT count(*) AS matched FROM video v JOIN labels_a p ON v.user_id = p.user_id AND v.task = p.task AND v.t_start_s = p.t_start_s)
        SELECT (SELECT count(*) FROM video) AS windows, matched, round(matched / (SELECT count(*) FROM video), 6) AS ratio FROM j""",
    "labelled_windows": f"""WITH {FRAMES_SQL}, {_VIDEO_SQL}, {_labels_sql('labels_b', 5, 4)}, o AS ({_OVERLAP})
        SELECT user_id, task, t_start_s, t_end_s, round(level, 6) AS level, round(physio_stress_score, 6) AS physio_stress_score
        FROM o WHERE physio_stress_score IS NOT NULL""",
    "spearman": """WITH r AS (
          SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
                 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
        SELECT count(*) AS n_pairs, round(corr(a, b), 6) AS spearman FROM r""",
    "average_ranks": """SELECT DISTINCT value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM events""",
    "roc_auc": """WITH d AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)),
        r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM d),
        s AS (SELECT count(*) FILTER (quality > 0) AS p, count(*) FILTER (quality = 0) AS n, sum(k) FILTER (quality > 0) AS t FROM r)
        SELECT p AS n_positive, n AS n_negative, round((t - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""",
    "session_label_join": """WITH m AS (SELECT lang AS user_id, source AS task, avg(n_chars / 1000.0) AS y_true, avg(length(text) / 900.0) AS y_pred FROM documents GROUP BY ALL),
        l AS (SELECT lang AS user_id, source AS task, max(toxic) AS binary_stress FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
        SELECT user_id, task, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred, binary_stress FROM m JOIN l USING (user_id, task)""",
    "label_counts": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "latency_stats": """SELECT round(avg(value), 6) AS mean, max(value) AS max, count(value) AS count, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events""",
    "sketched_latency": """WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value FROM events UNION ALL SELECT 'all', value FROM events)
        SELECT day, count(value) AS count, round(avg(value), 6) AS mean, max(value) AS max, true AS median_close, true AS p95_close, true AS p99_close
        FROM v GROUP BY day HAVING count(value) > 0""",
    "frame_geometry": _GEOMETRY_SQL,
    "face_boxes": _BOX_SQL,
    "collected_rows": f"""WITH {_COLLECTED_SQL} SELECT participant_id AS user_id, timestamp, window_index, CASE WHEN label = 'high' THEN 1 ELSE 0 END AS label,
        difficulty, task_type, blink_rate, ear_std, perclos, 'train' AS role FROM collected""",
    "collected_counts": f"""WITH {_COLLECTED_SQL} SELECT participant_id, count(*) AS total_samples, count(*) FILTER (label = 'low') AS low, count(*) FILTER (label = 'high') AS high,
        count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard
        FROM collected GROUP BY participant_id""",
    "json_records": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE NOT value > 300",
    "split_labels": """WITH p AS (SELECT replace(p_name, ' ', '_') || '_' || p_type AS s, p_partkey FROM part)
        SELECT split_part(s, '_', 1) AS user_id, substr(s, instr(s, '_') + 1) AS task, p_partkey AS binary_stress FROM p""",
    "task_names": """SELECT doc_id, CASE WHEN lang = 'en' THEN list_extract(string_split(source, '_'), -1) ELSE CAST(doc_id AS VARCHAR) END AS training_task,
        CASE WHEN n_chars > 5000 THEN 'Own' WHEN lang <> 'en' THEN substr(source || '_' || lang || '_' || doc_id, instr(source || '_' || lang || '_' || doc_id, '_') + 1)
             WHEN instr(source, '_') > 0 THEN substr(source, instr(source, '_') + 1) ELSE 'unknown' END AS task FROM documents""",
    "scalar_functions": f"""WITH {EVENTS_SQL}, v AS (SELECT *, value / 100.0 AS x FROM ev)
        SELECT event_id, round(1 / (1 + exp(-(x - 0.5))), 6) AS sigmoid, round(least(greatest(x, 0.2), 1.0), 6) AS clipped,
               round(CASE WHEN k IN (5, 6) THEN 0 ELSE x END, 6) AS safe, round(CASE WHEN k IN (5, 6) THEN NULL ELSE x END, 6) AS finite,
               CASE WHEN x < 0.4 THEN 'low' WHEN x < 0.7 THEN 'medium' ELSE 'high' END AS level,
               CASE WHEN k = 5 THEN 'unknown' WHEN x < 0.21 THEN 'closed' WHEN x < 0.25 THEN 'partial' ELSE 'open' END AS eye,
               x < 0.95 AS low_ratio, value > 28 AS unstable, 5.5::DOUBLE + k AS exposure FROM v""",
    "vector_inputs": f"WITH {_COLLECTED_SQL} SELECT window_index, ear_std, blink_rate, perclos FROM collected",
    "answer_scores": """SELECT p_partkey, lower(p_type) = lower(split_part(p_name, ' ', 1)) AS name_right, true AS type_right FROM part""",
    "record_names": """WITH o AS (SELECT *, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS n, epoch_ms(o_orderdate) AS ms FROM orders)
        SELECT o_orderkey, 'C' || o_custkey || '_s' || n || '_adaptive_' || ms AS session_id, 'C' || o_custkey || '_d' || n || '_baseline_' || ms AS delayed_id,
               array_to_string(string_split(o_orderpriority, '-')[1:2], '-') AS grp, o_orderstatus || '-g' AS item_group,
               o_orderstatus || '|' || o_orderpriority AS choices FROM o""",
    "stacked_windows": f"""WITH {FRAMES_SQL}, {_labels_sql('labels_a', 12, 3)}, {_labels_sql('labels_b', 7, 2)},
        u AS (SELECT *, 'a' AS origin FROM labels_a UNION ALL SELECT *, 'b' AS origin FROM labels_b)
        SELECT user_id, task, t_start_s, t_end_s, round(physio_stress_score, 6) AS physio_stress_score, origin FROM u""",
}
