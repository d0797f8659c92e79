"""Streams whose rows arrive in any order, dealt to files by their times of receipt; each equals a query of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.operators.features import window_features
from tidemark.plans.streams import _LIVE_SQL, _SCORES_SQL, LIVE, ORACLES as STREAMS
from tidemark.plans.study import _WRITES_SQL, _writes
from tidemark.plans.tables import EVENTS_SQL, FRAMES_SQL, events, frames, rounded
from tidemark.plans.video import _round
from tidemark.sources.writers import shared_folder, staged
from tidemark.streaming.arrival import session_ends
from tidemark.streaming.frames import FRAME_VALUES, without_repeats
from tidemark.streaming.jobs import replay_files, run_available
from tidemark.streaming.live import live_scores, live_windows
from tidemark.streaming.upsert import Snapshots

#: Frames are received up to five seconds after their time, in an order of their own.
LATENESS_S, SLOT_S = 6.0, 3.0
GAP_S, HOUR = 8 * 3600.0, 3600.0
CALM = 2


def _arriving_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.round(F.col("brightness") / F.lit(2.5))
    return frames(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "task").alias("session_id"),
        F.col("frame_idx").cast("double").alias("at"),
        *FRAME_VALUES,
        "valid",
        (F.col("frame_idx") + k % 6).cast("double").alias("received"),
    )


def _replayed(df: DataFrame, name: str) -> DataFrame:
    return replay_files(df, "received", shared_folder(df.sparkSession, name))


def reordered_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live windows of sessions whose frames are dealt to files and micro-batches in the order of their receipt."""
    stream = _replayed(_arriving_frames(spark, sf_dir), "frames")
    windows = live_windows(stream, LIVE, LATENESS_S, None, slot_s=SLOT_S)
    out = run_available(windows, "reordered")
    return rounded(out.select("session_id", "t_start_s", "t_end_s", *LIVE.model_features, *LIVE.monitoring_features))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: some are received within the hour, every seventeenth kind three hours after its time."""
    at = F.col("ts_us") / F.lit(1e6)
    delay = F.when(F.col("k") % 17 == 3, 3 * HOUR).otherwise((F.col("k") % 5) * F.lit(600.0))
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), at.alias("at"), (at + delay).alias("received"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _replayed(_messages(spark, sf_dir), "messages")
    return run_available(session_ends(stream, lateness_s=HOUR, gap_s=GAP_S, slot_s=6 * HOUR), "ends")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream as they end: rows on time with gaps of at most eight hours."""
    out = _ends(spark, sf_dir).where("kind = 'session'")
    return rounded(out.select("session_id", "started_s", "ended_s", "n_rows"))


def late_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on time and late rows of each user of a stream."""
    return _ends(spark, sf_dir).groupBy("session_id").agg(F.sum("n_rows").alias("on_time"), F.sum("n_late").alias("late"))


def _load_model(spark: SparkSession, sf_dir: str) -> learning.Artifacts:
    """A ridge on the centred closure of the calibrated windows, saved and read back."""
    windows = staged(window_features(frames(spark, sf_dir), LIVE), "windows")
    ranked = windows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "task").orderBy("t_start_s")))
    calm = ranked.where(F.col("rn") <= CALM).groupBy("user_id", "task").agg(F.median("perclos").alias("calm"))
    rows = ranked.where(F.col("rn") > CALM).join(calm, ["user_id", "task"])
    rows = rows.select((F.col("perclos") - F.col("calm")).alias("perclos_centered"), (F.col("mean_brightness") / 250.0).alias("y"))
    model = learning.fit_regression(staged(rows, "calibrated"), ["perclos_centered"], "y", "ridge", alpha=10.0)
    path = shared_folder(spark, "model")
    spec = learning.feature_spec(["perclos_centered"], ["perclos"], "y")
    learning.save_model(learning.Artifacts(model, spec, {"model_type": "ridge"}), spark, path)
    return learning.load_model(spark, path)


def _condition() -> Column:
    return F.when(F.split("session_id", "/")[0].cast("long") % 3 == 0, "baseline").otherwise("adaptive")


def live_load_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in any order to smoothed load and controller actions, in one streaming query with a saved model."""
    stream = _replayed(_arriving_frames(spark, sf_dir), "frames")
    scores = live_scores(
        stream, _load_model(spark, sf_dir), _condition(), LIVE, n_windows=CALM, lateness_s=LATENESS_S, gap_s=60.0, slot_s=SLOT_S
    )
    out = run_available(scores, "scores")
    return rounded(
        out.select(
            "session_id", "timestamp_ms", "raw_cli", "smoothed_cli", "low_vfr_flag", "unstable_illumination_flag", "event_type", "low_confidence",
            "pacing_offset_s",
        )
    )


def deduplicated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a stream in which every third frame is received again, up to five seconds later."""
    sent = _arriving_frames(spark, sf_dir).select("session_id", "at", "ear_mean", "valid", "received")
    again = sent.where(F.col("at") % 3 == 0).withColumn("received", F.col("received") + F.col("at") % 6)
    stream = _replayed(sent.unionByName(again), "repeated")
    return run_available(without_repeats(stream), "deduplicated").where("session_id is not null").drop("received")


def upserted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts and final writes of a stream in any order, the third micro-batch run twice."""
    drafts, stored, written = _writes(spark, sf_dir)
    parts = (("draft", drafts, F.lit(None)), ("final", stored, F.lit(0)), ("final", written, F.col("write_seq")))
    rows = [d.select("record_id", F.lit(kind).alias("kind"), "saved_at", n.cast("int").alias("write_seq")) for kind, d, n in parts]
    writes = rows[0].union(rows[1]).union(rows[2])
    writes = writes.withColumn("received", F.pmod(F.xxhash64("record_id", "saved_at"), F.lit(1000)).cast("double"))
    stream = _replayed(writes, "writes").drop("received")
    path = shared_folder(spark, "records")
    table = Snapshots(spark, path, stream.schema, 8)

    def merge(batch: DataFrame, number: int) -> None:
        for _ in range(1 + (number == 2)):
            table.merge(batch, number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read().drop("write_seq")


QUERIES = {
    "upserted_sessions": upserted_sessions,
    "reordered_window_features": reordered_window_features,
    "closed_sessions": closed_sessions,
    "late_row_counts": late_row_counts,
    "live_load_scores": live_load_scores,
    "deduplicated_frames": deduplicated_frames,
}

_MESSAGES_SQL = f"{EVENTS_SQL}, messages AS (SELECT user_id, ts_us / 1e6::DOUBLE AS t, k % 17 = 3 AS late FROM ev)"
_ALL = [*LIVE.model_features, *LIVE.monitoring_features]
_CHAIN_SQL = f"""{_LIVE_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY t_start_s) AS rn FROM wide),
calm AS (SELECT user_id, task, median(perclos) AS calm FROM ranked WHERE rn <= {CALM} GROUP BY ALL),
fitted AS (SELECT r.*, perclos - calm AS x, mean_brightness / 250.0 AS y FROM ranked r JOIN calm USING (user_id, task) WHERE rn > {CALM}),
moments AS (SELECT count(*) AS c, avg(x) AS mx, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sx, avg(y) AS my, covar_pop(x, y) AS xy FROM fitted),
scores AS (
  SELECT user_id || '/' || task AS user_id, CASE WHEN user_id % 3 = 0 THEN 'baseline' ELSE 'adaptive' END AS condition,
         CAST(round((t_end_s - 1) * 1000) AS BIGINT) AS ms, rn - {CALM + 1} AS n,
         least(greatest(my + (x - mx) / sx * (c * xy / sx) / (c + 10), 0), 1) AS cli, valid_frame_ratio AS ratio, std_brightness AS light, true AS learning
  FROM fitted, moments),
""" + _SCORES_SQL[_SCORES_SQL.index("fed AS ("):]
_SMOOTHED_SQL = STREAMS["streamed_scores"].split(_SCORES_SQL, 1)[1]

ORACLES = {
    "upserted_sessions": f"""WITH {_WRITES_SQL} SELECT record_id, 'final' AS kind, saved_at FROM merged
        UNION ALL SELECT record_id, 'draft', max(saved_at) FROM drafts WHERE record_id NOT IN (SELECT record_id FROM merged) GROUP BY record_id""",
    "reordered_window_features": f"WITH {_LIVE_SQL} SELECT user_id || '/' || task AS session_id, t_start_s, t_end_s, {_round(_ALL)} FROM wide",
    "closed_sessions": f"""WITH {_MESSAGES_SQL},
        steps AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {GAP_S}, true) AS opens FROM messages WHERE NOT late),
        numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM steps)
        SELECT CAST(user_id AS VARCHAR) AS session_id, round(min(t), 6) AS started_s, round(max(t), 6) AS ended_s, count(*) AS n_rows
        FROM numbered GROUP BY user_id, s""",
    "late_row_counts": f"""WITH {_MESSAGES_SQL} SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (NOT late) AS on_time,
        count(*) FILTER (late) AS late FROM messages GROUP BY user_id""",
    "live_load_scores": f"WITH RECURSIVE {_CHAIN_SQL}{_SMOOTHED_SQL}".replace(
        "round(y, 6) AS smoothed_cli", "round(raw, 6) AS raw_cli, round(y, 6) AS smoothed_cli"
    ).replace("SELECT s.user_id, s.n, s.ms, y, ratio", "SELECT s.user_id, s.n, s.ms, y, cli AS raw, ratio"),
    "deduplicated_frames": f"WITH {FRAMES_SQL} SELECT user_id || '/' || task AS session_id, CAST(frame_idx AS DOUBLE) AS at, ear_mean, valid FROM frames",
}
