"""How the given tables stand in for frames, signals, sessions and labels.

Each mapping exists twice: as a DataFrame and as a SQL fragment for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, PhysioConfig
from tidemark.operators.sequence import number_chunk, with_index

DAY_US = 86_400_000_000
# Fixed value: 2024-01-01 in microseconds, the first day of the events table.
EPOCH_2024_US = 1_704_067_200_000_000

# One event stands for one frame per second.
VIDEO = FeatureConfig(
    fps=1.0, length_s=12.0, step_s=3.0, max_bad_ratio=0.2, min_blink_ms=1000, max_blink_ms=4000, max_gap=1
)
# Two samples per second.
PHYSIO = PhysioConfig(
    rate=2,
    length_s=10.0,
    step_s=2.5,
    ecg_half_width=1,
    eda_half_width=1,
    resp_half_width=1,
    tonic_half_width=3,
    ecg_height=0.25,
    scr_height=0.1,
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str):
    """A zone-less timestamp read as UTC, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", start, F.col(column).cast("timestamp_ntz")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events").withColumn("ts", instant("ts"))
    day = F.floor((F.unix_micros("ts") - EPOCH_2024_US) / F.lit(float(DAY_US)))
    return df.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "ts",
        F.unix_micros("ts").alias("ts_us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(day < 10, "Relax").when(day < 20, "Math").otherwise("Speaking").alias("task"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS ts_us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'Relax'
              WHEN ts < TIMESTAMP '2024-01-21' THEN 'Math' ELSE 'Speaking' END AS task
  FROM events)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    day = number_chunk("ts_us", DAY_US)
    indexed = with_index(df, ["user_id", "task"], ["ts_us", "event_id"], day, "frame_idx")
    value, k = F.col("value"), F.col("k")
    return indexed.select(
        "user_id",
        "task",
        "frame_idx",
        F.when(k != 7, value / F.lit(70.0)).alias("ear_mean"),
        (k * F.lit(2.5)).alias("brightness"),
        (k / F.lit(100.0)).alias("quality"),
        (k / F.lit(50.0)).alias("eye_center_x"),
        (value / F.lit(500.0)).alias("eye_center_y"),
        F.when(k != 11, F.ln(F.lit(1.0) + value)).alias("mouth_mar"),
        F.sin(value).alias("roll"),
        F.cos(value).alias("pitch"),
        F.sin(k.cast("double")).alias("yaw"),
        (F.col("event_type") != "error").alias("valid"),
    )


FRAMES_SQL = (
    EVENTS_SQL
    + """,
frames AS (
  SELECT user_id, task,
         row_number() OVER (PARTITION BY user_id, task ORDER BY ts_us, event_id) - 1 AS frame_idx,
         CASE WHEN k <> 7 THEN value / 70.0 END AS ear_mean, k * 2.5::DOUBLE AS brightness, k / 100.0 AS quality,
         k / 50.0 AS eye_center_x, value / 500.0 AS eye_center_y,
         CASE WHEN k <> 11 THEN ln(1.0 + value) END AS mouth_mar,
         sin(value) AS roll, cos(value) AS pitch, sin(CAST(k AS DOUBLE)) AS yaw,
         event_type <> 'error' AS valid
  FROM ev)
"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    day = number_chunk("ts_us", DAY_US)
    indexed = with_index(df, ["user_id"], ["ts_us", "event_id"], day, "sample_idx")
    return indexed.select(
        "user_id",
        F.lit("Rest").alias("task"),
        "sample_idx",
        F.when(F.col("k") != 3, F.col("value")).alias("ECG"),
        F.col("k").cast("double").alias("EDA"),
        (F.col("value") - F.col("k")).alias("RR"),
    )


SAMPLES_SQL = (
    EVENTS_SQL
    + """,
samples AS (
  SELECT user_id, 'Rest' AS task,
         row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS sample_idx,
         CASE WHEN k <> 3 THEN value END AS ecg, CAST(k AS DOUBLE) AS eda, value - k AS rr
  FROM ev)
"""
)

# --- study records -------------------------------------------------------------------------------


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat trials: one line item is one trial of the session that its order stands for."""
    line = load(spark, sf_dir, "lineitem").withColumn("at", instant("l_shipdate"))
    flag, easy = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    kind = F.when(flag == "A", "learning").when(flag == "N", "recognition").otherwise("cued_recall")
    tail = F.when(flag == "A", "").when(flag == "N", "_recognition").otherwise("_cued_recall")
    level = F.when(easy, "easy").otherwise("hard")
    return line.select(
        F.col("l_orderkey").alias("record_id"),
        F.concat_ws("_", F.lit("t"), "l_linenumber", "l_partkey", "l_suppkey").alias("trial_id"),
        F.unix_millis("at").alias("timestamp_ms"),
        (F.col("l_linenumber") * F.lit(1.5)).alias("session_time_s"),
        F.concat(F.when(flag == "A", "learning_").otherwise("test_"), level, tail).alias("phase"),
        kind.alias("kind"),
        level.alias("difficulty"),
        F.when(easy, 1).otherwise(2).alias("block_index"),
        F.concat_ws("-", F.lit("P"), (F.col("l_partkey") % 7).cast("string"), F.lit("x")).alias("item_id"),
        F.concat(F.lit("c"), F.col("l_partkey") % 7).alias("cue"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("target"),
        F.when(flag == "N", F.array(F.lit("a"), F.col("l_linenumber").cast("string"))).alias("recognition_choices"),
        F.when(flag == "N", F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))).alias("selected_choice"),
        F.when(flag == "R", F.lit("answer, \"quoted\"")).alias("response_text"),
        (F.col("l_discount") <= 0.05).alias("correct"),
        (F.col("l_quantity") * F.lit(100.0)).alias("reaction_time_ms"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )


TRIALS_SQL = """
trials AS (
  SELECT l_orderkey AS record_id, concat_ws('_', 't', l_linenumber, l_partkey, l_suppkey) AS trial_id,
         epoch_ms(l_shipdate) AS timestamp_ms, l_linenumber * 1.5::DOUBLE AS session_time_s,
         CASE l_returnflag WHEN 'A' THEN 'learning_' ELSE 'test_' END
           || CASE WHEN l_linestatus = 'O' THEN 'easy' ELSE 'hard' END
           || CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN '_recognition' ELSE '_cued_recall' END AS phase,
         CASE l_returnflag WHEN 'A' THEN 'learning' WHEN 'N' THEN 'recognition' ELSE 'cued_recall' END AS kind,
         CASE WHEN l_linestatus = 'O' THEN 'easy' ELSE 'hard' END AS difficulty,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS block_index,
         concat_ws('-', 'P', l_partkey % 7, 'x') AS item_id, 'c' || (l_partkey % 7) AS cue,
         't' || l_suppkey AS target,
         CASE WHEN l_returnflag = 'N' THEN 'a|' || l_linenumber ELSE '' END AS recognition_choices,
         CASE WHEN l_returnflag = 'N' THEN 't' || l_suppkey ELSE '' END AS selected_choice,
         CASE WHEN l_returnflag = 'R' THEN 'answer, "quoted"' ELSE '' END AS response_text,
         l_discount <= 0.05 AS correct, l_quantity * 100.0 AS reaction_time_ms,
         l_discount AS discount, l_tax AS tax, l_quantity AS quantity
  FROM lineitem)
"""


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controller events: the line items with the two highest tax rates."""
    return (
        trials(spark, sf_dir)
        .where("tax >= 0.065")
        .select(
            "record_id",
            "timestamp_ms",
            "phase",
            F.when(F.col("tax") >= 0.075, "applied").otherwise("dismissed").alias("outcome"),
        )
    )


INTERVENTIONS_SQL = (
    TRIALS_SQL
    + """,
interventions AS (
  SELECT record_id, timestamp_ms, phase, CASE WHEN tax >= 0.075 THEN 'applied' ELSE 'dismissed' END AS outcome
  FROM trials WHERE tax >= 0.065)
"""
)


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final session rows: one order is one session of its customer."""
    orders = load(spark, sf_dir, "orders").withColumn("at", instant("o_orderdate"))
    return orders.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("participant_id"),
        (F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)).alias("session_number"),
        F.unix_millis("at").alias("started_at"),
        (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("completed_at"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") != "F").alias("delayed_pending"),
        (F.unix_millis("at") + 7 * 86_400_000).alias("delayed_due_at"),
        F.col("o_totalprice").alias("price"),
    )


FINALS_SQL = """
finals AS (
  SELECT o_orderkey AS record_id, o_custkey AS participant_id,
         CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS session_number,
         epoch_ms(o_orderdate) AS started_at, epoch_ms(o_orderdate) + 3600000 AS completed_ms,
         o_orderstatus AS status, o_orderstatus <> 'F' AS delayed_pending,
         epoch_ms(o_orderdate) + 7 * 86400000 AS delayed_due_at, o_totalprice AS price
  FROM orders)
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested session records: an order with its lines as trials, scores and interventions.

    Gathering the lines of one order builds one document; its lists are as long as an order has lines.
    """
    t = trials(spark, sf_dir)
    leading = ["timestamp_ms", "trial_id"]
    entry = F.struct(*leading, *[c for c in t.columns if c not in [*leading, "record_id"]])
    lines = t.withColumn("e", entry).groupBy("record_id").agg(F.sort_array(F.collect_list("e")).alias("lines"))
    head = finals(spark, sf_dir)

    def listed(make, keep=None):
        return F.transform(F.col("lines") if keep is None else F.filter("lines", keep), make)

    def trial(e):
        return F.struct(
            e["trial_id"].alias("trialId"),
            e["timestamp_ms"].alias("timestampMs"),
            e["session_time_s"].alias("sessionTimeS"),
            e["phase"].alias("phase"),
            e["kind"].alias("kind"),
            e["difficulty"].alias("difficulty"),
            e["block_index"].alias("blockIndex"),
            e["item_id"].alias("itemId"),
            e["cue"].alias("cue"),
            e["target"].alias("target"),
            e["recognition_choices"].alias("recognitionChoices"),
            e["selected_choice"].alias("selectedChoice"),
            e["response_text"].alias("responseText"),
            e["correct"].alias("correct"),
            e["reaction_time_ms"].alias("reactionTimeMs"),
        )

    def sample(e):
        return F.struct(
            e["timestamp_ms"].alias("timestampMs"),
            e["session_time_s"].alias("sessionTimeS"),
            e["phase"].alias("phase"),
            (e["discount"] * 10).alias("rawCli"),
            (e["discount"] * 5).alias("smoothedCli"),
            (F.lit(1.0) - e["tax"]).alias("validFrameRatio"),
            e["quantity"].alias("illuminationStd"),
            F.struct(
                (F.lit(1.0) - e["tax"] < 0.955).alias("lowValidFrameRatio"),
                (e["quantity"] > 28).alias("unstableIllumination"),
            ).alias("qualityFlags"),
        )

    def event(e):
        return F.struct(
            e["timestamp_ms"].alias("timestampMs"),
            e["session_time_s"].alias("sessionTimeS"),
            e["phase"].alias("phase"),
            F.lit("micro_break_60s").alias("type"),
            F.when(e["tax"] >= 0.075, "applied").otherwise("dismissed").alias("outcome"),
            (e["discount"] * 10).alias("cli"),
            (e["discount"] * 5).alias("smoothedCli"),
            (F.lit(1.0) - e["tax"]).alias("validFrameRatio"),
            F.when(e["tax"] >= 0.075, F.lit("break taken")).alias("details"),
        )

    tlx = F.struct(
        *[
            (F.col("price") / d).alias(n)
            for n, d in (
                ("mentalDemand", 3e4),
                ("physicalDemand", 7e4),
                ("temporalDemand", 9e4),
                ("performance", 1.1e5),
                ("effort", 1.3e5),
                ("frustration", 1.7e5),
            )
        ]
    )
    return head.join(lines, "record_id").select(
        F.col("record_id").alias("recordId"),
        F.col("participant_id").alias("participantId"),
        F.col("session_number").alias("sessionNumber"),
        F.when(F.col("record_id") % 2 == 0, "adaptive").otherwise("baseline").alias("condition"),
        F.when(F.col("record_id") % 2 == 0, "A").otherwise("B").alias("form"),
        F.col("started_at").alias("startedAtIso"),
        F.when(F.col("status") != "P", F.col("started_at").cast("string")).alias("completedAtIso"),
        F.lit(False).alias("session2StartedEarlyOverride"),
        (F.col("price") / 100).alias("totalSessionSeconds"),
        (F.col("price") / 200).alias("activeTaskSeconds"),
        (F.col("price") / 400).alias("breakSeconds"),
        listed(sample, lambda e: e["kind"] == "learning").alias("cliSamples"),
        listed(event, lambda e: e["tax"] >= 0.065).alias("interventions"),
        F.transform("lines", trial).alias("trials"),
        F.when(F.col("status") == "F", tlx).alias("nasaTlx"),
        F.col("delayed_pending").alias("pendingDelayedTest"),
        F.col("delayed_due_at").alias("delayedDueAtIso"),
    )


def delayed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed tests of the closed sessions: their question trials."""
    return (
        sessions(spark, sf_dir)
        .where("not pendingDelayedTest")
        .select(
            F.concat(F.lit("d"), F.col("recordId").cast("string")).alias("recordId"),
            F.col("recordId").alias("linkedSessionRecordId"),
            "participantId",
            "sessionNumber",
            "condition",
            "form",
            F.col("delayedDueAtIso").alias("dueAtIso"),
            "completedAtIso",
            F.filter("trials", lambda t: t["kind"] != "learning").alias("trials"),
        )
    )


SESSIONS_SQL = (
    TRIALS_SQL
    + ","
    + FINALS_SQL
    + """,
heads AS (
  SELECT f.*, CASE WHEN record_id % 2 = 0 THEN 'adaptive' ELSE 'baseline' END AS condition,
         CASE WHEN record_id % 2 = 0 THEN 'A' ELSE 'B' END AS form
  FROM finals f),
lined AS (SELECT h.* FROM heads h WHERE EXISTS (SELECT 1 FROM trials t WHERE t.record_id = h.record_id)),
flat AS (
  SELECT h.participant_id, h.session_number, h.condition, h.form, h.delayed_pending, h.delayed_due_at,
         h.status, h.started_at, t.*
  FROM heads h JOIN trials t USING (record_id))
"""
)
