"""Study protocol and session analytics: assignment, timing, summaries and record storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyPlan
from tidemark.functions.numeric import as_column, ratio
from tidemark.functions.text import interference_group, normalize_answer, uint32_hash
from tidemark.operators.sequence import latest_per_key, key_join, time_chunk, with_previous

# Internal session phases and the tags stored with samples and trials.
PHASE_TAGS = {
    "baseline": "baseline_calibration",
    "learn_easy": "learning_easy",
    "test_easy_recognition": "test_easy_recognition",
    "test_easy_cued": "test_easy_cued_recall",
    "learn_hard": "learning_hard",
    "test_hard_recognition": "test_hard_recognition",
    "test_hard_cued": "test_hard_cued_recall",
    "break": "break",
    "nasa_tlx": "nasa_tlx",
    "complete": "complete",
}
LEARNING_PHASES = ("learn_easy", "learn_hard")
TASK_PHASES = (
    "learn_easy",
    "learn_hard",
    "test_easy_recognition",
    "test_easy_cued",
    "test_hard_recognition",
    "test_hard_cued",
)
BLOCK_TAGS = {
    1: ("learning_easy", "test_easy_recognition", "test_easy_cued_recall"),
    2: ("learning_hard", "test_hard_recognition", "test_hard_cued_recall"),
}


def phase_tag(phase: Column | str) -> Column:
    pairs = [F.lit(x) for kv in PHASE_TAGS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), as_column(phase))


def is_learning_phase(phase: Column | str) -> Column:
    return as_column(phase).isin(list(LEARNING_PHASES))


def is_task_phase(phase: Column | str) -> Column:
    return as_column(phase).isin(list(TASK_PHASES))


def block_of_tag(tag: Column | str) -> Column:
    tag = as_column(tag)
    return F.when(tag.isin(list(BLOCK_TAGS[1])), 1).when(tag.isin(list(BLOCK_TAGS[2])), 2)


# --- crossover assignment and timing -------------------------------------------------------------


def assign_participants(
    df: DataFrame,
    participant: str = "participant_id",
    session: str = "session_number",
    now: Column | None = None,
    plan: StudyPlan = StudyPlan(),
) -> DataFrame:
    """Condition and form per participant and session, crossed over by the parity of the id's hash."""
    now = F.current_timestamp() if now is None else now
    even = F.col("hash_value") % 2 == 0
    orders = {
        "condition_order": ("adaptive", "baseline"),
        "form_order": ("A", "B"),
    }
    place = F.when(F.col(session) == 1, 0).otherwise(1)
    out = df.withColumn("participant_normalized", normalize_answer(participant)).withColumn(
        "hash_value", uint32_hash("participant_normalized")
    )
    out = out.withColumn("hash_parity", F.when(even, "even").otherwise("odd"))
    for name, (a, b) in orders.items():
        out = out.withColumn(
            name, F.when(even, F.array(F.lit(a), F.lit(b))).otherwise(F.array(F.lit(b), F.lit(a)))
        )
    return out.withColumns(
        {
            "condition": F.get("condition_order", place),
            "form": F.get("form_order", place),
            "delayed_due_at": now + F.make_dt_interval(F.lit(plan.delayed_test_days)),
        }
    )


def recent_sessions(finals: DataFrame, session_number: int | None = None) -> DataFrame:
    """Latest final session per participant, optionally of one session number."""
    if session_number is not None:
        finals = finals.where(F.col("session_number") == session_number)
    return latest_per_key(finals, ["participant_id"], [F.desc("started_at"), F.desc("record_id")])


def session_timing(
    requests: DataFrame,
    finals: DataFrame,
    now: Column | None = None,
    plan: StudyPlan = StudyPlan(),
) -> DataFrame:
    """Hours since the participant's last completed first session and whether a start is allowed.

    ``requests`` has participant_id, session_number and allow_early. Only a second session is checked;
    the override is recorded only where it made a difference.
    """
    now = F.current_timestamp() if now is None else now
    first = recent_sessions(finals, 1).select("participant_id", F.col("completed_at").alias("_done"))
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_done").cast("timestamp"))
    hours = F.when(F.col("session_number") == 2, micros / F.lit(3.6e9))
    early = F.coalesce(F.col("hours_since_first") < plan.min_hours_between_sessions, F.lit(False))
    return (
        key_join(requests, first, ["participant_id"], "left")
        .withColumn("hours_since_first", hours)
        .withColumn("too_early", early)
        .withColumn("can_start", ~F.col("too_early") | F.col("allow_early") | (F.col("session_number") == 1))
        .withColumn(
            "early_override",
            F.when(F.col("session_number") == 2, F.col("allow_early") & F.col("too_early")).otherwise(F.lit(False)),
        )
        .drop("_done")
    )


# --- record storage ------------------------------------------------------------------------------


def finalize(
    drafts: DataFrame, finals: DataFrame, written: DataFrame, order: str = "saved_at", sequence: str = "write_seq"
) -> tuple[DataFrame, DataFrame]:
    """New snapshots of drafts and finals: a final write replaces the stored record and removes the draft.

    A write wins whatever the stamps; of several writes of a record the one with the highest ``sequence`` stays.
    """
    last = latest_per_key(written, ["record_id"], [F.desc(sequence)]).drop(sequence)
    kept = key_join(finals, last.select("record_id"), ["record_id"], "left_anti")
    merged = kept.unionByName(last, allowMissingColumns=True)
    open_drafts = key_join(
        latest_per_key(drafts, ["record_id"], [F.desc(order)]), merged.select("record_id"), ["record_id"], "left_anti"
    )
    return open_drafts, merged


def clear_pending(finals: DataFrame, delayed: DataFrame) -> DataFrame:
    """Finals whose pending flag is cleared once a delayed result refers to them."""
    linked = delayed.select(F.col("linked_record_id").alias("record_id")).distinct().withColumn("_seen", F.lit(True))
    return (
        key_join(finals, linked, ["record_id"], "left")
        .withColumn("delayed_pending", F.col("delayed_pending") & F.col("_seen").isNull())
        .drop("_seen")
    )


def pending_tests(finals: DataFrame, delayed: DataFrame, participant: str | None = None) -> DataFrame:
    """Final sessions that still wait for their delayed test, in order of the due date."""
    waiting = finals.where("delayed_pending")
    if participant is not None:
        waiting = waiting.where(F.col("participant_id") == participant)
    results = delayed.select(F.col("linked_record_id").alias("record_id"))
    return key_join(waiting, results, ["record_id"], "left_anti").orderBy("delayed_due_at", "record_id")


def list_sessions(sessions: DataFrame, participant: str | None = None, order: str = "started_at") -> DataFrame:
    if participant is not None:
        sessions = sessions.where(F.col("participant_id") == participant)
    return sessions.orderBy(order, "record_id")


# --- trials --------------------------------------------------------------------------------------


def trial_timing(df: DataFrame, at: str, session_start: str, question_start: str) -> DataFrame:
    """Seconds into the session and reaction time in ms; learning trials are right by definition."""

    def ms(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1000.0)

    learning = F.col("kind") == "learning"
    return df.withColumns(
        {
            "session_time_s": (ms(at) - ms(session_start)) / 1000.0,
            "reaction_time_ms": F.when(learning, F.lit(0.0)).otherwise(ms(at) - ms(question_start)),
        }
    )


def _accuracy(kind: str) -> Column:
    of_kind = F.col("kind") == kind
    return ratio(F.count(F.when(of_kind & F.col("correct"), 1)), F.count(F.when(of_kind, 1)))


def _mean_rt(kind: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("reaction_time_ms"))), F.lit(0.0))


def block_summaries(trials: DataFrame, interventions: DataFrame, exposures: DataFrame | None = None) -> DataFrame:
    """One row per session and block: accuracies, reaction times, items and adaptation.

    ``exposures`` (record_id, block_index, effective_exposure_seconds) is optional.
    """
    keys = ["record_id", "block_index"]
    summary = trials.groupBy(*keys).agg(
        F.min("difficulty").alias("difficulty"),
        F.count(F.when(F.col("kind") == "learning", 1)).alias("learning_item_count"),
        _accuracy("recognition").alias("recognition_accuracy"),
        _mean_rt("recognition").alias("recognition_mean_rt_ms"),
        _accuracy("cued_recall").alias("cued_recall_accuracy"),
        _mean_rt("cued_recall").alias("cued_recall_mean_rt_ms"),
    )
    adapted = (
        interventions.where(F.col("outcome") == "applied")
        .select("record_id", block_of_tag("phase").alias("block_index"))
        .where("block_index is not null")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    out = key_join(summary, adapted, keys, "left")
    out = out.withColumn("adaptation_applied", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return out if exposures is None else key_join(out, exposures, keys, "left")


def replace_block_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new summary of a block takes the place of the old one."""
    keys = ["record_id", "block_index"]
    kept = key_join(old, new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def session_summaries(trials: DataFrame, interventions: DataFrame, cli_samples: DataFrame) -> DataFrame:
    """One row per session: accuracies, applied interventions and scored windows."""
    base = trials.groupBy("record_id").agg(
        _accuracy("recognition").alias("recognition_accuracy"),
        _accuracy("cued_recall").alias("cued_recall_accuracy"),
    )
    applied = interventions.where(F.col("outcome") == "applied").groupBy("record_id").agg(
        F.count("*").alias("intervention_count")
    )
    scored = cli_samples.groupBy("record_id").agg(F.count("*").alias("scored_windows"))
    out = key_join(key_join(base, applied, ["record_id"], "left"), scored, ["record_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("intervention_count", "scored_windows")})


def delayed_summaries(trials: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per delayed test: accuracy and mean reaction time of both kinds of question."""
    return trials.groupBy(key).agg(
        _accuracy("recognition").alias("recognition_accuracy"),
        _mean_rt("recognition").alias("recognition_mean_rt_ms"),
        _accuracy("cued_recall").alias("cued_recall_accuracy"),
        _mean_rt("cued_recall").alias("cued_recall_mean_rt_ms"),
    )


def first_seen_items(trials: DataFrame, order: Sequence[str] = ("timestamp_ms", "trial_id")) -> DataFrame:
    """Learning items of a session at their first showing."""
    learning = trials.where(F.col("kind") == "learning")
    first = latest_per_key(learning, ["record_id", "item_id"], [F.asc(c) for c in order])
    return first.select(
        "record_id", "item_id", "cue", "target", "difficulty", interference_group("item_id").alias("interference_group")
    )


def delayed_packets(sessions: DataFrame) -> DataFrame:
    """Item lists of the delayed test, taken from each nested session record without a shuffle."""
    learning = F.filter("trials", lambda t: t["kind"] == "learning")
    distinct = F.filter(
        "_learning",
        lambda t, i: ~F.exists(F.slice("_learning", 1, i), lambda u: u["itemId"] == t["itemId"]),
    )
    items = F.transform(
        "_learning",
        lambda t: F.struct(
            t["itemId"].alias("id"),
            t["cue"].alias("cue"),
            t["target"].alias("target"),
            t["difficulty"].alias("difficulty"),
            F.substring_index(t["itemId"], "-", 2).alias("interferenceGroup"),
        ),
    )

    def of(level: str) -> Column:
        return F.filter("_items", lambda x: x["difficulty"] == level)

    return (
        sessions.withColumn("_learning", learning)
        .withColumn("_learning", distinct)
        .withColumn("_items", items)
        .select(
            "recordId",
            "participantId",
            "sessionNumber",
            "form",
            of("easy").alias("easyItems"),
            of("hard").alias("hardItems"),
        )
    )


def phase_seconds(
    changes: DataFrame, key: str = "record_id", at: str = "at", phase: str = "phase", chunk_s: int = 86400
) -> DataFrame:
    """Total, task and break seconds per session from the times at which phases begin."""
    linked = with_previous(changes, [key], [at], time_chunk(at, chunk_s), [at, phase])

    # Whole microseconds are summed, so the result does not depend on the order of the rows.
    spent = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"_prev.{at}").cast("timestamp"))
    left = F.col(f"_prev.{phase}")

    def seconds(micros: Column) -> Column:
        return F.coalesce(F.sum(micros), F.lit(0)) / F.lit(1e6)

    return linked.groupBy(key).agg(
        seconds(spent).alias("total_seconds"),
        seconds(F.when(is_task_phase(left), spent)).alias("task_seconds"),
        seconds(F.when(left == "break", spent)).alias("break_seconds"),
    )


def recent_mean(df: DataFrame, keys: Sequence[str], idx: str, value: str, rows: int = 3, chunk_rows: int = 16384) -> DataFrame:
    """Mean of the last ``rows`` values along a 0-based index."""
    from tidemark.operators.sequence import CHUNK, with_halo

    halo = with_halo(df, idx, chunk_rows, before=rows - 1)
    order = Window.partitionBy(*keys, CHUNK).orderBy(idx).rowsBetween(-(rows - 1), 0)
    return halo.withColumn("recent_mean", F.avg(value).over(order)).where("_own").drop("_own", CHUNK)


def frame_rate(df: DataFrame, keys: Sequence[str], at: str, chunk_s: int = 86400, alpha: float = 0.1) -> DataFrame:
    """All rows with ``fps``: moving average of 1 / (time step), from 0 at a key's first time.

    A step of no length leaves the estimate as it is, so rows of one time share it: steps run over distinct times.
    """
    from tidemark.operators.sequence import CHUNK, ewma, null_safe_join, time_chunk, with_halo, with_index

    times = df.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    rows = with_halo(with_index(times, keys, [at], time_chunk(at, chunk_s), "_n"), "_n", 16384, before=1)
    order = Window.partitionBy(*keys, CHUNK).orderBy("_n")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    steps = (
        rows.withColumn("_dt", (micros - F.lag(micros).over(order)) / F.lit(1e6))
        .where(F.col("_own") & (F.col("_n") > 0))
        .withColumns({"_rate": F.lit(1.0) / F.col("_dt"), "_step": F.col("_n") - 1})
        .drop("_own", CHUNK)
    )
    rates = ewma(steps, keys, "_step", "_rate", alpha, 0.0, "fps").select(*keys, at, "fps")
    return null_safe_join(df, rates, [*keys, at], "left").withColumn("fps", F.coalesce("fps", F.lit(0.0)))
