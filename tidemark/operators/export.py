"""Relational tables from nested session and delayed-test records. Only projections and explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import join_choices

SESSION_COLUMNS = {
    "record_id": "recordId",
    "participant_id": "participantId",
    "session_number": "sessionNumber",
    "condition": "condition",
    "form": "form",
}


def _session() -> list[Column]:
    return [F.col(source).alias(name) for name, source in SESSION_COLUMNS.items()]


def _text(c: str) -> Column:
    """Optional text: empty where absent."""
    return F.coalesce(F.col(c), F.lit(""))


def session_table(sessions: DataFrame) -> DataFrame:
    applied = F.filter("interventions", lambda e: e["outcome"] == "applied")
    return sessions.select(
        *_session(),
        F.col("startedAtIso").alias("started_at"),
        _text("completedAtIso").alias("completed_at"),
        F.col("session2StartedEarlyOverride").alias("session2_early_override"),
        F.col("totalSessionSeconds").alias("total_session_seconds"),
        F.col("activeTaskSeconds").alias("active_task_seconds"),
        F.col("breakSeconds").alias("break_seconds"),
        F.coalesce(F.size(applied), F.lit(0)).alias("intervention_count"),
        F.col("delayedDueAtIso").alias("delayed_due_at"),
        F.col("pendingDelayedTest").alias("delayed_pending"),
    )


def cli_table(sessions: DataFrame) -> DataFrame:
    return sessions.select(*_session(), F.explode("cliSamples").alias("e")).select(
        *SESSION_COLUMNS,
        F.col("e.timestampMs").alias("timestamp_ms"),
        F.col("e.sessionTimeS").alias("session_time_s"),
        F.col("e.phase").alias("phase"),
        F.col("e.rawCli").alias("raw_cli"),
        F.col("e.smoothedCli").alias("smoothed_cli"),
        F.col("e.validFrameRatio").alias("valid_frame_ratio"),
        F.col("e.illuminationStd").alias("illumination_std"),
        F.col("e.qualityFlags.lowValidFrameRatio").alias("low_vfr_flag"),
        F.col("e.qualityFlags.unstableIllumination").alias("unstable_illumination_flag"),
    )


def trial_table(sessions: DataFrame) -> DataFrame:
    return sessions.select(*_session(), F.explode("trials").alias("e")).select(
        *SESSION_COLUMNS,
        F.col("e.trialId").alias("trial_id"),
        F.col("e.phase").alias("phase"),
        F.col("e.kind").alias("kind"),
        F.col("e.difficulty").alias("difficulty"),
        F.col("e.blockIndex").alias("block_index"),
        F.col("e.itemId").alias("item_id"),
        F.col("e.cue").alias("cue"),
        F.col("e.target").alias("target"),
        join_choices("e.recognitionChoices").alias("recognition_choices"),
        _text("e.selectedChoice").alias("selected_choice"),
        _text("e.responseText").alias("response_text"),
        F.col("e.correct").alias("correct"),
        F.col("e.reactionTimeMs").alias("reaction_time_ms"),
        F.col("e.timestampMs").alias("timestamp_ms"),
        F.col("e.sessionTimeS").alias("session_time_s"),
    )


def intervention_table(sessions: DataFrame) -> DataFrame:
    return sessions.select(*_session(), F.explode("interventions").alias("e")).select(
        *SESSION_COLUMNS,
        F.col("e.timestampMs").alias("timestamp_ms"),
        F.col("e.sessionTimeS").alias("session_time_s"),
        F.col("e.phase").alias("phase"),
        F.col("e.type").alias("type"),
        F.col("e.outcome").alias("outcome"),
        F.col("e.cli").alias("cli"),
        F.col("e.smoothedCli").alias("smoothed_cli"),
        F.col("e.validFrameRatio").alias("valid_frame_ratio"),
        _text("e.details").alias("details"),
    )


def tlx_table(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("nasaTlx").isNotNull()).select(
        *_session(),
        F.col("nasaTlx.mentalDemand").alias("mental_demand"),
        F.col("nasaTlx.physicalDemand").alias("physical_demand"),
        F.col("nasaTlx.temporalDemand").alias("temporal_demand"),
        F.col("nasaTlx.performance").alias("performance"),
        F.col("nasaTlx.effort").alias("effort"),
        F.col("nasaTlx.frustration").alias("frustration"),
    )


def delayed_table(delayed: DataFrame) -> DataFrame:
    return delayed.select(
        F.col("recordId").alias("delayed_record_id"),
        F.col("linkedSessionRecordId").alias("linked_session_record_id"),
        F.col("participantId").alias("participant_id"),
        F.col("sessionNumber").alias("session_number"),
        "condition",
        "form",
        F.col("dueAtIso").alias("due_at"),
        _text("completedAtIso").alias("completed_at"),
        F.explode("trials").alias("e"),
    ).select(
        "delayed_record_id",
        "linked_session_record_id",
        "participant_id",
        "session_number",
        "condition",
        "form",
        "due_at",
        "completed_at",
        F.col("e.kind").alias("kind"),
        F.col("e.difficulty").alias("difficulty"),
        F.col("e.blockIndex").alias("block_index"),
        F.col("e.itemId").alias("item_id"),
        F.col("e.cue").alias("cue"),
        F.col("e.target").alias("target"),
        F.col("e.correct").alias("correct"),
        F.col("e.reactionTimeMs").alias("reaction_time_ms"),
        _text("e.selectedChoice").alias("selected_choice"),
        _text("e.responseText").alias("response_text"),
        join_choices("e.recognitionChoices").alias("recognition_choices"),
    )


def export_tables(sessions: DataFrame, delayed: DataFrame) -> dict[str, DataFrame]:
    """The six tables of a study export."""
    return {
        "session_summary": session_table(sessions),
        "cli_windows": cli_table(sessions),
        "trials": trial_table(sessions),
        "interventions": intervention_table(sessions),
        "tlx": tlx_table(sessions),
        "delayed": delayed_table(delayed),
    }


def bundle_rows(sessions: DataFrame, delayed: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """All records of every participant as JSON rows.

    A participant's package is the set of rows with that id (written partitioned by participant), so no
    group of records is ever gathered into one value.
    """
    at = F.current_timestamp() if exported_at is None else exported_at

    def rows(df: DataFrame, kind: str, order: str) -> DataFrame:
        return df.select(
            F.col("participantId").alias("participant_id"),
            at.alias("exported_at"),
            F.lit(kind).alias("kind"),
            F.col(order).cast("string").alias("sort_key"),
            F.col("recordId").cast("string").alias("record_id"),
            F.to_json(F.struct("*")).alias("record"),
        )

    return rows(sessions, "session", "startedAtIso").unionByName(rows(delayed, "delayed_test", "dueAtIso"))
