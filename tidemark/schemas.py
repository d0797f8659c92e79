"""Explicit table schemas and the checks made at the edges of the library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

FRAMES = """
    user_id string, task string, frame_idx bigint, timestamp_s double,
    ear_left double, ear_right double, ear_mean double, brightness double, quality double,
    eye_center_x double, eye_center_y double, mouth_mar double,
    roll double, pitch double, yaw double, valid boolean
"""

POINTS = "array<struct<x:double,y:double,z:double>>"

LANDMARKS = f"""
    user_id string, task string, frame_idx bigint, detected boolean,
    quality double, brightness double, points {POINTS}
"""

MANIFEST = "video_file string, label string, role string, user_id string, task string, notes string"
MANIFEST_REQUIRED = ["video_file", "label", "role", "user_id"]

PHYSIO_SAMPLES = (
    "user_id string, task string, sample_idx bigint, ECG double, EDA double, RR double"
)
PHYSIO_SIGNALS = ["ECG", "EDA", "RR"]

COLLECTED_SAMPLES = """
    participant_id string, session_notes string,
    samples array<struct<timestamp:bigint, window_index:int, label:string, difficulty:string,
        task_type:string, features:map<string,double>, valid_frame_ratio:double>>
"""

TRIAL = """struct<
    trialId:string, timestampMs:bigint, sessionTimeS:double, phase:string, kind:string,
    difficulty:string, blockIndex:int, itemId:string, cue:string, target:string,
    recognitionChoices:array<string>, selectedChoice:string, responseText:string,
    correct:boolean, reactionTimeMs:double, condition:string, form:string>"""

CLI_SAMPLE = """struct<
    timestampMs:bigint, sessionTimeS:double, phase:string, rawCli:double, smoothedCli:double,
    validFrameRatio:double, illuminationStd:double,
    qualityFlags:struct<lowValidFrameRatio:boolean, unstableIllumination:boolean>>"""

INTERVENTION = """struct<
    timestampMs:bigint, sessionTimeS:double, phase:string, type:string, outcome:string,
    cli:double, smoothedCli:double, validFrameRatio:double, details:string>"""

BLOCK_SUMMARY = """struct<
    blockIndex:int, difficulty:string, learningItemCount:int, recognitionAccuracy:double,
    recognitionMeanRtMs:double, cuedRecallAccuracy:double, cuedRecallMeanRtMs:double,
    effectiveExposureSeconds:double, adaptationApplied:boolean>"""

TLX = """struct<
    mentalDemand:double, physicalDemand:double, temporalDemand:double,
    performance:double, effort:double, frustration:double>"""

SESSIONS = f"""
    recordVersion int, recordId string, participantId string, sessionNumber int,
    startedAtIso string, completedAtIso string, session2StartedEarlyOverride boolean,
    condition string, form string,
    totalSessionSeconds double, activeTaskSeconds double, breakSeconds double,
    cliSamples array<{CLI_SAMPLE}>, interventions array<{INTERVENTION}>, trials array<{TRIAL}>,
    blockSummaries array<{BLOCK_SUMMARY}>, nasaTlx {TLX},
    pendingDelayedTest boolean, delayedDueAtIso string
"""

DELAYED_TESTS = f"""
    recordVersion int, recordId string, linkedSessionRecordId string, participantId string,
    sessionNumber int, condition string, form string, dueAtIso string, completedAtIso string,
    trials array<{TRIAL}>, recognitionAccuracy double, recognitionMeanRtMs double,
    cuedRecallAccuracy double, cuedRecallMeanRtMs double
"""

CONTROLLER_SAMPLES = """
    session_id string, condition string, timestamp_ms bigint, cli double,
    valid_frame_ratio double, illumination_std double, session_time_s double, phase string
"""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise when a required column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing required columns: {missing}")
    return df
