"""Live scoring in one streaming query: frames in, smoothed load and controller actions out.

Three stateful operators are chained: frames to windows in order of arrival, windows to calibrated features, scores to smoothed
scores and actions. What lies between is stateless: the features are expressions over a window's arrays, the saved pipeline is
applied to the stream as to a table. All operators key by the same buckets of sessions, so the rows of a session stay in one
partition of state. The end of a session travels through the chain as a row of its own and clears the state of each operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from tidemark.config import EngineeredFeatures, FeatureConfig, StudyPlan, StudyQuality
from tidemark.operators.learning import Artifacts, score_windows
from tidemark.schemas import require_columns
from tidemark.streaming.arrival import BUCKET, BUCKETS, Rows, Sessions, by_session, dealt, gathered, in_order
from tidemark.streaming.controller import SAMPLE_COLUMNS, SCORE_SCHEMA, ScoreProcessor
from tidemark.streaming.frames import FRAME_VALUES, WINDOW_ROWS, CalibrationProcessor, WindowRowProcessor, window_row_features

ENDED = "ended"


class UntilEnded(StatefulProcessor):
    """Runs ``behind`` on the rows of each session of a bucket, up to a row of kind ``ended``, which clears the session's state.

    ``behind`` is a processor with value states and ``flush``, which gets ``Rows``. An operator of the chain gets all rows of a
    stretch of time in one micro-batch and later times in later ones, so the rows of a micro-batch only have to be sorted. With
    ``passes_on`` the ended row goes to the next operator. Every output column is present.
    """

    def __init__(self, behind: StatefulProcessor, at: str, passes_on: bool, columns: Sequence[str], key: str = "session_id") -> None:
        self.behind, self.at, self.passes_on, self.columns, self.key = behind, at, passes_on, list(columns), key
        behind.flushes = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = Sessions(handle)
        self.behind.init(self.sessions)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        _, sessions = self.sessions.bucket()
        found: dict[Any, list[tuple]] = {}
        for batch in rows:
            names = list(batch.columns)
            for session, new in by_session(batch, self.key, names, {}).items():
                found.setdefault(session, []).extend(new)
        for out in gathered(self._worked(found, names, sessions, timerValues)):
            yield out if list(out.columns) == self.columns else out.reindex(columns=self.columns)
        self.sessions.flush(None, sessions)

    def _worked(
        self, found: dict[Any, list[tuple]], names: list[str], sessions: dict[Any, tuple[int | None, bytes]], timerValues: TimerValues
    ) -> Iterator[list[dict]]:
        at, kind = names.index(self.at), names.index("kind")
        for session, rows in found.items():
            rows.sort(key=lambda row: (row[at], row[kind] == ENDED))
            self.sessions.open(sessions.get(session, (None, None))[1])
            lo = 0
            for hi in [i for i, row in enumerate(rows) if row[kind] == ENDED] + [len(rows)]:
                if lo < hi:
                    yield from self.behind.handleInputRows((session,), iter([Rows(rows[lo:hi], names)]), timerValues)
                if hi < len(rows):
                    yield from self.behind.ended((session,), None, 0)
                    if self.passes_on:
                        yield [dict.fromkeys(self.columns) | {self.key: session, self.at: rows[hi][at], "kind": ENDED}]
                lo = hi + 1
            self.behind.flush()
            packed = self.sessions.packed()
            if packed is not None:
                sessions[session] = (None, packed)
            else:
                sessions.pop(session, None)

    def close(self) -> None:
        self.behind.close()


def _keyed(stream: DataFrame, processor: StatefulProcessor, output: StructType | str, buckets: int) -> DataFrame:
    return stream.withColumn(BUCKET, dealt("session_id", buckets)).groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="None"
    )


def live_windows(
    frames: DataFrame, config: FeatureConfig = FeatureConfig(), lateness_s: float = 10.0, gap_s: float | None = 60.0, received: str = "received", **options
) -> DataFrame:
    """Window features of a stream of frames in any order, and a row of kind ``ended`` for each session that is over."""
    columns = ["session_id", "at", received, *FRAME_VALUES, "valid"]
    stream = require_columns(frames, columns, "frames").select(*columns)
    keys = ["session_id", "kind", "emitted_at", "t_start_s", "t_end_s"]
    cut = in_order(stream, WindowRowProcessor(config), WINDOW_ROWS, "at", received, lateness_s, gap_s, **options)
    out = window_row_features(cut, config, keys)
    return out.where((F.col("kind") == ENDED) | (F.col("bad_ratio") <= config.max_bad_ratio))


def live_scores(
    frames: DataFrame,
    artifacts: Artifacts,
    condition: Column,
    config: FeatureConfig = FeatureConfig(),
    n_windows: int = 4,
    phase: str = "learning_easy",
    plan: StudyPlan = StudyPlan(),
    quality: StudyQuality = StudyQuality(),
    buckets: int = BUCKETS,
    **arrival,
) -> DataFrame:
    """Smoothed scores and controller actions of a stream of frames (session_id, at, received and the frame's values).

    ``artifacts`` is a model as it was saved; the first ``n_windows`` windows of a session calibrate and give no score.
    ``condition`` is an expression of session_id. NULL features count as 0, as in batch scoring.
    """
    base = artifacts.spec["base_features"]
    spec = EngineeredFeatures(list(base))
    windows = live_windows(frames, config, buckets=buckets, **arrival)
    carried = ["kind", "valid_frame_ratio", "std_brightness"]
    schema = "session_id string, emitted_at double, kind string, valid_frame_ratio double, std_brightness double"
    schema += "".join(f", {f} double" for f in spec.all)
    names = ["session_id", "emitted_at", *carried, *spec.all]
    source = windows.select("session_id", "emitted_at", *dict.fromkeys([*carried, *base]))
    calibrated = _keyed(source, UntilEnded(CalibrationProcessor(base, carried, n_windows), "emitted_at", True, names), schema, buckets)
    scored = score_windows(calibrated, artifacts)
    samples = scored.select(
        "session_id",
        condition.alias("condition"),
        F.round(F.col("emitted_at") * 1000).cast("bigint").alias("timestamp_ms"),
        "cli",
        "valid_frame_ratio",
        F.col("std_brightness").alias("illumination_std"),
        F.col("emitted_at").alias("session_time_s"),
        F.lit(phase).alias("phase"),
        "kind",
    )
    columns = [f.split()[0] for f in SCORE_SCHEMA.split(",")]
    behind = UntilEnded(ScoreProcessor(plan=plan, quality=quality), "timestamp_ms", False, columns)
    return _keyed(samples.select(*SAMPLE_COLUMNS, "kind"), behind, SCORE_SCHEMA, buckets)
