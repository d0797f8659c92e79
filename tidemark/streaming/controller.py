"""The adaptive controller: decision buckets, signal quality, overload and the ladder of actions.

A controller is sequential per session. In batch, sessions are spread by key and each task folds its
sorted rows one Arrow batch at a time, so a session of any length needs constant memory. On a stream
the same controller lives in keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from tidemark.config import StudyPlan, StudyQuality
from tidemark.schemas import require_columns
from tidemark.streaming.arrival import Kept, Rows, gathered, tuples

# Action names and their explanations.
PAUSE = ("low_confidence_pause", "paused", "Adaptation paused due to low signal quality.")
SUPPRESSED = (
    "suppressed_trigger",
    "suppressed",
    "Overload trigger detected but suppressed in baseline condition.",
)
MICRO_BREAK = ("micro_break_60s", "applied", "Prompting a 60 second micro-break due to sustained overload.")
PACING = ("pacing_change", "applied", "Increased item exposure by +{n}s cumulative.")
STEP_DOWN = (
    "difficulty_step_down",
    "applied",
    "Stepped down hard-block interference profile for remaining items.",
)

SAMPLE_COLUMNS = [
    "session_id",
    "condition",
    "timestamp_ms",
    "cli",
    "valid_frame_ratio",
    "illumination_std",
    "session_time_s",
    "phase",
]

AT_MS = SAMPLE_COLUMNS.index("timestamp_ms")

EVENT_SCHEMA = """
    session_id string, timestamp_ms bigint, session_time_s double, phase string, type string,
    outcome string, cli double, smoothed_cli double, valid_frame_ratio double, details string
"""

SCORE_SCHEMA = """
    session_id string, timestamp_ms bigint, session_time_s double, phase string, raw_cli double,
    smoothed_cli double, valid_frame_ratio double, illumination_std double, low_vfr_flag boolean,
    unstable_illumination_flag boolean, event_type string, event_outcome string, event_smoothed_cli double,
    low_confidence boolean, pacing_offset_s int, stepped_down boolean
"""


@dataclass
class Controller:
    """State of one session. ``step`` takes one sample and returns an action or None."""

    opened_ms: int | None = None
    count: int = 0
    sums: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    recent: list[float] = field(default_factory=list)
    overloaded: int = 0
    poor: int = 0
    breaks: int = 0
    pacing: int = 0
    stepped_down: bool = False
    acted_ms: int | None = None

    @property
    def low_confidence(self) -> bool:
        return self.poor >= 2

    def step(
        self,
        at_ms: int,
        cli: float,
        ratio: float,
        light: float,
        condition: str,
        plan: StudyPlan = StudyPlan(),
        quality: StudyQuality = StudyQuality(),
    ) -> dict | None:
        bucket = self._collect(at_ms, (cli, ratio, light), plan)
        if bucket is None:
            return None
        load, good_share, light_spread = bucket
        self.recent = [*self.recent, load][-plan.smoothing_windows :]
        smoothed = sum(self.recent) / len(self.recent)

        was_paused = self.low_confidence
        bad = good_share < quality.min_valid_ratio or light_spread > quality.max_illumination_std
        self.poor = self.poor + 1 if bad else 0
        action = None
        if self.low_confidence:
            action = None if was_paused else PAUSE
        else:
            self.overloaded = self.overloaded + 1 if smoothed > plan.overload_threshold else 0
            resting = self.acted_ms is not None and at_ms - self.acted_ms < plan.cooldown_seconds * 1000
            if self.overloaded >= 2 and not resting:
                action = SUPPRESSED if condition == "baseline" else self._next_action(plan)
                self.acted_ms = at_ms
        if action is None:
            return None
        kind, outcome, details = action
        return {
            "type": kind,
            "outcome": outcome,
            "details": details.format(n=self.pacing),
            "cli": load,
            "smoothed_cli": smoothed,
            "valid_frame_ratio": good_share,
        }

    def _collect(self, at_ms: int, values: tuple[float, float, float], plan: StudyPlan):
        """Means of the bucket that this sample closes, if it does. An open bucket starts at its first sample."""
        if self.opened_ms is None:
            self.opened_ms, self.count, self.sums = at_ms, 0, [0.0, 0.0, 0.0]
        self.count += 1
        self.sums = [a + b for a, b in zip(self.sums, values)]
        if at_ms - self.opened_ms < plan.decision_window_seconds * 1000:
            return None
        self.opened_ms = None
        return tuple(s / self.count for s in self.sums)

    def _next_action(self, plan: StudyPlan) -> tuple[str, str, str]:
        if self.breaks < plan.max_micro_breaks:
            self.breaks += 1
            return MICRO_BREAK
        if self.pacing < plan.max_pacing_seconds:
            self.pacing += 1
            return PACING
        self.stepped_down = True
        return STEP_DOWN


def controller_events(samples: DataFrame, plan: StudyPlan = StudyPlan(), quality: StudyQuality = StudyQuality()) -> DataFrame:
    """Actions of the controller for all sessions of a table of learning-phase samples."""
    require_columns(samples, SAMPLE_COLUMNS, "controller samples")
    ordered = (
        samples.select(*SAMPLE_COLUMNS)
        .repartition("session_id")
        .sortWithinPartitions("session_id", "timestamp_ms")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Controller()
        for batch in batches:
            found = []
            for s in batch.itertuples(index=False):
                if s.session_id != current:
                    current, state = s.session_id, Controller()
                event = state.step(
                    int(s.timestamp_ms), s.cli, s.valid_frame_ratio, s.illumination_std, s.condition, plan, quality
                )
                if event is not None:
                    found.append(
                        {
                            "session_id": current,
                            "timestamp_ms": int(s.timestamp_ms),
                            "session_time_s": s.session_time_s,
                            "phase": s.phase,
                            **event,
                        }
                    )
            if found:
                yield pd.DataFrame(found)

    return ordered.mapInPandas(fold, EVENT_SCHEMA)


class ScoreProcessor(StatefulProcessor):
    """Smooths raw scores of a session and feeds the controller, in keyed state.

    Every input row gives one output row: the smoothed sample with its quality flags and, where the
    controller acted, the action. Only learning-phase samples reach the controller.
    """

    def __init__(
        self,
        alpha: float = 0.4,
        start: float = 0.5,
        plan: StudyPlan = StudyPlan(),
        quality: StudyQuality = StudyQuality(),
    ):
        self.alpha, self.start, self.plan, self.quality = alpha, start, plan, quality

    flushes = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = Kept(handle, "session")

    def handleInputRows(self, key, rows: Iterator[Rows | pd.DataFrame], timerValues: TimerValues) -> Iterator[list[dict] | pd.DataFrame]:
        samples = [s for part in rows for s in tuples(part, SAMPLE_COLUMNS)]
        samples.sort(key=lambda s: s[AT_MS])
        out = self._scored(key[0], samples)
        return gathered(iter([out])) if self.flushes else iter([out])

    def _scored(self, session: str, samples: list[tuple]) -> list[dict]:
        smoothed, stored = self.state.get() or (self.start, {})
        controller, out = Controller(**stored), []
        for _, condition, at_ms, cli, ratio, light, time_s, phase in samples:
            smoothed = self.alpha * cli + (1.0 - self.alpha) * smoothed
            event = None
            if str(phase).startswith("learning"):
                event = controller.step(int(at_ms), cli, ratio, light, condition, self.plan, self.quality)
            event = event or {}
            out.append(
                {
                    "session_id": session,
                    "timestamp_ms": int(at_ms),
                    "session_time_s": time_s,
                    "phase": phase,
                    "raw_cli": cli,
                    "smoothed_cli": smoothed,
                    "valid_frame_ratio": ratio,
                    "illumination_std": light,
                    "low_vfr_flag": ratio < self.quality.min_valid_ratio,
                    "unstable_illumination_flag": light > self.quality.max_illumination_std,
                    "event_type": event.get("type"),
                    "event_outcome": event.get("outcome"),
                    "event_smoothed_cli": event.get("smoothed_cli"),
                    "low_confidence": controller.low_confidence,
                    "pacing_offset_s": controller.pacing,
                    "stepped_down": controller.stepped_down,
                }
            )
        self.state.set((smoothed, vars(controller)))
        if self.flushes:
            self.flush()
        return out

    def ended(self, key, at: float | None, late: int) -> Iterator[pd.DataFrame]:
        self.state.set(None)
        if self.flushes:
            self.flush()
        return iter(())

    def flush(self) -> None:
        self.state.flush()

    def close(self) -> None:
        pass


def smoothed_scores(scores: DataFrame, processor: ScoreProcessor | None = None) -> DataFrame:
    """Smoothed samples and controller actions of a stream of raw scores."""
    return (
        require_columns(scores, SAMPLE_COLUMNS, "scores")
        .select(*SAMPLE_COLUMNS)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=processor or ScoreProcessor(),
            outputStructType=SCORE_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )
