"""Live frames: throttling, the ring buffer with its cadences, calibration and live features."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from tidemark.config import BASE_FEATURES, EngineeredFeatures, FeatureConfig
from tidemark.functions.numeric import finite
from tidemark.operators.features import features_of_cut_windows, finished_features
from tidemark.operators.windows import quality_gate
from tidemark.schemas import require_columns
from tidemark.streaming.arrival import CLOCK, Kept, Rows, clock, gathered, tuples

FRAME_VALUES = [
    "ear_mean",
    "brightness",
    "quality",
    "eye_center_x",
    "eye_center_y",
    "mouth_mar",
    "roll",
    "pitch",
    "yaw",
]
FRAME_FIELDS = "at double, " + ", ".join(f"{c} double" for c in FRAME_VALUES) + ", valid boolean"
CUT_SCHEMA = f"session_id string, kind string, emitted_at double, t_start_s double, t_end_s double, place bigint, {FRAME_FIELDS}"
CUT_COLUMNS = [f.split()[0] for f in CUT_SCHEMA.split(", ")]


class WindowBufferProcessor(StatefulProcessor):
    """Keeps the last frames of a session and emits them when a window or a preview is due.

    A window is attempted when the buffer is full and a step has passed since the last attempt; the
    attempt counts whether or not the window later passes the quality gate. Time is event time. Emitted
    frames carry the window they belong to, so the features are computed by the batch operators.
    """

    def __init__(self, config: FeatureConfig = FeatureConfig(), preview_s: float | None = None):
        self.config, self.preview_s = config, preview_s

    flushes = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = Kept(handle, "buffer")

    def handleInputRows(self, key, rows: Iterator[Rows | pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return gathered(self._cuts(key[0], [f for part in rows for f in tuples(part, ["at", *FRAME_VALUES, "valid"])]))

    def _cuts(self, session: str, new: list[tuple]) -> Iterator[list[dict]]:
        size = self.config.length
        new.sort(key=lambda f: math.inf if f[0] is None or f[0] != f[0] else f[0])
        seen, attempted, previewed, held = self.state.get() or (0, None, None, ())
        buffer = deque(held, maxlen=size)
        for frame in new:
            buffer.append(tuple(None if v is None or v != v else v for v in frame))
            seen += 1
            now = frame[0]
            if self.preview_s is not None and (previewed is None or now - previewed >= self.preview_s):
                previewed = now
                yield self._cut(session, "preview", now, seen, buffer)
            if len(buffer) == size and (attempted is None or now - attempted >= self.config.step_s):
                attempted = now
                yield self._cut(session, "window", now, seen, buffer)
        self.state.set((seen, attempted, previewed, list(buffer)))
        if self.flushes:
            self.flush()

    def _cut(self, session: str, kind: str, now: float, seen: int, buffer: deque) -> list[dict]:
        end = seen / self.config.fps
        head = (session, kind, now, max(0.0, end - self.config.length_s), end)
        return [dict(zip(CUT_COLUMNS, (*head, place, *frame[:-1], bool(frame[-1])))) for place, frame in enumerate(buffer)]

    def ended(self, key, at: float | None, late: int) -> Iterator[list[dict]]:
        self.state.set(None)
        if self.flushes:
            self.flush()
        return iter(())

    def flush(self) -> None:
        self.state.flush()

    def close(self) -> None:
        pass


WINDOW_ROWS = "session_id string, kind string, emitted_at double, t_start_s double, t_end_s double, "
WINDOW_ROWS += ", ".join(f"{c} array<double>" for c in FRAME_VALUES) + ", valid array<boolean>"


class WindowRowProcessor(WindowBufferProcessor):
    """The same windows as one row each, the frames' values as arrays in the order of time.

    The end of a session gives a row of kind ``ended`` without frames, for the operators behind to clear their state.
    """

    def handleInputRows(self, key, rows: Iterator[Rows | pd.DataFrame], timerValues: TimerValues) -> Iterator[list[dict] | pd.DataFrame]:
        cuts = self._cuts(key[0], [f for part in rows for f in tuples(part, ["at", *FRAME_VALUES, "valid"])])
        return gathered(cuts) if self.flushes else cuts

    def _cut(self, session: str, kind: str, now: float, seen: int, buffer: deque) -> list[dict]:
        end = seen / self.config.fps
        row = {"session_id": session, "kind": kind, "emitted_at": now, "t_start_s": max(0.0, end - self.config.length_s), "t_end_s": end}
        return [row | dict(zip(FRAME_VALUES + ["valid"], map(list, list(zip(*buffer))[1:])))]

    def ended(self, key, at: float | None, late: int) -> Iterator[list[dict]]:
        super().ended(key, at, late)
        if at is not None:
            names = [f.split()[0] for f in WINDOW_ROWS.split(", ")]
            yield [{**dict.fromkeys(names), "session_id": key[0], "kind": "ended", "emitted_at": at}]


def _moments(values: Column) -> Column:
    """Number, mean and sum of squared deviations of an array's values, NULLs left out."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), zero, add)


def _blink_runs(good: Column, config: FeatureConfig) -> Column:
    """Runs of closed eyes that end among the valid frames, and their frames together."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("rank"), F.lit(False).alias("closed"), F.lit(0).cast("bigint").alias("since"),
        F.lit(0).cast("bigint").alias("runs"), F.lit(0).cast("bigint").alias("frames"),
    )

    def step(s: Column, f: Column) -> Column:
        closed, rank = finite(f["ear_mean"]) < config.ear_threshold, s["rank"] + 1
        run = rank - s["since"]
        kept = F.coalesce(~closed & s["closed"] & run.between(config.min_blink_frames, config.max_blink_frames), F.lit(False))
        return F.struct(
            rank.alias("rank"),
            F.coalesce(closed, s["closed"]).alias("closed"),
            F.when(closed & ~s["closed"], rank).otherwise(s["since"]).alias("since"),
            F.when(kept, s["runs"] + 1).otherwise(s["runs"]).alias("runs"),
            F.when(kept, s["frames"] + run).otherwise(s["frames"]).alias("frames"),
        )

    return F.aggregate(good, zero, step)


def window_row_features(windows: DataFrame, config: FeatureConfig, keys: Sequence[str]) -> DataFrame:
    """Features of windows that are one row each, by expressions over their arrays: no shuffle, on tables and streams."""

    def is_valid(f: Column) -> Column:
        return F.coalesce(f["valid"], F.lit(False))

    def of(value) -> Column:
        return _moments(F.transform("_good", value))

    def field(name: str) -> Callable[[Column], Column]:
        return lambda f: finite(f[name])

    def move(a: Column, b: Column) -> Column:
        way = F.sqrt(F.pow(b["eye_center_x"] - a["eye_center_x"], 2) + F.pow(b["eye_center_y"] - a["eye_center_y"], 2))
        return F.when(is_valid(a) & is_valid(b), finite(way * F.lit(config.fps)))

    def mean(name: str) -> Column:
        return F.when(F.col(f"{name}.n") > 0, F.col(f"{name}.mean"))

    def spread(name: str) -> Column:
        return F.when(F.col(f"{name}.n") > 0, F.sqrt(F.col(f"{name}.m2") / F.col(f"{name}.n")))

    rows = windows.withColumn("_frames", F.arrays_zip(*FRAME_VALUES, "valid")).withColumn("_good", F.filter("_frames", is_valid))
    last = F.greatest(F.size("_frames") - 1, F.lit(0))
    rows = rows.select(
        *keys,
        F.size("_frames").alias("_n"),
        F.size("_good").alias("_valid"),
        _blink_runs(F.col("_good"), config).alias("_blinks"),
        F.size(F.filter("_good", lambda f: F.coalesce(finite(f["ear_mean"]) < config.ear_threshold, F.lit(False)))).alias("_closed_frames"),
        of(lambda f: F.when(finite(f["ear_mean"]) > 0, f["ear_mean"])).alias("_ear"),
        of(lambda f: f["brightness"]).alias("_brightness"),
        of(lambda f: f["quality"]).alias("_quality"),
        of(field("mouth_mar")).alias("_mouth"),
        *[of(field(c)).alias(f"_{c}") for c in ("roll", "pitch", "yaw")],
        _moments(F.zip_with(F.slice("_frames", F.lit(1), last), F.slice("_frames", F.lit(2), last), move)).alias("_motion"),
    )
    none = F.lit(None).cast("bigint")
    rows = rows.withColumns(
        {
            "_runs": F.col("_blinks.runs"), "_run_frames": F.col("_blinks.frames"), "_cut_end": none, "_first_closed": none,
            "ear_std": spread("_ear"), "mean_brightness": mean("_brightness"), "std_brightness": spread("_brightness"),
            "mean_quality": mean("_quality"), "mouth_open_mean": mean("_mouth"), "mouth_open_std": spread("_mouth"),
            **{f"{c}_std": spread(f"_{c}") for c in ("roll", "pitch", "yaw")},
            "motion_mean": mean("_motion"), "motion_std": spread("_motion"),
        }
    )
    _, bad = quality_gate(F.col("_valid"), F.col("_n"), config.max_bad_ratio)
    values = finished_features(config)
    ordered = [*config.model_features, *config.monitoring_features]
    return rows.select(*keys, bad.alias("bad_ratio"), *[values[n].alias(n) for n in ordered])


def cut_windows(frames: DataFrame, config: FeatureConfig = FeatureConfig(), preview_s: float | None = None) -> DataFrame:
    """Frames of every due window (and preview) of a stream of frames keyed by ``session_id``."""
    columns = ["session_id", "at", *FRAME_VALUES, "valid"]
    return (
        require_columns(frames, columns, "frames")
        .select(*columns)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=WindowBufferProcessor(config, preview_s),
            outputStructType=CUT_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )


def live_features(cut: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Features of emitted windows (one batch of ``cut_windows``); windows failing the gate are left out."""
    keys = ["session_id", "kind", "emitted_at", "t_start_s", "t_end_s"]
    out = features_of_cut_windows(cut, config, keys, "place")
    return out.where((F.col("kind") == "preview") | (F.col("bad_ratio") <= config.max_bad_ratio))


class CalibrationProcessor(StatefulProcessor):
    """Calibrates a session on its first windows, then emits centred and delta features.

    The calibrating windows give no output. Missing values count as 0, as in live scoring.
    """

    def __init__(
        self,
        features: Sequence[str] = tuple(BASE_FEATURES),
        carried: Sequence[str] = (),
        n_windows: int = 4,
    ):
        self.features, self.carried = list(features), list(carried)
        self.n_windows = n_windows

    flushes = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = Kept(handle, "calibration")

    def handleInputRows(self, key, rows: Iterator[Rows | pd.DataFrame], timerValues: TimerValues) -> Iterator[list[dict] | pd.DataFrame]:
        columns = ["emitted_at", *self.carried, *self.features]
        windows = sorted((w for part in rows for w in tuples(part, columns)), key=lambda w: (w[0] is None or w[0] != w[0], w[0]))
        out = self._calibrated(key[0], windows)
        return gathered(iter([out])) if self.flushes else iter([out])

    def _calibrated(self, session: str, windows: list[tuple]) -> list[dict]:
        names = EngineeredFeatures(self.features).all
        # The windows of the calibration while it lasts, then the baseline and the last centred values.
        held, baseline, previous = self.state.get() or ([], None, None)
        first, out = 1 + len(self.carried), []
        for window in windows:
            values = [None if v is None or not math.isfinite(v) else float(v) for v in window[first:]]
            if baseline is None and len(held) < self.n_windows:
                held = [*held, values]
                if len(held) == self.n_windows:
                    held, baseline = [], [median([v for v in known if v is not None] or [0.0]) for known in zip(*held)]
                continue
            safe = [0.0 if v is None else v for v in values]
            centered = [v - b for v, b in zip(safe, baseline)]
            delta = [c - p for c, p in zip(centered, previous or centered)]
            previous = centered
            carried = zip(["session_id", "emitted_at", *self.carried], [session, *window[:first]])
            out.append(dict(carried) | dict(zip(names, [*safe, *centered, *delta])))
        self.state.set((held, baseline, previous))
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


def calibrated_features(
    windows: DataFrame, features: Sequence[str] = tuple(BASE_FEATURES), carried: Sequence[str] = (), n_windows: int = 4
) -> DataFrame:
    """Engineered features of a stream of window rows keyed by ``session_id``."""
    spec = EngineeredFeatures(list(features))
    types = dict(windows.dtypes)
    schema = "session_id string, emitted_at double"
    schema += "".join(f", {c} {types[c]}" for c in carried) + "".join(f", {f} double" for f in spec.all)
    return (
        windows.select("session_id", "emitted_at", *carried, *features)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=CalibrationProcessor(features, carried, n_windows),
            outputStructType=StructType.fromDDL(schema),
            outputMode="Append",
            timeMode="None",
        )
    )


class ThrottleProcessor(StatefulProcessor):
    """Passes a frame only if it is far enough from the last passed one and shows another picture."""

    def __init__(self, fps: float, fields: Sequence[str]):
        self.fps, self.fields = fps, list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_ms double, video_time double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(rows, ignore_index=True).sort_values("at_ms", kind="stable", ignore_index=True)
        last = self.last.get() if self.last.exists() else (None, None)
        keep, last = passed_frames(frames["at_ms"].to_numpy(), frames["video_time"].to_numpy(), self.fps, last)
        if last[0] is not None:
            self.last.update(last)
        if keep:
            yield frames.loc[keep, self.fields]

    def ended(self, key, at: float | None, late: int) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def passed_frames(at_ms, video_time, fps: float, last: tuple):
    """Positions that pass, and the last passed (time, picture time)."""
    keep, gap = [], 1000.0 / fps
    for i, (now, shown) in enumerate(zip(at_ms, video_time)):
        if last[0] is not None and (now - last[0] < gap or shown == last[1]):
            continue
        keep.append(i)
        last = (float(now), float(shown))
    return keep, last


def without_repeats(frames: DataFrame, keys: Sequence[str] = ("session_id", "at"), received: str = "received", within: str = "30 seconds") -> DataFrame:
    """A stream of frames without repeats of a key; the one that arrives first stays.

    A key is remembered until the time of receipt has moved on by ``within``, so the state holds the keys of that time only.
    A repeat that comes later passes.
    """
    clocked = frames.withColumn(CLOCK, clock(received)).withWatermark(CLOCK, within)
    return clocked.dropDuplicatesWithinWatermark(list(keys)).drop(CLOCK)


def throttled_stream(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Throttled frames of a stream with ``session_id``, ``at_ms`` and ``video_time``."""
    return frames.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=ThrottleProcessor(fps, frames.columns),
        outputStructType=frames.schema,
        outputMode="Append",
        timeMode="None",
    )


def throttled(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """The same rule for a table: sorted per session, folded one Arrow batch at a time."""
    ordered = frames.repartition("session_id").sortWithinPartitions("session_id", "at_ms")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, (None, None)
        for batch in batches:
            kept = []
            for session, part in batch.groupby("session_id", sort=False):
                if session != current:
                    current, last = session, (None, None)
                keep, last = passed_frames(part["at_ms"].to_numpy(), part["video_time"].to_numpy(), fps, last)
                kept.append(part.iloc[keep])
            yield pd.concat(kept)

    return ordered.mapInPandas(fold, frames.schema)
