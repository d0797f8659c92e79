"""Rows of live sessions that arrive in any order: put in order, the late ones counted, ended sessions closed.

A row has its own time and the time of its receipt (a message's broker time, a file's time), both in seconds. The watermark
follows the times of receipt, so the engine drops no row for the age of its own time. A row that is received more than
``lateness_s`` after its own time is late: it is counted for its session and kept out. All others wait in keyed state, in
slots of their own time, until the watermark has passed the slot's end by ``lateness_s``; then no row of the slot can still
come, an event-time timer hands the slot in order to the processor behind, and the slot leaves the state. A handler thus holds
one Arrow batch or one slot beside the packed state of a bucket of sessions, never a session's rows or a whole micro-batch, and
the state of a session is what it received within the lateness bound. The result does not depend on how rows are dealt to
files and micro-batches.

A session ends where its next row in order is more than ``gap_s`` later, or when nothing has been received for as long as
that takes to be certain. The processor behind then emits its last rows and clears its state.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

CLOCK = "_clock"
#: Seconds between the clock and times of receipt. A watermark starts at the epoch and drops what lies before, and times may be
#: counted from the start of a recording.
SHIFT_S = 1_000_000_000


def clock(received: str) -> Column:
    """The time of receipt as a timestamp for the watermark."""
    return F.timestamp_micros(((F.col(received) + SHIFT_S) * 1_000_000).cast("bigint"))


#: Waiting rows of a session that stand beside its place; of more rows every slot has an entry of its own.
INLINE = 256
#: Entries of state that the sessions of a stream are dealt to.
BUCKET, BUCKETS = "_bucket", 1024
#: Rows of a data frame that is handed to the engine.
OUT = 1024


class Kept:
    """A value state, read once and written once in a call of a handler; its content is one packed value."""

    SCHEMA = "data binary"

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getValueState(name, self.SCHEMA)
        self.read = self.changed = False

    def get(self) -> Any:
        if not self.read:
            found = self.state.get()
            self.stored = found is not None
            self.value = pickle.loads(found[0]) if self.stored else None
            self.read = True
        return self.value

    def set(self, value: Any) -> None:
        """A value, or None for no state."""
        self.get()
        self.value, self.changed = value, True

    def flush(self) -> None:
        if self.changed and self.value is not None:
            self.state.update((pickle.dumps(self.value, pickle.HIGHEST_PROTOCOL),))
        elif self.changed and self.stored:
            self.state.clear()
        self.read = self.changed = False


class Rows(list):
    """Rows as tuples with the names of their columns: what a processor gets instead of a small data frame."""

    def __init__(self, rows: Sequence[tuple], columns: Sequence[str]) -> None:
        super().__init__(rows)
        self.columns = columns

    def tuples(self, columns: Sequence[str]) -> Iterator[tuple]:
        places = [self.columns.index(c) for c in columns]
        return (tuple(row[i] for i in places) for row in self)


def tuples(rows: Rows | pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple]:
    return rows.tuples(columns) if isinstance(rows, Rows) else zip(*(rows[c].tolist() for c in columns))


def gathered(parts: Iterator[list[dict] | pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come in lists, as data frames of about ``OUT`` rows; data frames as they are."""
    waiting: list[dict] = []
    for part in parts:
        if isinstance(part, pd.DataFrame):
            yield part
            continue
        waiting += part
        if len(waiting) >= OUT:
            yield pd.DataFrame(waiting)
            waiting = []
    if waiting:
        yield pd.DataFrame(waiting)


class Sessions:
    """The states of a bucket of sessions, packed one by one, in one value state of the engine.

    A call to the state costs more than the work on a session, so sessions are dealt to buckets, and a bucket is read once and
    written once in a call of a handler. Only sessions that have rows or are due are unpacked. To a processor behind it is the
    handle: its value states are those of the session that is open.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Kept(handle, "sessions")
        self.values: dict[str, Any] = {}

    def bucket(self) -> tuple[int | None, dict[Any, tuple[int | None, bytes]]]:
        """The timer of the bucket, and of each session what is due next (milliseconds) and its packed values."""
        return self.kept.get() or (None, {})

    def open(self, packed: bytes | None) -> None:
        self.values = pickle.loads(packed) if packed else {}

    def packed(self) -> bytes | None:
        """The values of the open session, None without any."""
        return pickle.dumps(self.values, pickle.HIGHEST_PROTOCOL) if self.values else None

    def flush(self, timer: int | None, sessions: dict[Any, tuple[int | None, bytes]]) -> None:
        self.kept.set((timer, sessions) if sessions else None)
        self.kept.flush()

    def getValueState(self, name: str, schema: Any = None) -> SessionValue:
        return SessionValue(self, name)


class SessionValue:
    """A value state of the open session of a bucket."""

    def __init__(self, sessions: Sessions, name: str) -> None:
        self.sessions, self.name = sessions, name

    def exists(self) -> bool:
        return self.name in self.sessions.values

    def get(self) -> tuple | None:
        return self.sessions.values.get(self.name)

    def update(self, value: tuple) -> None:
        self.sessions.values[self.name] = value

    def clear(self) -> None:
        self.sessions.values.pop(self.name, None)


def dealt(key: str, buckets: int) -> Column:
    """The bucket of a session."""
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def by_session(batch: pd.DataFrame, key: str, columns: Sequence[str], replaced: Mapping[str, list]) -> dict[Any, list[tuple]]:
    """Rows of each session as tuples, those of a NULL key left out; ``replaced`` are columns with other values."""
    names: dict[Any, Any] = {}
    # Equal names are one object, which is packed once.
    sessions = [names.setdefault(s, s) for s in batch[key].tolist()]
    values = [sessions if c == key else replaced[c] if c in replaced else batch[c].tolist() for c in columns]
    found: dict[Any, list[tuple]] = {}
    for session, row in zip(sessions, zip(*values)):
        found.setdefault(session, []).append(row)
    return {session: rows for session, rows in found.items() if not pd.isna(session)}


class InOrder(StatefulProcessor):
    """Hands the rows of each session to ``behind`` in the order of ``at``, one slot at a time.

    ``behind`` is a processor without timers of its own. If it has ``ended(key, at, late)``, that is called at the end of a
    session with the time of its last row and, when the key falls silent, the number of late rows since the last such call;
    a key that had late rows only is reported with ``at`` None. One with ``flush`` gets ``Rows``, may give lists of rows
    besides data frames, has value states only, and writes them when ``flush`` is called, once all slots of a session that are
    due have been handed over. Its sessions share buckets of state; any other has a key of its own for each session.

    A bucket has one timer, for what is due next, and few waiting rows of a session (``INLINE``) are read and written together
    with its place.
    """

    def __init__(
        self,
        behind: StatefulProcessor,
        at: str,
        received: str,
        columns: Sequence[str],
        lateness_s: float,
        slot_s: float | None = None,
        gap_s: float | None = None,
        key: str = "session_id",
    ) -> None:
        self.behind, self.key, self.at, self.received, self.columns = behind, key, at, received, list(columns)
        self.lateness_s, self.gap_s = lateness_s, gap_s
        self.slot_s = slot_s or max(lateness_s / 2, 1.0)
        self.plain = not hasattr(behind, "flush")
        if not self.plain:
            behind.flushes = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "session string, slot bigint", "rows binary")
        self.sessions = Sessions(handle)
        self.behind.init(handle if self.plain else self.sessions)

    def _place(self) -> tuple[float | None, float | None, int, dict[int, list[tuple] | None]]:
        """Last time handed over, newest receipt, late rows, and the waiting slots (None: in the map state) of the open session."""
        return self.sessions.values.get("_place") or (None, None, 0, {})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        timer, sessions = self.sessions.bucket()
        for batch in rows:
            times = batch[self.at].astype(float).tolist()
            receipts = batch[self.received].astype(float).tolist()
            found = by_session(batch, self.key, [*self.columns, "_at", "_got"], {self.at: times, "_at": times, "_got": receipts})
            for session, new in found.items():
                self.sessions.open(sessions.get(session, (None, None))[1])
                self._take(session, new)
                sessions[session] = (self._next_ms(), self.sessions.packed())
        self.sessions.flush(self._timed(timer, sessions), sessions)
        return iter(())

    def _take(self, session: Any, rows: list[tuple]) -> None:
        last, received, late, held = self._place()
        new: dict[int, list[tuple]] = {}
        for row in rows:
            at, got = row[-2:]
            if math.isfinite(got) and (received is None or got > received):
                received = got
            if not (math.isfinite(at) and got - at <= self.lateness_s):
                late += 1
            else:
                new.setdefault(math.floor(at / self.slot_s), []).append(row[:-2])
        self._hold(session, held, new)
        self.sessions.values["_place"] = (last, received, late, held)

    def _hold(self, session: Any, held: dict[int, list[tuple] | None], new: dict[int, list[tuple]]) -> None:
        for slot, part in new.items():
            if held.get(slot, part) is None:
                self._store(session, slot, self._stored(session, slot) + part)
            else:
                held[slot] = [*held.get(slot, ()), *part]
        if sum(len(part) for part in held.values() if part) > INLINE:
            for slot, part in held.items():
                if part is not None:
                    self._store(session, slot, part)
                    held[slot] = None

    def _stored(self, session: Any, slot: int) -> list[tuple]:
        return pickle.loads(self.waiting.getValue((str(session), slot))[0])

    def _store(self, session: Any, slot: int, part: list[tuple]) -> None:
        self.waiting.updateValue((str(session), slot), (pickle.dumps(part, pickle.HIGHEST_PROTOCOL),))

    def _due_ms(self, slot: int) -> int:
        return math.ceil(((slot + 1) * self.slot_s + self.lateness_s + SHIFT_S) * 1000)

    def _silence_ms(self, received: float) -> int:
        """When a later row on time is more than the gap behind every row so far."""
        return math.ceil((received + self.lateness_s + self.gap_s + SHIFT_S) * 1000) + 1

    def _next_ms(self) -> int | None:
        """When something is due for the open session."""
        _, received, _, held = self._place()
        if held:
            return self._due_ms(min(held))
        return None if self.gap_s is None or received is None else self._silence_ms(received)

    def _timed(self, timer: int | None, sessions: dict[Any, tuple[int | None, bytes]]) -> int | None:
        """The earliest timer of the bucket, set here if none is early enough; a later one then fires for nothing."""
        wanted = min((due for due, _ in sessions.values() if due is not None), default=None)
        if wanted is not None and (timer is None or wanted < timer):
            self.handle.registerTimer(wanted)
            return wanted
        return timer

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        timer, sessions = self.sessions.bucket()
        if timer is None or fired < timer:
            self.sessions.kept.flush()
            return
        yield from gathered(self._due(sessions, timerValues, max(fired, timerValues.getCurrentWatermarkInMs())))
        self.sessions.flush(self._timed(None, sessions), sessions)

    def _due(self, sessions: dict[Any, tuple[int | None, bytes]], timerValues: TimerValues, now: int) -> Iterator[list[dict] | pd.DataFrame]:
        for session in [s for s, (due, _) in sessions.items() if due is not None and due <= now]:
            self.sessions.open(sessions[session][1])
            yield from self._expired(session, timerValues, now)
            if not self.plain:
                self.behind.flush()
            packed = self.sessions.packed()
            if packed is None:
                del sessions[session]
            else:
                sessions[session] = (self._next_ms(), packed)

    def _expired(self, session: Any, timerValues: TimerValues, now: int) -> Iterator[list[dict] | pd.DataFrame]:
        last, received, late, held = self._place()
        at = self.columns.index(self.at)
        for slot in sorted(s for s in held if self._due_ms(s) <= now):
            rows = held.pop(slot)
            if rows is None:
                rows = self._stored(session, slot)
                self.waiting.removeKey((str(session), slot))
            rows.sort(key=lambda row: row[at])
            lo = 0
            for hi, row in enumerate(rows):
                if self.gap_s is not None and last is not None and row[at] - last > self.gap_s:
                    if lo < hi:
                        yield from self._handed(session, rows[lo:hi], timerValues)
                    yield from self._ended(session, last, 0)
                    lo = hi
                last = row[at]
            yield from self._handed(session, rows[lo:], timerValues)
        if self.gap_s is not None and received is not None and not held and self._silence_ms(received) <= now:
            if last is not None or late:
                yield from self._ended(session, last, late)
            self.sessions.values.pop("_place")
        else:
            self.sessions.values["_place"] = (last, received, late, held)

    def _handed(self, session: Any, rows: list[tuple], timerValues: TimerValues) -> Iterator[list[dict] | pd.DataFrame]:
        part = pd.DataFrame(rows, columns=self.columns) if self.plain else Rows(rows, self.columns)
        return self.behind.handleInputRows((session,), iter([part]), timerValues) or ()

    def _ended(self, session: Any, at: float | None, late: int) -> Iterator[list[dict] | pd.DataFrame]:
        if hasattr(self.behind, "ended"):
            yield from self.behind.ended((session,), at, late) or ()

    def close(self) -> None:
        self.behind.close()


def in_order(
    stream: DataFrame,
    behind: StatefulProcessor,
    output: StructType | str,
    at: str = "at",
    received: str = "received",
    lateness_s: float = 10.0,
    gap_s: float | None = None,
    key: str = "session_id",
    slot_s: float | None = None,
    skew: str = "1 second",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``behind`` run on the rows of each key of ``stream`` in the order of ``at``, whatever the order of arrival.

    ``skew`` is how far times of receipt may run back from one micro-batch to the next; rows further back are dropped by the
    engine and counted in the query's progress. A row without ``at`` or ``received`` is late. Rows of a NULL key only move
    the clock; they are left out by the processor, because a filter would be moved below the watermark. ``buckets`` is fixed when
    a stream first starts; the state of a bucket passes through the memory of a task.
    """
    clocked = stream.withColumn(CLOCK, clock(received)).withWatermark(CLOCK, skew)
    processor = InOrder(behind, at, received, stream.columns, lateness_s, slot_s, gap_s, key)
    return (
        clocked.withColumn(BUCKET, F.col(key) if processor.plain else dealt(key, buckets))
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=output,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


SESSION_ROWS = "session_id string, kind string, started_s double, ended_s double, n_rows bigint, n_late bigint"


class SessionProcessor(StatefulProcessor):
    """One closing row a session: its first and last time and its rows; a row of kind ``late`` counts late ones of a key."""

    flushes = True

    def __init__(self, at: str = "at") -> None:
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = Kept(handle, "session")

    def handleInputRows(self, key, rows: Iterator[Rows | pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        started, n = self.session.get() or (None, 0)
        for part in rows:
            started = next(tuples(part, [self.at]))[0] if started is None else started
            n += len(part)
        self.session.set((started, n))
        if self.flushes:
            self.flush()
        return iter(())

    def ended(self, key, at: float | None, late: int) -> Iterator[list[dict]]:
        out = []
        if self.session.get() is not None:
            started, n = self.session.get()
            out.append((key[0], "session", started, at, n, 0))
            self.session.set(None)
        if late:
            out.append((key[0], "late", None, None, 0, late))
        if self.flushes:
            self.flush()
        if out:
            columns = [f.split()[0] for f in SESSION_ROWS.split(", ")]
            yield [dict(zip(columns, row)) for row in out]

    def flush(self) -> None:
        self.session.flush()

    def close(self) -> None:
        pass


def session_ends(stream: DataFrame, at: str = "at", received: str = "received", lateness_s: float = 10.0, gap_s: float = 60.0, **options) -> DataFrame:
    """Closing rows of the sessions of a stream, and the late rows of each key once it falls silent."""
    return in_order(stream, SessionProcessor(at), SESSION_ROWS, at, received, lateness_s, gap_s, **options)
