"""Packing token pieces into sequences: dominance reduction, then best fit on what is left.

Whether and how pieces fit together depends on their lengths alone, so the instance is the number of pieces of each
length: at most ``capacity`` numbers, whatever the size of the corpus. The reduction takes the largest length j first and
fixes sets of pieces that provably dominate every other way to fill the sequence of j:

* j alone, if not even the smallest piece fits beside it;
* {j, k} if they fill the sequence exactly: whatever else stood beside j fits in place of k;
* {j, k} with the largest k that fits, if no two further pieces fit beside j;
* {j, k, b} with the largest k that fits, if they fill the sequence exactly, no three further pieces fit beside j, and
  no length lies between b and k.

Fixed pieces leave the instance, which may make the next sets dominant. The remainder is placed by best fit, lengths in
descending order, all sequences of one residual at a time. The plan is a list of runs (pieces r to r + n of a length go
to sequences s, s + 1, ... at an offset), joined with the pieces by their rank within a length. Ranks are counted in
salted parts, so a length that a third of all pieces share is not one task's.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import empty_text, stage
from tidemark.llm.shingles import by_bytes
from tidemark.llm.tokens import default_path, tokenizer

CAPACITY, END_ID, SALTS = 4096, 1, 64


@dataclass
class Instance:
    """Pieces left of each length, and the runs that place the others."""

    capacity: int
    left: dict[int, int]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def __post_init__(self) -> None:
        self.left = {n: c for n, c in self.left.items() if c > 0}
        self.lengths = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)

    def place(self, length: int, count: int, sequence: int, offset: int, per: int = 1) -> None:
        """The next ``count`` pieces of a length, ``per`` to a sequence, from ``sequence`` on, at ``offset``."""
        self.runs.append((length, self.used[length], count, sequence, offset, per))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fix(self, lengths: tuple[int, ...]) -> None:
        """As many sequences of exactly these pieces as there are pieces for."""
        need = {n: lengths.count(n) for n in lengths}
        count = min(self.left[n] // k for n, k in need.items())
        offset = 0
        for n, k in need.items():
            self.place(n, count * k, self.sequences, offset, k)
            offset += n * k
        self.sequences += count

    def largest_fit(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``room`` of which a piece is left besides those of ``without``."""
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0 and self.left[self.lengths[at]] <= without.count(self.lengths[at]):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def smallest(self, count: int, without: int) -> list[int]:
        """The ``count`` smallest pieces left besides one of length ``without``."""
        out: list[int] = []
        for n in self.lengths:
            out += [n] * min(self.left[n] - (n == without), count - len(out))
            if len(out) == count:
                break
        return out

    def reduce(self) -> None:
        """Fixes dominating sets, from the largest length down, until a pass fixes none."""
        changed = True
        while changed:
            changed = False
            for j in reversed(self.lengths.copy()):
                while j in self.left and (chosen := self.dominating(j)):
                    self.fix(chosen)
                    changed = True

    def dominating(self, j: int) -> tuple[int, ...] | None:
        room = self.capacity - j
        k = self.largest_fit(room, (j,))
        if k is None:
            return (j,)
        if k == room:
            return (j, k)
        few = self.smallest(3, j)
        if len(few) < 2 or few[0] + few[1] > room:
            return (j, k)
        if len(few) == 3 and sum(few) <= room:
            return None
        # At most two pieces fit beside j, and none larger than k. An exact pair k + b dominates if no length lies
        # between b and k: of any other two, the larger fits in place of k and the smaller in place of b.
        b = room - k
        if 0 < b <= k and self.left.get(b, 0) > (b == j) + (b == k) and self.left[k] > (k == j):
            inner = self.lengths[bisect.bisect_right(self.lengths, b) : bisect.bisect_left(self.lengths, k)]
            if all(n == j and self.left[n] == 1 for n in inner):
                return (j, k, b)
        return None

    def best_fit(self) -> None:
        """Every length in descending order into the fullest sequences it fits in."""
        open_: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, first: int, count: int) -> None:
            if count and room:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((first, count))

        for length in reversed(self.lengths.copy()):
            while length in self.left:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, count = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    per = self.capacity // length
                    room, first, count = self.capacity, self.sequences, -(-self.left[length] // per)
                    self.sequences += count
                per, have = room // length, self.left[length]
                whole = min(count, have // per)
                offset = self.capacity - room
                if whole:
                    self.place(length, whole * per, first, offset, per)
                    put(room - per * length, first, whole)
                rest = have - whole * per if whole < count else 0
                if rest:
                    self.place(length, rest, first + whole, offset, rest)
                    put(room - rest * length, first + whole, 1)
                    whole += 1
                put(room, first + whole, count - whole)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, rank, count, sequence, offset, pieces a sequence) for all pieces, and the number of sequences."""
    instance = Instance(capacity, dict(counts))
    instance.reduce()
    instance.best_fit()
    return instance.runs, instance.sequences


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of every whole text and the end id, cut to ``capacity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(path)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in by_bytes(texts, 1 << 19):
                out = []
                for doc, ids in zip(batch["doc_id"].iloc[lo:hi], encoder.ids(texts[lo:hi])):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        out.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", empty_text().alias("text")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows with sequence_id and offset. A NULL or empty text is the end id alone.

    Repeated rows are packed as often as they come. Other columns are ignored. An empty table gives no rows.
    """
    cut = stage(pieces(docs, path or default_path(), capacity), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    parts = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    # At most ``capacity`` rows reach the driver, and the runs are a few times as many.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    before = F.expr("coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0)")
    own = F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1")
    ranked = salted.withColumn("own", own).join(parts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("at"))
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (table[:, 0] << 40) + table[:, 1]
        for batch in batches:
            length, at = batch["length"].to_numpy(), batch.pop("at").to_numpy()
            own = table[np.searchsorted(keys, (length << 40) + at, "right") - 1]
            r = at - own[:, 1]
            yield batch.assign(sequence_id=own[:, 3] + r // own[:, 5], offset=own[:, 4] + r % own[:, 5] * length)

    return ranked.mapInPandas(
        placed,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
