"""Vector bin packing: examples placed by dot products under limits on tokens, segments and loss-bearing tokens.

An example is the ids of its prompt, of its text and an end id. A piece of it asks for a vector: its tokens, one segment
and its loss-bearing tokens (ids after the prompt, but for the first of the piece, which nothing predicts). A sequence is
filled by the piece whose vector, each part taken as a share of its limit, has the largest dot product with the room that
is left: a large piece where there is room, one that is rich in what the sequence has most room for later. Where nothing
fits any more and more than ``slack`` tokens are free, the piece with the largest product is cut at the room. Sequences are
padded to the limit unless their length is a power of two, so a sequence that a limit on segments or loss closes early, and
the last ones, give their ends back until a power of two is left.

Pieces are placed where their texts are read: a task holds the ids of at most ``POOL`` tokens in ``POOL_PIECES`` pieces,
fills sequences until an eighth is left, and reads on. Nothing is shuffled, no document meets the driver, and no key gathers
rows; a task that is run again after a loss gives the same rows. Sequences are numbered by partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import empty_text
from tidemark.llm.shingles import by_bytes
from tidemark.llm.tokens import default_path, tokenizer

END_ID = 2
POOL, POOL_PIECES = 1 << 22, 1 << 16
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold, and how many free tokens are left as padding rather than cut a piece."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096
    slack: int = 16


@dataclass(frozen=True)
class Piece:
    """Ids of an example from ``start`` on; ``prompt`` counts the ids of the whole example that bear no loss."""

    doc: int | None
    start: int
    ids: np.ndarray
    whole: int
    prompt: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start + 1, self.prompt))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:n], self.whole, self.prompt),
            Piece(self.doc, self.start + n, self.ids[n:], self.whole, self.prompt),
        )

    def longest(self, tokens: int, loss: int) -> int:
        """The most ids of its head within these limits."""
        return max(0, min(len(self.ids), tokens, loss + max(self.start + 1, self.prompt) - self.start))


class Pool:
    """Pieces that wait for a place, those of one vector on one stack."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.stacks: dict[tuple[int, int], list[Piece]] = {}
        self.tokens = self.pieces = 0
        self.stale = True

    def add(self, piece: Piece) -> None:
        key = (len(piece.ids), piece.loss)
        if key not in self.stacks:
            self.stacks[key] = []
            self.stale = True
        self.stacks[key].append(piece)
        self.tokens += len(piece.ids)
        self.pieces += 1

    def _take(self, at: int) -> Piece:
        piece = self.stacks[self.keys[at]].pop()
        self.empty[at] = not self.stacks[self.keys[at]]
        self.tokens -= len(piece.ids)
        self.pieces -= 1
        return piece

    def _index(self) -> None:
        """Vectors in ascending order of tokens, so those that fit a room by tokens stand in front."""
        if self.stale or 2 * self.empty.sum() > len(self.empty):
            self.stacks = {k: s for k, s in self.stacks.items() if s}
            self.keys = sorted(self.stacks)
            both = np.array(self.keys, np.int64).reshape(-1, 2)
            self.size, self.loss = both[:, 0].copy(), both[:, 1].copy()
            self.shares = both / np.array([self.limits.tokens, max(self.limits.loss, 1)])
            self.empty = np.zeros(len(self.keys), bool)
            self.stale = False

    def best(self, room: tuple[int, int, int], fits: bool = True) -> int | None:
        """The vector of the largest dot product with (tokens, segments, loss) left, of those that fit or of all."""
        self._index()
        n = int(np.searchsorted(self.size, room[0], "right")) if fits else len(self.keys)
        products = self.shares[:n] @ np.array([room[0] / self.limits.tokens, room[2] / max(self.limits.loss, 1)])
        products[self.empty[:n]] = -1.0
        if fits:
            products[self.loss[:n] > room[2]] = -1.0
        at = int(products.argmax()) if n else 0
        # One segment asks the same share of the room of every piece and changes no comparison.
        return at if n and products[at] >= 0 else None

    def fill(self) -> list[Piece]:
        """The pieces of one more sequence."""
        limits, out = self.limits, []
        tokens, loss = limits.tokens, limits.loss
        while self.pieces and tokens and len(out) < limits.segments:
            at = self.best((tokens, limits.segments - len(out), loss))
            if at is None:
                at = self.best((tokens, limits.segments - len(out), loss), fits=False) if tokens > limits.slack else None
                piece = self._take(at) if at is not None else None
                n = piece.longest(tokens, loss) if piece else 0
                if piece and n:
                    piece, rest = piece.cut(n)
                    self.add(rest)
                elif piece:
                    self.add(piece)
                if not n:
                    break
            else:
                piece = self._take(at)
            out.append(piece)
            tokens -= len(piece.ids)
            loss -= piece.loss
        return self._even(out, limits.tokens - tokens)

    def _even(self, out: list[Piece], held: int) -> list[Piece]:
        """Gives the end back until a power of two is held, where too much would be padded."""
        if limits_gap(held, self.limits):
            over = held - (1 << (held.bit_length() - 1))
            while over:
                last = out.pop()
                if len(last.ids) > over:
                    head, last = last.cut(len(last.ids) - over)
                    out.append(head)
                over -= len(last.ids)
                self.add(last)
        return out


def limits_gap(held: int, limits: Limits) -> bool:
    """Whether a sequence of ``held`` tokens would be padded by more than the slack."""
    return limits.tokens - held > limits.slack and held & (held - 1) != 0


def sequences(examples: Iterator[tuple[int | None, np.ndarray, int]], limits: Limits) -> Iterator[list[Piece]]:
    """Sequences of all (id, ids, prompt length), whole parts of ``limits.tokens`` of long examples first."""
    pool = Pool(limits)
    for doc, ids, prompt in examples:
        rest = Piece(doc, 0, ids, len(ids), prompt)
        while len(rest.ids) > limits.tokens:
            head, rest = rest.cut(limits.tokens)
            if head.loss <= limits.loss and limits.segments:
                yield [head]
            else:
                pool.add(head)
        # A copy, so that the pool does not keep what the piece was cut from.
        pool.add(Piece(doc, rest.start, rest.ids.copy(), rest.whole, rest.prompt))
        if pool.tokens > POOL or pool.pieces > POOL_PIECES:
            while pool.tokens > POOL // 8 and pool.pieces > POOL_PIECES // 8 or pool.tokens > POOL or pool.pieces > POOL_PIECES:
                yield pool.fill()
    while pool.pieces:
        yield pool.fill()


def pack_vectors(
    docs: DataFrame,
    path: str | None = None,
    limits: Limits = Limits(),
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A NULL or empty text is the end id alone; without ``prompt_col``, or where it is NULL, the prompt is empty. Rows count
    each, also repeated ones and those with a NULL id. A text of any length is cut, never dropped. Other columns are
    ignored, whatever their names; an empty table gives no rows. Every id lies in exactly one piece. ``limits`` must allow
    a segment with one loss-bearing token.
    """
    if limits.segments < 1 or limits.loss < 1 or limits.tokens < 2:
        raise ValueError("limits must allow a segment with a loss-bearing token")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = tokenizer(path or default_path()), np.array([end_id], np.uint32)

        def examples() -> Iterator[tuple[int | None, np.ndarray, int]]:
            for batch in batches:
                texts, prompts = batch["text"].tolist(), batch["prompt"].tolist()
                for lo, hi in by_bytes(texts, 1 << 19):
                    heads = encoder.ids(prompts[lo:hi]) if prompt_col else [end[:0]] * (hi - lo)
                    for doc, head, ids in zip(batch["doc_id"].iloc[lo:hi], heads, encoder.ids(texts[lo:hi])):
                        yield None if pd.isna(doc) else int(doc), np.concatenate([head, ids, end]), len(head)

        first, rows = TaskContext.get().partitionId() << 40, []
        for number, held in enumerate(sequences(examples(), limits)):
            offset = 0
            for p in held:
                crc = zlib.crc32(p.ids.astype("<u4").tobytes())
                rows.append((p.doc, p.start, len(p.ids), crc, p.whole, first + number, offset, p.loss))
                offset += len(p.ids)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})

    prompt = empty_text(prompt_col) if prompt_col else F.lit("")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"), prompt.alias("prompt"))
    return source.mapInPandas(run, FIELDS)
