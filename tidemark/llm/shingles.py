"""Word-shingle sets as sorted arrays of 64-bit hashes, computed over whole batches of texts with numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor, shift, multiply rounds)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of lower-cased UTF-8 bytes, in pieces cut at white space."""
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        cut = _SPACE.search(data, lo + PIECE) if lo + PIECE < len(data) else None
        hi = cut.start() if cut else len(data)
        b = np.frombuffer(data, np.uint8, hi - lo, lo)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(_BASE, len(b)), _powers(pow(_BASE, -1, 1 << 64), len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Per text its distinct shingles, sorted; fewer words than ``WIDTH`` make one shingle, none an empty set."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    words, starts = word_hashes(b"\n".join(data))
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    rolled = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for i in range(WIDTH):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + words[i : i + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo >= WIDTH:
            out.append(np.unique(rolled[lo : hi - WIDTH + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                whole = mixed(whole * np.uint64(0x9FB21C651E98DF25) + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def by_bytes(texts: list[str | None], most: int = 2 << 20):
    """Index ranges of consecutive texts of about ``most`` characters together; a longer text stands alone."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if texts:
        yield lo, len(texts)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """(lo, hi, texts) of consecutive rows of about ``most`` bytes together, so few texts are Python strings at a time."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > most:
            yield lo, i, texts.slice(lo, i - lo).to_pylist()
            lo, held = i, 0
        held += n
    if len(sizes):
        yield lo, len(sizes), texts.slice(lo).to_pylist()
