"""Token ids of whole texts by a public tokenizer, with the ids of repeated words kept in the worker."""

from __future__ import annotations

import os
import re
import unicodedata
from collections import defaultdict
from itertools import count

import numpy as np

from tidemark.llm.shared import worker_store

#: Letters below this code point are composed and change case one by one, so words can be looked up on their own.
NEAR = 0x250
# The white space of Unicode; str.split() takes four control characters for white space too.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == kind)


class Growing:
    """Arrays of ids one after the other, in one array that grows by doubling."""

    def __init__(self) -> None:
        self.flat, self.begin, self.held, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        if self.held + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.held], np.zeros(self.held + 2 * len(flat), np.uint32)])
        if self.n + len(counts) >= len(self.begin):
            self.begin = np.concatenate([self.begin[: self.n + 1], np.zeros(self.n + 2 * len(counts), np.int64)])
        self.flat[self.held : self.held + len(flat)] = flat
        self.begin[self.n + 1 : self.n + 1 + len(counts)] = self.held + np.cumsum(counts)
        self.held += len(flat)
        self.n += len(counts)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries ``at`` one after the other, and the number of each."""
        first = self.begin[at]
        counts = self.begin[at + 1] - first
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(first - (ends - counts), counts) + np.arange(total)], counts


class Numbered:
    """Numbers strings in the order in which they are first met, and keeps an array of ids for each."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = Growing()

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each string, and the strings that have none yet; their ids must be added next."""
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))
        top = np.maximum.accumulate(at) if len(at) else at
        fresh = np.flatnonzero(at > np.concatenate([[known - 1], np.maximum(top[:-1], known - 1)])) if len(at) else at
        return at, [strings[i] for i in fresh.tolist()]


class WordTokenizer:
    """ids(texts) equals ``encode(text, add_special_tokens=False).ids`` of the tokenizer file for every text.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its white-space separated
    chunks, one after the other. A chunk is encoded once and kept; the tables are emptied when they are full. New chunks
    of plain Latin letters are joined by line breaks and split at once by the tokenizer's own pattern, and only their new
    pieces go to the model; all other chunks, and those with a special token, go to the whole tokenizer.
    """

    def __init__(self, path: str, chunks: int = 400_000, pieces: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.most_chunks, self.most_pieces = chunks, pieces
        letters, numbers = _class("L"), _class("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+|\n").findall
        self.far = re.compile(f"[^\x00-{chr(NEAR - 1)}]|[\x1c-\x1f]|<\\|").search
        # The byte alphabet of byte-level BPE, printable bytes as themselves, others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.chunks, self.pieces = Numbered(), Numbered()

    def _model_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that the pattern does not split; a line break has none."""
        tokenize, alphabet = self.whole.model.tokenize, self.alphabet
        flat: list[int] = []
        counts = []
        for piece in pieces:
            plain = piece.isascii() and piece.isprintable()
            got = [] if piece == "\n" else tokenize(piece if plain else piece.encode().decode("latin-1").translate(alphabet))
            counts.append(len(got))
            flat += [t.id for t in got]
        return np.array(flat, np.uint32), np.array(counts, np.int64)

    def _split_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks by their pieces."""
        found = self.split("\n".join(chunks).lower())
        if len(self.pieces.number) > self.most_pieces:
            self.pieces = Numbered()
        at, new = self.pieces(found)
        self.pieces.ids.add(*self._model_ids(new))
        flat, count_of = self.pieces.ids.gather(at)
        breaks = at == self.pieces.number["\n"] if len(chunks) > 1 else np.zeros(len(at), bool)
        return flat, np.bincount(np.cumsum(breaks), count_of, len(chunks)).astype(np.int64)

    def _whole_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.far("\n".join(chunks)):
            return self._split_ids(chunks)
        whole = [bool(self.far(c)) for c in chunks]
        parts = Growing()
        plain = [c for c, w in zip(chunks, whole) if not w]
        if plain:
            parts.add(*self._split_ids(plain))
        parts.add(*self._whole_ids([c for c, w in zip(chunks, whole) if w]))
        place = np.empty(len(chunks), np.int64)
        place[np.argsort(whole, kind="stable")] = np.arange(len(chunks))
        return parts.gather(place)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [[w for w in _SPACES.split(t) if w] if _CONTROLS.search(t) else t.split() for t in texts]
        if len(self.chunks.number) > self.most_chunks:
            self.chunks = Numbered()
        at, new = self.chunks([w for own in split for w in own])
        self.chunks.ids.add(*self._new_ids(new))
        flat, counts = self.chunks.ids.gather(at)
        words = np.cumsum([len(own) for own in split])
        ends = np.concatenate([[0], np.cumsum(counts)])[words].tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process, made once."""
    store = worker_store("tokenizers")
    if path not in store:
        store[path] = WordTokenizer(path)
    return store[path]
