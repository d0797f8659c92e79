"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans of mixed texts.

Fitting counts hashed character n-grams (1 to 4 characters with word borders) per language over a bounded sample. A word's
score in a language is the mean log probability of its n-grams, times the square root of their number. Languages whose
training text hardly uses the script of a word are no candidates for it. Viterbi with a switching penalty then labels
every word of the whole text, and words of one label side by side form a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import by_bytes, text_slices

# First and last code point of the letters of a script.
SCRIPTS = {
    "latin": (0x41, 0x24F),
    "greek": (0x370, 0x3FF),
    "cyrillic": (0x400, 0x52F),
    "armenian": (0x530, 0x58F),
    "hebrew": (0x590, 0x5FF),
    "arabic": (0x600, 0x77F),
    "devanagari": (0x900, 0x97F),
    "bengali": (0x980, 0x9FF),
    "tamil": (0xB80, 0xBFF),
    "thai": (0xE00, 0xE7F),
    "georgian": (0x10A0, 0x10FF),
    "kana": (0x3040, 0x30FF),
    "han": (0x3400, 0x9FFF),
    "hangul": (0xAC00, 0xD7AF),
}
_FIRST = np.array([a for a, _ in SCRIPTS.values()])
_LAST = np.array([b for _, b in SCRIPTS.values()])
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3, 4)
#: Rows of each language that a model is fitted on, at most.
SAMPLE_ROWS = 2000
PENALTY = 10.0
#: A language is a candidate for a script that makes up this share of its training letters.
SCRIPT_SHARE = 0.01
_WORD = re.compile(r"[^\W\d_]+")


def script_of(codes: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS per code point, ``len(SCRIPTS)`` for others."""
    at = np.searchsorted(_FIRST, codes, "right") - 1
    return np.where((at >= 0) & (codes <= _LAST[at]), at, len(SCRIPTS))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, the word it belongs to, and the script of each word's first letter."""
    joined = "\x02" + "\x02".join(words).lower() + "\x02"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    border = codes == 2
    word = np.cumsum(border) - 1
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        # An n-gram may begin or end with a border but not hold one inside.
        held = np.concatenate([[0], np.cumsum(border)])
        inner = held[n - 1 : len(codes)] - held[1 : len(codes) - n + 2] if n > 2 else np.zeros(len(h), np.int64)
        ok = (inner == 0) & ~((n <= 2) & border[: len(h)] & border[n - 1 :])
        buckets.append(((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64))
        owners.append(word[: len(h)][ok])
    first = script_of(codes[np.flatnonzero(border)[:-1] + 1].astype(np.int64))
    return np.concatenate(buckets), np.concatenate(owners), first


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log probabilities
    allowed: np.ndarray  # scripts + 1 x languages
    counts: np.ndarray  # BUCKETS x languages, n-grams of the training rows

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of log probabilities (words x languages), number of n-grams and script of each word."""
        bucket, owner, script = ngrams(words)
        sums = np.stack([np.bincount(owner, w[bucket], len(words)) for w in self.weights.T], axis=1)
        return sums, np.maximum(np.bincount(owner, minlength=len(words)), 1), script

    def word_scores(self, sums: np.ndarray, n: np.ndarray, script: np.ndarray) -> np.ndarray:
        """words x languages; a language that is no candidate gets a score far below the others."""
        out = sums / np.sqrt(n[:, None])
        out -= out.max(axis=1, keepdims=True)
        candidate = self.allowed[script]
        # A script that no language is known for says nothing.
        return np.where(candidate.any(axis=1, keepdims=True), np.where(candidate, out, -50.0), 0.0)


def _by_words(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Words of all texts, about ``most`` at a time, so that the driver holds few of them."""
    held: list[str] = []
    for text in texts:
        held += _WORD.findall(text)
        if len(held) >= most:
            yield held
            held = []
    if held:
        yield held


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model from (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    counts = np.zeros((BUCKETS, max(len(languages), 1)))
    scripts = np.zeros((len(SCRIPTS) + 1, max(len(languages), 1)))
    for k, lang in enumerate(languages):
        for words in _by_words((text for text, own in rows if own == lang), 10_000):
            bucket, _, script = ngrams(words)
            counts[:, k] += np.bincount(bucket, minlength=BUCKETS)
            scripts[:, k] += np.bincount(script, minlength=len(SCRIPTS) + 1)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    weights = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * BUCKETS)
    return LanguageModel(languages, weights, share >= SCRIPT_SHARE, counts)


@dataclass
class Floors:
    """Per language the least mean log probability of a text's n-grams; shorter texts are allowed less."""

    base: np.ndarray
    spread: np.ndarray  # deviation of the means of single words

    def of(self, language: int, words: int) -> float:
        return float(self.base[language] - 3 * self.spread[language] / np.sqrt(words))


def floors(model: LanguageModel, rows: list[tuple[str, str]]) -> Floors:
    """Floors from the rows a model was fitted on, each scored without its own n-grams.

    The floor lies as far below the 1 % quantile of a language's texts as that lies below their median.
    """
    base, spread = np.full(len(model.languages), -np.inf), np.zeros(len(model.languages))
    for k, lang in enumerate(model.languages):
        means, words_of, moments = [], [], np.zeros(3)
        total = model.counts[:, k].sum()
        for text, own in rows:
            words = _WORD.findall(text) if own == lang else []
            if not words:
                continue
            bucket, owner, script = ngrams(words)
            other = model.counts[:, k] - np.bincount(bucket, minlength=BUCKETS)
            score = np.log(other[bucket] + 0.5) - np.log(total - len(bucket) + 0.5 * BUCKETS)
            n = np.bincount(owner, minlength=len(words))
            known = model.allowed[script, k] & (n > 0)
            if not known.any():
                continue
            sums = np.bincount(owner, score, len(words))[known]
            single = sums / n[known]
            means.append(sums.sum() / n[known].sum())
            words_of.append(len(single))
            moments += len(single), single.sum(), (single**2).sum()
        if means:
            count, first, second = moments
            spread[k] = np.sqrt(max(second / count - (first / count) ** 2, 0.0))
            level = np.array(means) + 3 * spread[k] / np.sqrt(words_of)
            base[k] = 2 * np.quantile(level, 0.01) - np.median(level)
    return Floors(base, spread)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of every word; ``scores`` holds the texts one after the other.

    All texts move on together, the longest first, so a step costs the texts that still have a word.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    long_first = lengths[order]
    labels = np.zeros(len(scores), np.int16)
    back = np.zeros(scores.shape, bool)  # whether the best way to a state is a switch
    best_before = np.zeros(len(scores), np.int16)
    state = scores[begin[long_first > 0]].astype(np.float64)
    ends = np.zeros(len(lengths), np.int64)
    ends[: len(state)] = state.argmax(axis=1)
    alive = len(state)
    for t in range(1, int(long_first[0]) if len(long_first) else 0):
        alive = int(np.searchsorted(-long_first, -t, "left"))
        at = begin[:alive] + t
        before = state[:alive]
        top = before.argmax(axis=1)
        switched = before[np.arange(alive), top][:, None] - penalty
        back[at] = switched > before
        best_before[at] = top
        state = np.maximum(before, switched) + scores[at]
        ends[:alive] = state.argmax(axis=1)
    now = ends
    for t in range((int(long_first[0]) if len(long_first) else 0) - 1, -1, -1):
        alive = int(np.searchsorted(-long_first, -t, "left"))
        at = begin[:alive] + t
        labels[at] = now[:alive]
        if t:
            now[:alive] = np.where(back[at, now[:alive]], best_before[at], now[:alive])
    return labels


class Labeller:
    """Labels texts with a model; scores of words are kept in a table of bounded size.

    With ``floors`` it also says whether texts are in a known language.
    """

    def __init__(
        self, model: LanguageModel, penalty: float = PENALTY, held: int = 200_000, floors: Floors | None = None
    ) -> None:
        self.model, self.penalty, self.most, self.floors = model, penalty, held, floors
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))
        # Sums, numbers of n-grams and whether any language is a candidate, for the floors.
        self.fit = (np.zeros((0, len(model.languages))), np.zeros(0, np.int64), np.zeros(0, bool))

    def _ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.index]
        if len(self.index) + len(new) > self.most:
            self.index, new = {}, list(set(words))
            self.table, self.fit = self.table[:0], tuple(f[:0] for f in self.fit)
        if new:
            new.sort()
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            parts = [self.model.word_sums(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
            self.table = np.concatenate([self.table, *[self.model.word_scores(*p) for p in parts]])
            if self.floors is not None:
                own = [(sums, n, self.model.allowed[script].any(axis=1)) for sums, n, script in parts]
                self.fit = tuple(np.concatenate(f) for f in zip(self.fit, *own))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """Per text the language of most of its letters, their share, and the spans as start:end:language."""
        found = [_WORD.findall(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in found], np.int64)
        words = [w for own in found for w in own]
        if not words or not self.model.languages:
            return [("und", 0.0, "")] * len(texts)
        labels = viterbi(self.table_rows(words), lengths, self.penalty)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        out = []
        for text, lo, hi in zip(texts, (ends - lengths).tolist(), ends.tolist()):
            if lo == hi:
                out.append(("und", 0.0, ""))
                continue
            own, size = labels[lo:hi], letters[lo:hi]
            total = np.bincount(own, size, len(self.model.languages))
            top = int(total.argmax())
            out.append((self.model.languages[top], float(total[top] / total.sum()), self._spans(text, own)))
        return out

    def known(self, texts: list[str | None], least: float) -> list[bool]:
        """Whether a text has at least ``least`` of its letters in one language and is no worse than that one's floor.

        Letters of scripts that no language is known for count as those of no language.
        """
        found = [_WORD.findall(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in found], np.int64)
        words = [w for own in found for w in own]
        if not words or not self.model.languages:
            return [False] * len(texts)
        ids = self._ids(words)
        sums, n, candidate = (f[ids] for f in self.fit)
        labels = viterbi(self.table[ids], lengths, self.penalty)
        own = sums[np.arange(len(words)), labels]
        letters = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        out = []
        for lo, hi in zip((ends - lengths).tolist(), ends.tolist()):
            seen = lo + np.flatnonzero(candidate[lo:hi])
            total = np.bincount(labels[seen], letters[seen], len(self.model.languages))
            top = int(total.argmax())
            good = len(seen) > 0 and total[top] >= least * letters[lo:hi].sum()
            out.append(bool(good and own[seen].sum() >= self.floors.of(top, len(seen)) * n[seen].sum()))
        return out

    def table_rows(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.table[ids]

    def _spans(self, text: str, labels: np.ndarray) -> str:
        change = np.flatnonzero(np.diff(labels))
        if not len(change):
            return f"0:{len(text)}:{self.model.languages[labels[0]]}"
        starts = np.array([m.start() for m in _WORD.finditer(text)])
        begin = np.concatenate([[0], starts[change + 1]]).tolist()
        return ",".join(
            f"{a}:{b}:{self.model.languages[k]}"
            for a, b, k in zip(begin, begin[1:] + [len(text)], labels[np.concatenate([change, [-1]])])
        )


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: remainder 2 of the id's checksum; a NULL id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` texts of each language, those with the smallest hashes of their ids."""
    ranked = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    least = ranked.groupBy("lang").agg(F.count("*").alias("n")).collect()
    picks = None
    for r in least:
        # The hash is uniform, so this share of the hash range holds about ``rows`` documents.
        share = min(1.0, rows / r["n"])
        own = (F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
        picks = own if picks is None else picks | own
    if picks is None:
        return []
    return [(r["text"], r["lang"]) for r in ranked.where(picks).select("text", "lang").toLocalIterator()]


def identify(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row; a text that is NULL or has no letter is ``und`` with score 0.

    The score is the share of the letters in spans of the predicted language. Ties go to the first language by name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for lo, hi in by_bytes(texts, 1 << 20):
                part = batch.iloc[lo:hi]
                got = pd.DataFrame(labeller(texts[lo:hi]), columns=["lang_pred", "score", "spans"], index=part.index)
                yield pd.concat([part[["doc_id", "held_out"]], got], axis=1)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, spans string"
    )


def accepted(
    docs: DataFrame, model: LanguageModel, floors: Floors, least: float = 0.5, penalty: float = PENALTY
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is in a known language by at least ``least`` of its letters.

    A text in another language is known by letters of other scripts, or by n-grams below the floor of its best language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty, floors=floors)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, most=1 << 19):
                keep = labeller.known(texts, least)
                yield batch.slice(lo, hi - lo).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
