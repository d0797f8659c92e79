"""Personal data: patterns with exact checks, and a character tagger for the forms they do not cover.

Emails, addresses, card and phone numbers of the usual forms are found by patterns. Other forms (a phone number without
a plus, dotted card numbers, "name (at) host") are proposed by a character-level bidirectional LSTM with CRF transitions,
trained in numpy from spans the patterns label in a bounded sample and from rewritten forms of them. A proposal that meets
no pattern's span and has the digits or parts of its kind is added. Every kind holds a digit, an @ or a bracketed "at", so
overlapping windows are laid around these characters only; each window is decoded, and the windows of a region are
reconciled by one decoding of the whole region over their weighted mean scores.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lstm import Adam, BiLstm
from tidemark.llm.shared import empty_text
from tidemark.llm.shingles import by_bytes

KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns, written so that no failed start is tried twice: a number or name is only
# entered at its first character, and an email is looked for from its @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

WINDOW, STRIDE, REACH = 64, 32, 32
SAMPLE_ROWS, HIDDEN, STEPS, BATCH = 1500, 12, 140, 96
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
# Characters with an input class of their own; others go by letter case, digit, space or rest.
_MARKS = "@.-+()_%:/,[]=\"' \n#*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_byte(digits: str) -> bool:
    """Whether digits, of any number, are at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end), sorted."""
    out = [(a, 0, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(is_byte(p) for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def classes(text: str) -> np.ndarray:
    """Input class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(256, len(_MARKS) + 4, np.int64)
    for c in range(256):
        ch = chr(c)
        if ch in _MARKS:
            table[c] = _MARKS.index(ch)
        elif ch.isdigit() and c < 128:
            table[c] = len(_MARKS)
        elif ch.isalpha():
            table[c] = len(_MARKS) + (1 if ch.islower() else 2)
        elif ch.isspace():
            table[c] = len(_MARKS) + 3
    return np.where(codes < 256, table[np.minimum(codes, 255)], len(_MARKS) + 4)


INPUTS, LABELS = len(_MARKS) + 5, 1 + len(KINDS)


def decode(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of padded sequences (rows x steps x labels) under transition scores."""
    rows, steps, k = scores.shape
    back = np.zeros((steps, rows, k), np.int8)
    best = scores[:, 0].copy()
    last = best.copy()
    for t in range(1, steps):
        ways = best[:, :, None] + moves[None]
        back[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, t]
        here = lengths - 1 == t
        last[here] = best[here]
    out = np.zeros((rows, steps), np.int8)
    now = last.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = now[inside]
        if t:
            step = back[t][np.arange(rows), now]
            now = np.where(inside, step, now)
    return out


class Tagger:
    """BiLSTM scores of labels for each character, and CRF transitions."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.net = BiLstm(INPUTS, HIDDEN, rng)
        self.out = (rng.normal(size=(2 * HIDDEN, LABELS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(LABELS, np.float32)
        self.moves = np.zeros((LABELS, LABELS), np.float32)

    def scores(self, windows: np.ndarray, lengths: np.ndarray, keep: bool = False) -> np.ndarray:
        x = np.eye(INPUTS, dtype=np.float32)[windows]
        self.hidden = self.net.forward(x, lengths, keep)
        return self.hidden @ self.out + self.bias

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 12) -> None:
        rng, adam = np.random.default_rng(seed), Adam(0.02)
        for _ in range(steps if len(windows) else 0):
            pick = rng.integers(len(windows), size=BATCH)
            scores = self.scores(windows[pick], lengths[pick], keep=True)
            dscores, dmoves = crf_gradient(scores, lengths[pick], labels[pick], self.moves)
            dscores, dmoves = dscores / BATCH, dmoves / BATCH
            grads = self.net.backward(dscores @ self.out.T)
            adam.step(
                [*self.net.parameters(), self.out, self.bias, self.moves],
                [*grads, np.einsum("bth,btk->hk", self.hidden, dscores), dscores.sum(axis=(0, 1)), dmoves],
            )

    def labels(self, regions: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of whole regions: windows decoded, then all windows of a region reconciled."""
        cut = [(k, lo) for k, r in enumerate(regions) for lo in range(0, max(1, len(r) - WINDOW + STRIDE), STRIDE)]
        total = [np.zeros((len(r), LABELS)) for r in regions]
        weight = [np.zeros(len(r)) for r in regions]
        votes = [np.zeros((len(r), LABELS)) for r in regions]
        for at in range(0, len(cut), 512):
            own = cut[at : at + 512]
            lengths = np.array([min(WINDOW, len(regions[k]) - lo) for k, lo in own])
            windows = np.zeros((len(own), WINDOW), np.int64)
            for row, (k, lo), n in zip(windows, own, lengths):
                row[:n] = regions[k][lo : lo + n]
            scores = self.scores(windows, lengths)
            best = decode(scores, lengths, self.moves)
            for s, b, (k, lo), n in zip(scores, best, own, lengths):
                # Characters near a window's border were seen with little context and count less.
                w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(float)
                total[k][lo : lo + n] += w[:, None] * s[:n]
                weight[k][lo : lo + n] += w
                votes[k][np.arange(lo, lo + n), b[:n]] += w
        out = [np.zeros(0, np.int8)] * len(regions)
        order = sorted(range(len(regions)), key=lambda k: len(regions[k]))
        for own in _padded_groups(order, [len(r) for r in regions]):
            lengths = np.array([len(regions[k]) for k in own])
            scores = np.zeros((len(own), lengths.max(), LABELS))
            for row, k in zip(scores, own):
                row[: len(regions[k])] = (total[k] + votes[k]) / weight[k][:, None]
            for b, k in zip(decode(scores, lengths, self.moves), own):
                out[k] = b[: len(regions[k])]
        return out


def _padded_groups(order: list[int], sizes: list[int], most: int = 1 << 16) -> Iterator[list[int]]:
    """Groups of regions in ascending order of size that are padded to at most ``most`` characters together.

    A longer region stands alone.
    """
    own: list[int] = []
    for k in order:
        if own and (len(own) + 1) * sizes[k] > most:
            yield own
            own = []
        own.append(k)
    if own:
        yield own


def crf_gradient(scores: np.ndarray, lengths: np.ndarray, labels: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood of label sequences: expected minus observed counts."""
    rows, steps, k = scores.shape
    inside = np.arange(steps)[None, :] < lengths[:, None]
    e, m = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64), np.exp(moves.astype(np.float64))
    ahead, back = np.zeros((steps, rows, k)), np.ones((steps, rows, k)) / k
    ahead[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[t - 1] @ m) * e[:, t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (back[t + 1] * e[:, t + 1]) @ m.T
        b /= b.sum(axis=1, keepdims=True)
        back[t] = np.where((t + 1 < lengths)[:, None], b, 1 / k)
    marginal = (ahead * back).transpose(1, 0, 2)
    marginal /= marginal.sum(axis=2, keepdims=True)
    dscores = (marginal - np.eye(k)[labels]) * inside[:, :, None]
    dmoves = np.zeros((k, k))
    for t in range(1, steps):
        pair = ahead[t - 1][:, :, None] * m[None] * (e[:, t] * back[t])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        on = inside[:, t]
        dmoves += pair[on].sum(axis=0)
        np.subtract.at(dmoves, (labels[on, t - 1], labels[on, t]), 1)
    return dscores.astype(np.float32), dmoves.astype(np.float32)


def rewritten(kind: str, value: str, rng: np.random.Generator) -> str:
    """Another form of a found value."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "email":
        name, host = value.split("@", 1)
        return name + [" (at) ", "(at)", " [at] ", "[at]", " @ "][rng.integers(5)] + host
    if kind == "ip":
        return value.replace(".", ["[.]", " . ", "(.)"][rng.integers(3)])
    if kind == "card":
        return [".", "/", " - ", "_"][rng.integers(4)].join(re.findall(".{1,4}", digits))
    area, rest = digits[-10:-7], digits[-7:]
    return [f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}",
            f"00{digits[:-10]} {area} {rest[:3]} {rest[3:]}", f"({area}){rest[:3]} {rest[3:]}"][rng.integers(5)]


def examples(texts: list[str], seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, lengths and labels around the labelled spans, as they stand and rewritten, and around other numbers."""
    rng = np.random.default_rng(seed)
    windows, lengths, labels = [], [], []

    def add(text: str, spans: list[tuple[int, int, int]], centre: int) -> None:
        lo = max(0, centre - int(rng.integers(8, WINDOW - 8)))
        part, y = text[lo : lo + WINDOW], np.zeros(WINDOW, np.int64)
        for a, rank, b in spans:
            y[max(0, a - lo) : max(0, min(WINDOW, b - lo))] = 1 + rank
        w = np.zeros(WINDOW, np.int64)
        w[: len(part)] = classes(part)
        windows.append(w)
        lengths.append(len(part))
        labels.append(y)

    for text in texts:
        spans = [(a, rank, b) for a, rank, _, b in base_spans(text)]
        for a, rank, b in spans[:8]:
            add(text, spans, (a + b) // 2)
            for _ in range(2):
                new = rewritten(KINDS[rank], text[a:b], rng)
                before, after = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
                if not base_spans(before) and not base_spans(after):
                    add(before + new + after, [(len(before), rank, len(before) + len(new))], len(before) + len(new) // 2)
        for m in list(_TRIGGER.finditer(text))[:200:25]:
            if not any(a <= m.start() < b for a, _, b in spans):
                add(text, spans, m.start())
        # Numbers that are nobody's: counts, years, versions, dates, hex strings.
        if len(text) > 2 * WINDOW:
            at = int(rng.integers(WINDOW, len(text) - WINDOW))
            other = [str(rng.integers(10**6)), f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}",
                     f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(20)}", f"{rng.integers(1, 999)},{rng.integers(100, 999)}.{rng.integers(10, 99)}",
                     rng.bytes(12).hex(), f"{rng.integers(24)}:{rng.integers(60):02}"][rng.integers(6)]
            before, after = text[at - WINDOW : at], text[at : at + WINDOW]
            if not base_spans(before) and not base_spans(after):
                add(f"{before} {other} {after}", [], len(before) + 1)
    if not windows:
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack(windows), np.array(lengths), np.stack(labels)


_ANY_EMAIL = re.compile(r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[\w-]+(?:\.[\w-]+)+")


def plausible(kind: str, value: str) -> bool:
    """Whether a proposed value has what its kind needs."""
    groups = re.findall("[0-9]+", value)
    digits = "".join(groups)
    if kind == "email":
        return bool(_ANY_EMAIL.fullmatch(value))
    if re.search("[A-Za-z]", value):
        return False
    if kind == "ip":
        return len(groups) == 4 and value.count(".") == 3 and all(is_byte(g) for g in groups)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and 3 <= len(groups) <= 5
    return 9 <= len(digits) <= 15 and 3 <= len(groups) <= 5 and (value[0] == "(" or len(groups[-1]) == 4 and len(groups[-2]) == 3)


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text its base spans and the spans the tagger adds."""
    base, regions, places = [base_spans(t) for t in texts], [], []
    for k, text in enumerate(texts):
        lo = hi = -1
        for m in _TRIGGER.finditer(text):
            if hi >= 0 and m.start() - REACH <= hi:
                hi = m.end() + REACH
                continue
            if hi >= 0:
                places.append((k, lo, min(hi, len(text))))
            lo, hi = max(0, m.start() - REACH), m.end() + REACH
        if hi >= 0:
            places.append((k, lo, min(hi, len(text))))
    regions = [classes(texts[k][lo:hi]) for k, lo, hi in places]
    added: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    for (k, lo, _), labels in zip(places, tagger.labels(regions)):
        change = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        for a, b in zip(change[:-1].tolist(), change[1:].tolist()):
            if labels[a]:
                rank = int(labels[a]) - 1
                value = texts[k][lo + a : lo + b]
                start = lo + a + len(value) - len(value.lstrip(" ,;:\n\t"))
                value = value.strip(" ,;:.\n\t")
                end = start + len(value)
                if value and plausible(KINDS[rank], value) and not any(x < end and start < y for x, _, _, y in base[k]):
                    added[k].append((start, rank, KINDS[rank], end))
    return list(zip(base, added))


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most ``rows`` different texts with an @ or a run of digits, those with the smallest hashes of their ids.

    The hashes are ranked first, so few texts leave the tasks.
    """
    some = docs.where(F.col(text_col).rlike("@|[0-9]{3}"))
    some = some.select(F.struct(F.xxhash64(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("h"), F.col(text_col).alias("t"))
    edge = some.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if edge is None:
        return []
    below = F.col("h") <= F.struct(F.lit(edge["id"]).alias("id"), F.lit(edge["text"]).alias("text"))
    return [r["t"] for r in some.where(below).groupBy("h").agg(F.first("t").alias("t")).orderBy("h").limit(rows).collect()]


def fit(texts: list[str]) -> Tagger:
    tagger = Tagger()
    tagger.train(*examples(texts))
    return tagger


def personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and, if asked for, redacted of every row.

    ``spans`` lists kind:start:end of base and added spans by start, then kind; in ``redacted`` each stretch of spans is
    replaced by the kind of its first in angle brackets. A NULL text is empty. Repeated rows give the same result each.
    Of other columns those in ``keep`` are passed on; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("pii_text").tolist()
            for lo, hi in by_bytes(texts, 2 << 20):
                rows = []
                for text, (base, added) in zip(texts[lo:hi], find(texts[lo:hi], tagger)):
                    counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                    every = base + added
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(added), redact(text, every) if redacted else None))
                part = batch.iloc[lo:hi]
                names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "redacted"]
                done = pd.DataFrame(rows, columns=names, index=part.index)
                yield pd.concat([part, done if redacted else done.drop(columns="redacted")], axis=1)

    source = docs.select(F.col(id_col).alias("doc_id"), *[c for c in keep if c != "doc_id"], empty_text(text_col).alias("pii_text"))
    fields = [f for f in source.schema.fields if f.name != "pii_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"n_{k} long" for k in KINDS])
    schema += ", base_sha256 string, spans string, n_added long" + ", redacted string" * redacted
    return source.mapInPandas(run, schema)


def redact(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    out, at, end = [], 0, -1
    for a, _, kind, b in sorted(spans):
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]]) if out else text
