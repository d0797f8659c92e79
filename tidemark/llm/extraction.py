"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. A block's input is two hashed vectors, one of its tag path (names, class
and id words, pairs of neighbouring steps) and one of its words, and a few measures of length, links and place. A
bidirectional LSTM in numpy reads the whole sequence, so each block is classified with the whole document in view.

It is trained from a bounded sample of pages. Their blocks are labelled by their own markup, and each sampled page also
gives variants in which its blocks stand in other common layouts, so the labels do not hang on one template.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import Leaf, leaves
from tidemark.llm.lstm import Adam, BiLstm, sigmoid
from tidemark.llm.shingles import by_bytes

PATH_DIMS, WORD_DIMS, MEASURES = 96, 64, 5
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
SAMPLE_PAGES, VARIANTS, HIDDEN, STEPS = 300, 3, 16, 160
#: Pages read at once, and their blocks with padding; a page of more blocks is read alone, in one sequence.
TOGETHER, BLOCKS_TOGETHER = 64, 1 << 15

# Names that mark main text and what surrounds it, in tags, classes and ids.
MAIN = frozenset("article main content post story entry body text".split())
AROUND = frozenset(
    "nav header footer aside form menu sidebar ad ads advert banner cookie notice comments comment promo related share "
    "breadcrumb navigation button subscribe newsletter consent widget toolbar".split()
)
LAYOUTS = (("article",), ("main",), ("main", "article"), ("div content",), ("div post content",), ("div main", "div story"), ("section entry",), ("main", "div article body"))
FRAMES = (
    ("nav", "ul", "li"), ("header",), ("header", "nav", "ul", "li"), ("footer",), ("footer", "p"), ("aside",), ("aside sidebar", "p"),
    ("div sidebar", "ul", "li"), ("div ad",), ("div advert",), ("div ads banner", "p"), ("div cookie notice",), ("div cookie banner", "p"),
    ("div notice",), ("form",), ("form", "p"), ("form newsletter", "div"), ("section comments", "p"), ("div comments", "div comment", "p"),
    ("ul menu", "li"), ("div menu",), ("div related", "ul", "li"), ("div share",), ("div breadcrumb",), ("button",),
)


def features(page: list[Leaf]) -> np.ndarray:
    """blocks x DIMS."""
    out = np.zeros((len(page), DIMS), np.float32)
    for i, leaf in enumerate(page):
        steps = [s for s in leaf.path if s not in ("html", "body")]
        names = [w for s in steps for w in s.split(" ")]
        for mark in [*names, *(f"{a}>{b}" for a, b in zip(steps, steps[1:]))]:
            h = zlib.crc32(mark.encode())
            out[i, h % PATH_DIMS] += 1 if h >> 31 else -1
        words = leaf.text.lower().split()
        hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        sums = np.bincount(hashed % WORD_DIMS, np.where(hashed >> 31, 1.0, -1.0), WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0.3 * sums / max(1.0, np.sqrt(np.square(sums).sum()))
        out[i, -MEASURES:] = (
            np.log1p(len(words)) / 5,
            leaf.link_chars / max(1, len(leaf.text)),
            i / max(1, len(page) - 1),
            leaf.text[-1] in ".!?…",
            len(steps) / 8,
        )
    return out


def own_label(leaf: Leaf) -> bool:
    """Whether the markup around a block says that it is main text; the innermost mark counts."""
    for step in reversed(leaf.path):
        words = set(step.split(" "))
        if words & AROUND:
            return False
        if words & MAIN - {"body"} or "article" in words:
            return True
    return False


def variant(page: list[Leaf], labels: list[bool], rng: np.random.Generator) -> tuple[list[Leaf], list[bool]]:
    """The page's blocks in another layout: main text in one of ``LAYOUTS``, with blocks of other texts around it."""
    main = [leaf for leaf, own in zip(page, labels) if own]
    rest = [leaf for leaf, own in zip(page, labels) if not own] or page
    layout = LAYOUTS[rng.integers(len(LAYOUTS))]

    def frames(most: int) -> list[Leaf]:
        out = []
        for _ in range(rng.integers(0, most + 1)):
            path = FRAMES[rng.integers(len(FRAMES))]
            for _ in range(rng.integers(1, 5)):
                # Comments and notices read like main text, menus do not.
                source = main if main and rng.random() < 0.4 else rest
                text = source[rng.integers(len(source))].text
                linked = len(text) if "li" in path and rng.random() < 0.8 else 0
                out.append(Leaf(("html", "body", *path), text, linked))
        return out

    before, inside, after = frames(4), frames(1), frames(5)
    body = [Leaf(("html", "body", *layout, leaf.path[-1] if leaf.path and leaf.path[-1].split(" ")[0] in ("p", "h1", "h2", "li") else "p"), leaf.text, leaf.link_chars) for leaf in main]
    cut = int(rng.integers(0, len(body) + 1))
    inside = [Leaf(("html", "body", *layout, *leaf.path[2:]), leaf.text, leaf.link_chars) for leaf in inside]
    blocks = before + body[:cut] + inside + body[cut:] + after
    return blocks, [False] * len(before) + [True] * cut + [False] * len(inside) + [True] * (len(body) - cut) + [False] * len(after)


class Labeller:
    """The trained network: probability of main text for each block of each page."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.net = BiLstm(DIMS, HIDDEN, rng)
        self.out = (rng.normal(size=2 * HIDDEN) * 0.1).astype(np.float32)
        self.skip = np.zeros(DIMS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def _logits(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        hidden = self.net.forward(x, lengths, keep)
        return hidden @ self.out + x @ self.skip + self.bias, hidden

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 6) -> None:
        rng, adam = np.random.default_rng(seed), Adam(0.01)
        for _ in range(steps if pages else 0):
            picks = [pages[i] for i in rng.integers(len(pages), size=min(32, len(pages)))]
            # Fewer pages where they are long, none of them cut.
            longest = np.maximum.accumulate([len(f) for f, _ in picks])
            fit = int((longest * np.arange(1, len(picks) + 1) <= BLOCKS_TOGETHER // 2).sum())
            picks = picks[: max(1, fit)]
            x, lengths = padded([f for f, _ in picks])
            target = padded([y[:, None] for _, y in picks])[0][:, :, 0]
            logits, hidden = self._logits(x, lengths, keep=True)
            inside = np.arange(x.shape[1])[None, :] < lengths[:, None]
            wrong = ((sigmoid(logits) - target) * inside / inside.sum()).astype(np.float32)
            grads = self.net.backward(wrong[:, :, None] * self.out)
            adam.step(
                [*self.net.parameters(), self.out, self.skip, self.bias],
                [*grads, np.einsum("bt,bth->h", wrong, hidden), np.einsum("bt,btd->d", wrong, x), wrong.sum(keepdims=True)[0]],
            )

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Every block of every page, each page in one sequence whatever its length."""
        out = [np.zeros(len(f)) for f in pages]
        order = sorted((k for k, f in enumerate(pages) if len(f)), key=lambda k: len(pages[k]))
        while order:
            own = order[:TOGETHER]
            while len(own) > 1 and len(own) * len(pages[own[-1]]) > BLOCKS_TOGETHER:
                own.pop()
            order = order[len(own) :]
            x, lengths = padded([pages[k] for k in own])
            for row, k in zip(sigmoid(self._logits(x, lengths)[0]), own):
                out[k] = row[: len(pages[k])]
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), max(1, lengths.max(initial=1)), sequences[0].shape[1]), np.float32)
    for row, s in zip(x, sequences):
        row[: len(s)] = s
    return x, lengths


def fit(htmls: list[str], variants: int = VARIANTS, seed: int = 4) -> Labeller:
    """A labeller trained on these pages and ``variants`` layouts of each."""
    rng, data = np.random.default_rng(seed), []
    for text in htmls:
        page = leaves(text)
        labels = [own_label(leaf) for leaf in page]
        if page:
            data.append((features(page), np.array(labels, np.float32)))
            for _ in range(variants):
                blocks, own = variant(page, labels, rng)
                if blocks:
                    data.append((features(blocks), np.array(own, np.float32)))
    labeller = Labeller()
    labeller.train(data)
    return labeller


def training_pages(pages: DataFrame, rows: int = SAMPLE_PAGES, html_col: str = "html") -> list[str]:
    """At most ``rows`` pages, those with the smallest hashes of their ids."""
    ids = pages.where(F.col(html_col).isNotNull()).select("page_id", F.xxhash64("page_id").alias("h"))
    edge = ids.orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return []
    kept = pages.where(F.xxhash64("page_id") <= edge).where(F.col(html_col).isNotNull()).orderBy(F.xxhash64("page_id"), html_col).limit(rows)
    return [r[0] for r in kept.select(html_col).collect()]


def extract(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row; a NULL or empty page gives an empty text.

    Main blocks are joined in page order by a line feed; none is dropped for its length or number. Repeated rows give the
    same result each. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["html"].tolist()
            for lo, hi in by_bytes(texts, 4 << 20):
                read = [leaves(t) for t in texts[lo:hi]]
                kept = [
                    [leaf.text for leaf, p in zip(page, own) if p >= 0.5]
                    for page, own in zip(read, labeller.probabilities([features(page) for page in read]))
                ]
                joined = ["\n".join(k) for k in kept]
                yield batch.iloc[lo:hi][["page_id", "url"]].assign(
                    text=joined, n_chars=[len(t) for t in joined], n_blocks=[len(p) for p in read], n_main=[len(k) for k in kept]
                )

    source = pages.select("page_id", "url", F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return source.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
