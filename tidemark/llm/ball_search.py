"""Ranked lexical search: exact inner-product search in ball trees of sparse document vectors.

A query item is a sparse vector of its terms' weights, a document one of its terms' shares, so a score is an inner product of
non-negative integers. Documents are read twice. The first pass tokenizes whole texts and keeps a document's length and its
occurrences of the terms that some item has; the counts of the corpus (documents, terms, documents of a term) come from these.
In the second pass a task builds ball trees over the vectors it reads, ``TREE_ROWS`` documents or ``TREE_TERMS`` entries at a
time: a node holds a centroid c and a radius r, and a query q scores at most q.c + |q| r in it. Nodes are opened best first; a
node whose bound is below the item's 20th score so far goes with all its documents. Leaves are scored exactly in 64-bit
integers. The scores found in one tree are the item's threshold in the task's next one.

Vectors are scaled by the square roots of the terms' weights on both sides, which leaves products as they are and makes balls
tighter. Safe rounding: centroids are stored as they are used, radii are measured from the stored ones, and squared distances,
norms and bounds are raised by more than the rounding errors of their sums, so a bound is never below a score it covers.

Items are worked off in blocks of ``ITEMS`` rows, whose terms and vectors each task gets; documents are never gathered: a
task returns at most 20 rows an item, and the best of all are ranked in two steps, within parts of the tasks first.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

TOP = 20
#: Items of one pass over the documents, and characters of their texts; a longer item stands alone.
ITEMS, ITEM_CHARS = 4096, 8 << 20
TREE_ROWS, TREE_TERMS, LEAF = 8192, 4 << 20, 64
SALTS = 64
#: Relative room for rounding: some thousands of terms, each off by 2**-52 at most, with a wide margin.
SAFE = 1e-9
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters from U+0080 on, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def document_terms(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the whole text), and term and tf of those of the vocabulary, in ascending order of term."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = terms(text) if isinstance(text, str) else []
                held = np.fromiter((number[t] for t in found if t in number), np.int32)
                term, tf = np.unique(held, return_counts=True)
                out.append((len(found), term, tf.astype(np.int64)))
            frame = pd.DataFrame(out, columns=["n", "term", "tf"])
            yield frame.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(object, na_value=None))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "n long, term array<int>, tf array<long>, doc_id long")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Rows:
    """Sparse rows: entries of row i are those from begin[i] to begin[i + 1]."""

    doc: np.ndarray
    begin: np.ndarray
    term: np.ndarray
    value: np.ndarray  # exact shares
    scaled: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        count = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(count)
        at = np.repeat(self.begin[rows] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return Rows(self.doc[rows], np.append(0, ends), self.term[at], self.value[at], self.scaled[at])


@dataclass
class Node:
    centroid: np.ndarray
    radius: float
    lo: int
    hi: int
    left: Node | None = None
    right: Node | None = None


class BallTree:
    """Balls over rows; the rows are put in the order of the leaves."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF) -> None:
        self.width, self.leaf = width, leaf
        self.order = np.arange(len(rows.doc))
        self.squares = _row_sums(rows.scaled * rows.scaled, rows.begin)
        self.root = self._build(rows, 0, len(rows.doc))
        self.rows = rows.take(self.order)

    def _build(self, rows: Rows, lo: int, hi: int) -> Node:
        own = self.order[lo:hi]
        part = rows.take(own)
        squares = self.squares[own]
        centroid = np.bincount(part.term, part.scaled, self.width) / (hi - lo)
        node = Node(centroid, 0.0, lo, hi)
        distance = self._distances(part, squares, centroid)
        node.radius = math.sqrt(float(distance.max())) * (1 + SAFE)
        if hi - lo > self.leaf and not self._alike(part):
            # Two far apart rows as poles: the farthest from the centroid, and the farthest from that.
            near_a = self._distances(part, squares, _dense(part, int(distance.argmax()), self.width))
            near_b = self._distances(part, squares, _dense(part, int(near_a.argmax()), self.width))
            side = near_a - near_b
            by = np.argsort(side, kind="stable")
            middle = int(np.clip(np.searchsorted(side[by], 0.0), (hi - lo) // 8, hi - lo - (hi - lo) // 8))
            self.order[lo:hi] = own[by]
            node.left, node.right = self._build(rows, lo, lo + middle), self._build(rows, lo + middle, hi)
        return node

    def _distances(self, part: Rows, squares: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances to a point, at least the true ones."""
        square = float(point @ point)
        return np.maximum(squares - 2 * _row_sums(part.scaled * point[part.term], part.begin) + square, 0.0) + SAFE * (squares + square)

    @staticmethod
    def _alike(part: Rows) -> bool:
        """Whether all rows are equal, so that no ball is smaller than this one."""
        counts = np.diff(part.begin)
        if (counts != counts[0]).any():
            return False
        shape = (len(counts), int(counts[0]))
        term, value = part.term.reshape(shape), part.value.reshape(shape)
        return bool((term == term[0]).all() and (value == value[0]).all())

    def search(self, query: Query, best: Best) -> int:
        """Adds the rows that belong to ``best``; returns how many leaves were scored."""
        scored, turn = 0, 0
        heap = [(-self._bound(self.root, query), turn, self.root)]
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < best.least:
                break
            if node.left is None:
                self._score(node, query, best)
                scored += 1
                continue
            for child in (node.left, node.right):
                own = self._bound(child, query)
                if own >= best.least:
                    turn += 1
                    heapq.heappush(heap, (-own, turn, child))
        return scored

    def _bound(self, node: Node, query: Query) -> float:
        return (float(query.scaled @ node.centroid[query.term]) + query.norm * node.radius) * (1 + SAFE)

    def _score(self, node: Node, query: Query, best: Best) -> None:
        at, to = self.rows.begin[node.lo], self.rows.begin[node.hi]
        query.dense[query.term] = query.value
        scores = np.append(0, np.cumsum(self.rows.value[at:to] * query.dense[self.rows.term[at:to]]))
        query.dense[query.term] = 0
        begin = self.rows.begin[node.lo : node.hi + 1] - at
        best.add(self.rows.doc[node.lo : node.hi], scores[begin[1:]] - scores[begin[:-1]])


def _row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each row, added up row by row, so that a row's rounding error is its own."""
    out = np.zeros(len(begin) - 1)
    full = begin[1:] > begin[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, begin[:-1][full])
    return out


def _dense(part: Rows, row: int, width: int) -> np.ndarray:
    out = np.zeros(width)
    own = slice(part.begin[row], part.begin[row + 1])
    out[part.term[own]] = part.scaled[own]
    return out


@dataclass
class Query:
    """An item's terms, their exact weights with repeats, the same scaled, and the norm of these, rounded up."""

    term: np.ndarray
    value: np.ndarray
    scaled: np.ndarray
    norm: float
    dense: np.ndarray  # zeros, as wide as the vocabulary; all queries of a task use the same


class Best:
    """The highest scores above 0 so far, equal ones by ascending id; a NULL id comes last."""

    def __init__(self, top: int = TOP) -> None:
        self.top = top
        self.doc, self.score = np.zeros(0, object), np.zeros(0, np.int64)
        self.least = 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        doc, score = np.concatenate([self.doc, doc[good]]), np.concatenate([self.score, score[good]])
        key = np.array([np.iinfo(np.int64).max if d is None else d for d in doc], np.int64)
        order = np.lexsort([[d is None for d in doc], key, -score])[: self.top]
        self.doc, self.score = doc[order], score[order]
        if len(order) == self.top:
            self.least = max(1, int(self.score[-1]))


def queries_of(items: list[list[bytes]], vocabulary: list[bytes], weights: np.ndarray) -> list[Query]:
    number = {t: i for i, t in enumerate(vocabulary)}
    dense, root = np.zeros(len(vocabulary), np.int64), np.sqrt(weights.astype(np.float64))
    out = []
    for own in items:
        counts = Counter(number[t] for t in own)
        term = np.array(sorted(counts), np.int64)
        count = np.array([counts[t] for t in term.tolist()], np.int64)
        scaled = count * root[term]
        out.append(Query(term, count * weights[term], scaled, math.sqrt(float(scaled @ scaled)) * (1 + SAFE), dense))
    return out


def shares(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score, in 64-bit integers."""
    m = 75 + (25 * n * documents) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def search_rows(rows: Iterator[Rows], items: list[Query], width: int, top: int = TOP) -> list[Best]:
    """The best rows of each item over trees that are built one after the other."""
    best = [Best(top) for _ in items]
    for part in rows:
        tree = BallTree(part, width)
        for query, own in zip(items, best):
            if len(query.term):
                tree.search(query, own)
    return best


def _search_block(docs: DataFrame, block: list[tuple[int, int | None, list[bytes]]], top: int, id_col: str, text_col: str) -> DataFrame:
    """Ranked documents of some items (place, item_id, terms)."""
    vocabulary = sorted({t for _, _, own in block for t in own})
    counted = stage(document_terms(docs, vocabulary, id_col, text_col), "terms")
    documents, total = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row a term of the items of this block.
    held = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    holding = {r["term"]: r["df"] for r in held}
    weights = np.array([weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    asked, root = [own for _, _, own in block], np.sqrt(weights.astype(np.float64))
    places, names = [p for p, _, _ in block], [i for _, i, _ in block]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def trees() -> Iterator[Rows]:
            doc, lengths, term, tf, size = [], [], [], [], 0
            for batch in batches:
                for d, n, t, f in zip(batch["doc_id"], batch["n"], batch["term"], batch["tf"]):
                    doc.append(None if pd.isna(d) else int(d))
                    lengths.append(n)
                    term.append(t)
                    tf.append(f)
                    size += len(t)
                    if len(doc) == TREE_ROWS or size >= TREE_TERMS:
                        yield rows(doc, lengths, term, tf)
                        doc, lengths, term, tf, size = [], [], [], [], 0
            if doc:
                yield rows(doc, lengths, term, tf)

        def rows(doc: list, lengths: list, term: list, tf: list) -> Rows:
            count = np.array([len(t) for t in term], np.int64)
            flat, times = np.concatenate(term).astype(np.int64), np.concatenate(tf).astype(np.int64)
            value = shares(times, np.repeat(np.array(lengths, np.int64), count), documents, total)
            ids = np.empty(len(doc), object)
            ids[:] = doc
            return Rows(ids, np.append(0, np.cumsum(count)), flat, value, value * root[flat])

        found = search_rows(trees(), queries_of(asked, vocabulary, weights), len(vocabulary), top)
        for place, name, own in zip(places, names, found):
            if len(own.doc):
                frame = pd.DataFrame({"place": place, "item_id": name, "doc_id": own.doc, "score": own.score})
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    # A document that holds none of the terms scores 0 for every item.
    some = counted.where(F.size("term") > 0)
    found = some.mapInPandas(run, "place long, item_id long, doc_id long, score long")
    first = "row_number() over (partition by place, part order by score desc, doc_id asc nulls last)"
    last = "row_number() over (partition by place order by score desc, doc_id asc nulls last)"
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = parts.withColumn("rank", F.expr(first)).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.expr(last)).where(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, int | None, list[bytes]]]]:
    """(place, item_id, terms) of all items that have a term, in blocks of bounded size; rows are numbered by id and text."""
    ordered = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    block, size = [], 0
    for place, r in enumerate(ordered.orderBy("item_id", "text").toLocalIterator()):
        own = terms(r["text"])
        if block and (len(block) == ITEMS or size + len(r["text"]) > ITEM_CHARS):
            yield block
            block, size = [], 0
        if own:
            block.append((place, r["item_id"], own))
            size += len(r["text"])
    if block:
        yield block


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with the highest scores above 0.

    Equal scores go by ascending id, a NULL id last. Every row of ``items`` is ranked for itself, also one that repeats an
    id; one whose text is NULL or has no term finds nothing. Rows of documents count and are found each, also repeated ones;
    a NULL text has no terms. Other columns are ignored, whatever their names; empty tables give no rows.
    """
    out = None
    for block in item_blocks(items, item_col, query_col):
        own = _search_block(docs, block, top, id_col, text_col)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
