"""Alignment of two tokenizations of the same bytes by lockstep merging, and corpus-wide counts of the linked ids.

All documents of a batch move on together: one NumPy vector holds the place of each in its tokens of A, one its place in
those of B. A step emits a link for every place (the two tokens overlap), a cut where both end at the same byte, and moves
on the token that ends first, or both; finished documents leave the vectors. A long document stands as several lanes, cut
where a few probed tokens of A end with one of B, so the number of steps does not grow with the longest text.

Counts of id pairs are needed by every document that holds the pair. Documents are therefore dealt to blocks of at most
``BLOCK`` bytes where they are read; a block has one entry for each of its pairs and its documents refer to these entries.
Pairs are counted over entries, the counts are joined back to entries, and blocks meet their documents again: what is
shuffled per pair is one row a block, however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage, worker_store
from tidemark.llm.shingles import by_bytes

LANE, PROBES = 256, 32
BLOCK, BLOCK_ROWS = 4 << 20, 20_000
#: Bits of an id of B in a packed pair.
SHIFT = 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ENTRY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, is_doc boolean, links binary, pairs array<long>, counts array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: The pattern's look-ahead fails on very long white space in one of the two encoders; those texts take the other.
_LONG_SPACE = re.compile(r"\s{500}").search


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Encoders:
    """Ids of texts by tokenizer A (byte-level) and B (pieces), and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            described = json.load(file)
        # The byte alphabet of byte-level BPE, printable bytes as themselves, others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"] for t in described["added_tokens"]}
        vocabulary = described["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in vocabulary.items() if entry not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in ranks.items():
            self.bytes_a[i] = entry
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(b) for b in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Decimal ids with the sign that follows them inside a group, and at the end of the part of A or of B.
        self.text_a = np.array([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"], object)
        self.text_b = np.array([f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"], object)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both; none if its bytes are not those of a space and the text."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            spaced = " " + text
            if not text:
                out.append(([], []))
                continue
            if _LONG_SPACE(spaced):
                a = self.whole.encode(spaced, add_special_tokens=False).ids
            else:
                a = self.fast.encode_ordinary(spaced)
            want = spaced.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            out.append((a, b) if same else ([], []))
        return out


def encoders(path_a: str, path_b: str) -> Encoders:
    """The encoders of this Python process, made once."""
    store = worker_store("encoders")
    if (path_a, path_b) not in store:
        store[path_a, path_b] = Encoders(path_a, path_b)
    return store[path_a, path_b]


def lanes(a_end: np.ndarray, b_end: np.ndarray, begin: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token of A, first of B and one past the last of A of each lane.

    ``a_end`` and ``b_end`` are the last bytes of the tokens of all documents, one after the other; ``begin`` holds the first
    token of A of each document. After every ``lane`` tokens the next few ends of A are looked for among those of B.
    """
    near = np.arange(lane, len(a_end), lane)[:, None] + np.arange(min(PROBES, lane))
    near = np.minimum(near, len(a_end) - 1)
    place = np.minimum(np.searchsorted(b_end, a_end[near]), len(b_end) - 1)
    met = b_end[place] == a_end[near]
    some = np.flatnonzero(met.any(axis=1))
    first = np.unique(np.concatenate([begin, near[some, met[some].argmax(axis=1)] + 1]))
    first = first[first < len(a_end)]
    before = np.concatenate([[0], a_end])[first]
    return first, np.searchsorted(b_end, before, "right"), np.append(first[1:], len(a_end))


def lockstep(
    a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of A, token of B) and cuts (last tokens of a group) of all lanes, sorted by the token of A."""
    links: list[tuple[np.ndarray, np.ndarray]] = [(a[:0], b[:0])]
    cuts = [(a[:0], b[:0])]
    while len(a):
        links.append((a, b))
        ends_a, ends_b = a_end[a], b_end[b]
        both = ends_a == ends_b
        cuts.append((a[both], b[both]))
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        alive = a < stop
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    link_a, link_b = (np.concatenate(x) for x in zip(*links))
    cut_a, cut_b = (np.sort(np.concatenate(x)) for x in zip(*cuts))
    order = np.argsort(link_a, kind="stable")
    return link_a[order], link_b[order], cut_a, cut_b


def align(coded: list[tuple[list[int], list[int]]], use: Encoders, lane: int = LANE) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of each document, and its links as packed id pairs."""
    n_a, n_b = (np.array([len(c[i]) for c in coded], np.int64) for i in (0, 1))
    ids_a, ids_b = (np.array([t for c in coded for t in c[i]], np.int64) for i in (0, 1))
    a_end, b_end = np.cumsum(use.size_a[ids_a]), np.cumsum(use.size_b[ids_b])
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    if not len(ids_a):
        none = np.zeros(len(coded), np.int64)
        return pd.DataFrame({**dict.fromkeys(COUNTS, none), "groups_sha256": ""}), [ids_a] * len(coded)
    start = np.unique((ends_a - n_a)[n_a > 0])
    link_a, link_b, cut_a, cut_b = lockstep(a_end, b_end, *lanes(a_end, b_end, start, lane))
    link_ends, cut_ends = np.searchsorted(link_a, ends_a), np.searchsorted(cut_a, ends_a)
    # The tokens of a group stand together: those of A behind the groups before, those of B behind these.
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a], last_b[cut_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    parts = np.empty(len(ids_a) + len(ids_b), object)
    parts[np.arange(len(ids_a)) + np.append(0, cut_b + 1)[group_a]] = use.text_a[2 * ids_a + last_a]
    parts[np.arange(len(ids_b)) + cut_a[group_b] + 1] = use.text_b[2 * ids_b + last_b]
    ends = (ends_a + ends_b).tolist()
    joined = ["".join(parts[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends], ends)]
    frame = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(cut_ends, prepend=0), "n_links": np.diff(link_ends, prepend=0)}
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in joined]
    pairs = np.split(ids_a[link_a] << SHIFT | ids_b[link_b], link_ends[:-1])
    return pd.DataFrame({**frame, "groups_sha256": digests}), pairs


def entries(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of documents, whose ``links`` are places in their block's pairs, and one row of pairs and counts a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use, block = encoders(*paths), TaskContext.get().partitionId() << 32
        held: list[tuple[pd.Series, pd.DataFrame, list[np.ndarray]]] = []
        size = rows = 0
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for lo, hi in by_bytes(texts, 1 << 20):
                frame, pairs = align(use(texts[lo:hi]), use)
                held.append((batch["doc_id"].iloc[lo:hi], frame, pairs))
                size, rows = size + sum(map(len, texts[lo:hi])), rows + hi - lo
                if size >= BLOCK or rows >= BLOCK_ROWS:
                    yield from flush(held, block)
                    block, held, size, rows = block + 1, [], 0, 0
        if held:
            yield from flush(held, block)

    def flush(held: list, block: int) -> Iterator[pd.DataFrame]:
        pairs = [p for _, _, own in held for p in own]
        every, place, count = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p) for p in pairs])[:-1]
        out = pd.concat([f for _, f, _ in held], ignore_index=True)
        # Sorted places, each as the distance from the one before, take little room.
        own = [np.diff(np.sort(p), prepend=0).astype("<i4").tobytes() for p in np.split(place, ends)]
        out = out.assign(doc_id=pd.concat([i for i, _, _ in held], ignore_index=True).astype("Int64"), block=block, is_doc=True, links=own, pairs=None, counts=None)
        yield out
        empty = dict.fromkeys(["doc_id", *COUNTS, "groups_sha256", "links"])
        yield pd.DataFrame([{**empty, "block": block, "is_doc": False, "pairs": every, "counts": count}])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInPandas(run, _ENTRY)


def pair_totals(pairs: DataFrame) -> DataFrame:
    """pair, total and whether the total is the highest of the pair's B id. An id of B has at most A's vocabulary of pairs."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    highest = F.expr(f"max(total) over (partition by pair & {(1 << SHIFT) - 1})")
    return totals.select("pair", "total", (F.col("total") == highest).alias("best"))


def _counted(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block with n_best and count_sum."""
    total, best = (np.zeros(len(pairs) + 1, np.int64) for _ in range(2))
    total[pairs["place"].to_numpy()], best[pairs["place"].to_numpy()] = pairs["total"], pairs["best"]
    places = [np.cumsum(np.frombuffer(b, "<i4")) for b in docs["links"]]
    out = docs.drop(columns=["links", "block"])
    out["n_best"] = [int(best[p].sum()) for p in places]
    out["count_sum"] = [int(total[p].sum()) for p in places]
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def aligned_tokens(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A text that is NULL or empty, or that one of the tokenizers does not keep byte by byte, has no tokens: zeros and ''.
    Repeated rows and rows with a NULL id count each. Only doc_id and text are read, whatever the other columns are; an
    empty table gives no rows. Links with equally high counts of their B id are all best.
    """
    written = stage(entries(docs, paths or default_paths()), "alignments")
    blocks = written.where("not is_doc")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "own"))
    pairs = listed.select("block", "place", F.col("own.pairs").alias("pair"), F.col("own.counts").alias("n"))
    totals = stage(pair_totals(pairs), "pair-counts")
    # Tasks by blocks, not by bytes: a block's work is in its links.
    parts = max(1, min(blocks.count(), 20_000))
    found = pairs.join(totals, "pair").select(F.col("block").alias("of_block"), "place", "total", "best").repartition(parts, "of_block")
    texts = written.where("is_doc").select("doc_id", *COUNTS, "groups_sha256", "block", "links").repartition(parts, "block")
    return texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInPandas(_counted, _RESULT)
