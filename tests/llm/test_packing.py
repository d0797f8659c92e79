import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, tokens


def check_plan(counts, capacity):
    runs, sequences = packing.plan(counts, capacity)
    content, seen = defaultdict(list), defaultdict(list)
    for length, rank, count, sequence, offset, per in runs:
        for r in range(count):
            content[sequence + r // per].append((offset + r % per * length, length))
            seen[length].append(rank + r)
    assert {n: sorted(s) for n, s in seen.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for own in content.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(content) == list(range(sequences))
    return sequences


def fewest(items, capacity):
    """Exact minimum by filling the sequence of the first item in every way."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for own in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in own) <= capacity:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if i not in own), capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=25))
def test_plan_is_whole_and_gapless(counts):
    n = check_plan(counts, 60)
    assert n >= -(-sum(a * b for a, b in counts.items()) // 60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_reduction_keeps_the_optimum(items):
    counts = {n: items.count(n) for n in items}
    instance = packing.Instance(20, dict(counts))
    instance.reduce()
    left = tuple(sorted((n for n, c in instance.left.items() for _ in range(c)), reverse=True))
    assert instance.sequences + fewest(left, 20) == fewest(tuple(sorted(items, reverse=True)), 20)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer(documents):
    texts = [r.text for r in documents.limit(60).collect()]
    texts += ["", "it's We'LL x's'S 1²3 ½", "İstanbul ΣΑΣ Σ", "a\x1cb \x85c\xa0d　e", "x<|endoftext|>y <|startoftext|>",
              "é ́a 漢字かな 😀😀 ﬁ", "naïve—café… “q”", "\x00\x01 ﻿z"]
    small = tokens.WordTokenizer(tokens.default_path(), chunks=50, pieces=20)
    assert [list(x) for x in small.ids(texts)] == whole_ids(texts)
    assert [list(x) for x in tokens.WordTokenizer(tokens.default_path()).ids(texts)] == whole_ids(texts)


def check_rows(rows, got, capacity):
    ids = {i: x + [1] for i, x in zip([r[0] for r in rows], whole_ids([r[1] or "" for r in rows]))}
    want = sorted((i, k // capacity, k, len(x[k : k + capacity]), zlib.crc32(np.array(x[k : k + capacity], "<u4").tobytes()))
                  for i, x in ids.items() for k in range(0, len(x), capacity))
    assert sorted(tuple(r)[:5] for r in got) == want
    content = defaultdict(list)
    for r in got:
        content[r.sequence_id].append((r.offset, r.length))
    for own in content.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(content), sum(map(len, ids.values()))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(documents, capacity):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sequences, total = check_rows(rows, packing.pack(documents, capacity=capacity).collect(), capacity)
    assert sequences <= 1.02 * total / capacity + 1


def test_odd_rows(odd_documents, no_documents):
    got = packing.pack(odd_documents).collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and {r.doc_id: r.length for r in got}[3] == 1
    assert {r.doc_id for r in got} == {None, *range(1, 11)}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(no_documents).collect() == []
