import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ball_search as bs

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in _TERM.findall(text or "")]


def brute_force(docs, items, top=20):
    """Every document scored for every item."""
    held = [(d, plain_terms(t)) for d, t in docs]
    count, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, own in held for t in set(own))
    out = []
    for item, text in items:
        asked = plain_terms(text)
        scores = []
        for doc, own in held:
            tf, m = Counter(own), 100 - 25 + (25 * len(own) * count) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                        for t in asked if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def result(docs, items, **options):
    return sorted((tuple(r) for r in bs.ranked_search(docs, items, **options).collect()), key=str)


def pairs(df, name):
    return [(r[name], r["text"]) for r in df.collect()]


def test_tables_equal_brute_force(documents, tables):
    items = tables("benchmark")
    assert result(documents, items) == brute_force(pairs(documents, "doc_id"), pairs(items, "item_id"))


def test_small_trees_and_blocks(documents, tables, monkeypatch):
    items = tables("benchmark").limit(7)
    want = brute_force(pairs(documents, "doc_id"), pairs(items, "item_id"), 5)
    monkeypatch.setattr(bs, "ITEMS", 3)
    # Workers read these from the pickled module.
    monkeypatch.setattr(bs, "TREE_ROWS", 40)
    assert result(documents.repartition(5), items, top=5) == want


def test_hard_rows(spark):
    docs = [(1, "Alpha beta, BETA"), (2, "alpha beta beta"), (2, "alpha beta beta"), (3, None), (4, ""), (None, "alpha beta beta"), (5, "..."),
            (6, "é É ñandú ½ 漢字 x1y"), (7, "ÀB İx ÀB"), (8, "gamma " * 5000 + "alpha"), (9, "a_b a-b\x7fc\x80d")]
    items = [(1, "alpha ALPHA beta"), (1, "é É"), (2, None), (3, "--"), (4, "nothing here"), (None, "gamma 漢字"), (5, "Àb À b\x80 c\x80d"), (1, "alpha ALPHA beta")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for top in (20, 2):
        assert result(a, b, top=top) == brute_force(docs, items, top)


def vectors(rows, width):
    term = [np.array(sorted(r), np.int64) for r in rows]
    value = np.array([r[t] for r in rows for t in sorted(r)], np.int64)
    ids = np.empty(len(rows), object)
    ids[:] = list(range(len(rows)))
    flat = np.concatenate([*term, np.zeros(0, np.int64)])
    weights = np.arange(1, width + 1)
    return bs.Rows(ids, np.append(0, np.cumsum([len(t) for t in term])), flat, value, value * np.sqrt(weights)[flat]), weights


ROW = st.dictionaries(st.integers(0, 11), st.integers(1, 10**6), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 11), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 8), st.integers(1, 5))
def test_tree_equals_scan(rows, asked, top, leaf):
    held, weights = vectors(rows, 12)
    vocabulary = [bytes([i]) for i in range(12)]
    tree = bs.BallTree(held, 12, leaf)
    for own, query in zip(asked, bs.queries_of([[bytes([i]) for i in q] for q in asked], vocabulary, weights)):
        best = bs.Best(top)
        tree.search(query, best)
        scores = [sum(int(weights[t]) * r.get(t, 0) for t in own) for r in rows]
        want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:top]
        assert list(zip((-best.score).tolist(), best.doc.tolist())) == want


def test_bounds_cover_every_row():
    rng = np.random.default_rng(3)
    rows = [{int(t): int(rng.integers(1, 10**6)) for t in rng.choice(300, 30, False)} for _ in range(600)]
    held, weights = vectors(rows, 300)
    tree = bs.BallTree(held, 300, 8)
    query = bs.queries_of([[bytes([t % 256, t // 256]) for t in rng.choice(300, 20)]], [bytes([t % 256, t // 256]) for t in range(300)], weights)[0]
    exact = [sum(int(query.value[list(query.term).index(t)]) * v for t, v in r.items() if t in query.term) for r in rows]

    def walk(node):
        own = [exact[d] for d in tree.rows.doc[node.lo : node.hi]]
        assert tree._bound(node, query) >= max(own)
        for child in (node.left, node.right):
            if child:
                walk(child)

    walk(tree.root)


def test_copies_and_far_groups_are_pruned():
    groups = [{t: 900_000 for t in range(10 * g, 10 * g + 10)} for g in range(20)]
    rows = [{**groups[g], 200 + i: 1000} for g in range(20) for i in range(50)] + [dict(groups[3])] * 5000
    held, weights = vectors(rows, 260)
    tree = bs.BallTree(held, 260)
    vocabulary = [bytes([t % 256, t // 256]) for t in range(260)]
    query = bs.queries_of([[vocabulary[t] for t in range(50, 60)]], vocabulary, weights)[0]
    best = bs.Best()
    leaves = tree.search(query, best)
    assert len(best.doc) == 20 and leaves < 30


@pytest.mark.parametrize("which", ["docs", "items"])
def test_odd_rows(spark, odd_documents, no_documents, which):
    items = spark.createDataFrame([(1, "quick brown one"), (2, None), (2, "")], "item_id long, text string").selectExpr("*", "1 as place", "'x' as score")
    if which == "docs":
        rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
        assert result(odd_documents, items) == brute_force(rows, pairs(items, "item_id"))
        assert result(no_documents, items) == []
    else:
        assert result(odd_documents, items.where("false")) == []
