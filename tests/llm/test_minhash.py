import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import minhash, shingles
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    edges = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j > i)
        edges += [(i, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, edges).items()}


def test_equals_brute_force(documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents).collect()}
    assert got == brute_force([(r.doc_id, r.text) for r in documents.collect()])


def test_groups_of_near_copies(spark):
    """Chains of edits: many keys, links only between neighbours, and a text that many share in part."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    common = list(rng.choice(words, 60))
    rows = []
    for g in range(6):
        text = list(rng.choice(words, 80))
        for _ in range(40):
            rows.append((len(rows), " ".join(text)))
            for _ in range(2):
                text[rng.integers(len(text))] = rng.choice(words)
    rows += [(len(rows) + i, " ".join(common + list(rng.choice(words, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_odd_rows(odd_documents, no_documents):
    got = sorted(map(tuple, minhash.near_duplicates(odd_documents).collect()), key=str)
    by_id = {g[0]: g[1:] for g in got}
    assert len(got) == 12 and [g for g in got if g[0] == 1] == [(1, 6, 1, True)] * 2
    assert by_id[2] == (6, 1, False)
    assert by_id[3] == (0, 3, True) and by_id[4] == (0, 4, True) and by_id[5] == (0, 5, True)
    assert by_id[6] == (1, 6, True) and by_id[7] == (1, 6, False)
    assert by_id[8][1] == 8 and by_id[9][1] == 8
    assert by_id[None] == (6, None, True)
    assert minhash.near_duplicates(no_documents).collect() == []


def test_an_id_with_two_texts_links_by_both(spark):
    rng = np.random.default_rng(8)
    a, b = (" ".join(rng.choice([f"w{i}" for i in range(900)], 100)) for _ in range(2))
    for order in (1, -1):
        rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (1, "")][::order]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
        assert got == {(1, 1), (2, 1), (3, 1)}


def test_many_copies_in_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LED", 5)
    monkeypatch.setattr(minhash, "SLICE_ROWS", 7)
    monkeypatch.setattr(minhash, "CHAINS", 0)
    rng = np.random.default_rng(9)
    text = list(rng.choice([f"w{i}" for i in range(400)], 120))
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.integers(99)}" for w in text)) for i in range(150)]
    rows += [(150 + i, t) for i, (_, t) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_words_across_pieces(monkeypatch):
    data = b"aa bb\tcc\x0bdd ee ff " * 50
    whole = shingles.word_hashes(data)
    monkeypatch.setattr(shingles, "PIECE", 7)
    cut = shingles.word_hashes(data)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and len(whole[0]) == 300


def test_distance_counts_positions(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << minhash.BITS, (2, minhash.CHUNKS, minhash.WITHIN))
    codes[1, ::2] = codes[0, ::2]
    codes[1, 1, 0] = codes[0, 1, 0] ^ 1
    codes[1, 1, 1] = codes[0, 1, 1] ^ (1 << (minhash.BITS - 1))
    sig = (codes << (minhash.BITS * np.arange(minhash.WITHIN))).sum(axis=2)
    a, b = (spark.createDataFrame([tuple(map(int, s))], ", ".join(f"{c} long" for c in minhash.SIGNATURE)) for s in sig)
    got = a.alias("a").join(b.alias("b")).select(minhash._distance("a", "b")).first()[0]
    assert got == int((codes[0] != codes[1]).sum())


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(5000, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, "b", "a").collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, n)}


def test_marks_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [int((p << 40) + i) for p in (0, 1, 70) for i in (*range(40), minhash.MARKS - 1, minhash.MARKS, 5 * minhash.MARKS + 7)]
    chosen = [r for r in rows if rng.random() < 0.5]
    df = spark.createDataFrame([(r,) for r in rows], "row long")
    for some in (chosen, chosen * 3, [], rows):
        joined, held = minhash._marked(df, spark.createDataFrame([(r,) for r in some], "b long"), "b")
        assert sorted(r.row for r in joined.where(held).collect()) == sorted(set(some))
        assert sorted(r.row for r in joined.where(~held).collect()) == sorted(set(rows) - set(some))


def test_texts_that_stay_are_not_shuffled(spark, documents):
    plan = minhash.deduplicated(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
