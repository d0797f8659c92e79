import numpy as np

from tests.llm.test_minhash import smallest_reachable
from tidemark.llm.embeddings import near_vectors


def brute_force(ids, vectors, threshold=0.9):
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    component = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(n), component[i]) for i, n in zip(ids, near.sum(axis=1))}


def test_equals_brute_force_over_several_blocks(tables):
    table = tables("embeddings")
    rows = table.collect()
    want = brute_force([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    for block_rows in (30, 8192):
        got = near_vectors(table, block_rows=block_rows).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_doubtful_pairs_are_computed_again(spark):
    """Cosines that differ from the threshold by less than the quantisation error."""
    angle = np.arccos(0.9)
    rows = [(0, [1.0, 0.0, 0.0])]
    for i, d in enumerate((-1e-3, -1e-9, 1e-9, 1e-3), 1):
        rows.append((i, [float(np.cos(angle + d)), float(np.sin(angle + d)), 0.0]))
    rows += [(10 + i, [0.0, 0.0, 1e-200 * (i + 1)]) for i in range(3)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_n(rows)


def brute_n(rows):
    out = {}
    for i, v in rows:
        a = np.array(v) / np.abs(v).max()
        out[i] = sum(
            j != i and float(a @ (b := np.array(w) / np.abs(w).max())) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
            for j, w in rows
        )
    return out


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b"), (2, [1.0, 2.0], "b"), (3, [2.0, 4.1], None), (4, None, "a"),
        (5, [0.0, 0.0], "a"), (6, [nan, 1.0], "a"), (7, [inf, 1.0], "a"), (8, [None, 1.0], "a"), (9, [], "a"),
        (10, [1.0, 2.0, 0.0], "a"), (None, [1.0, 2.0], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").selectExpr("*", "1 as block")
    got = [tuple(r) for r in near_vectors(table).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (None, 0, None, True)]
        + [(i, 0, i, True) for i in range(4, 11)], key=str)
    assert near_vectors(table.where("false")).collect() == []
