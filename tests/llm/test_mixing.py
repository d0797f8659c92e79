import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing


def reference_targets(sizes, weights):
    """Repeats the sharing of the excess word for word until none is above its limit."""
    target = np.array(weights) / sum(weights) * 1.5 * sum(sizes)
    fixed = np.zeros(len(sizes), bool)
    while (above := ~fixed & (target > 2 * np.array(sizes))).any():
        excess = (target - 2 * np.array(sizes))[above].sum()
        target[above], fixed = (2 * np.array(sizes))[above], fixed | above
        target[~fixed] += excess * np.array(weights)[~fixed] / np.array(weights)[~fixed].sum()
    return target


def test_mix(documents):
    got = mixing.mixture(documents, keep=("doc_id", "source", "text"), shard_words=3000).toPandas()
    assert len(got) == documents.count() and (got["size"] == got["text"].str.split(r"[\x20\x09-\x0D]+", regex=True).map(
        lambda w: len([x for x in w if x]))).all()
    by = got.groupby("source").agg(n=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    want = reference_targets(by["n"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))])
    assert np.allclose(by["target"], want) and (by["n"] == by["own"]).all()
    assert (abs(by["taken"] - by["target"]) <= 0.51).all() and (got["taken"] <= 2 * got["size"]).all()
    assert (got["taken"] == got["draws"].map(lambda d: sum(x["words"] for x in d))).all()
    again = mixing.mixture(documents.repartition(7), shard_words=3000).toPandas()
    assert got.set_index("doc_id")["taken"].to_dict() == again.set_index("doc_id")["taken"].to_dict()


def test_shards_are_even_and_mixed(documents):
    mixed = mixing.mixture(documents, keep=("doc_id", "source"), shard_words=6000)
    rows = mixing.shuffled(mixed)
    by = rows.groupBy("shard").agg(F.sum("words").alias("n"), F.countDistinct("source").alias("k"), F.max("position").alias("last"),
                                   F.count("*").alias("rows")).toPandas()
    assert (by["last"] == by["rows"]).all() and by["n"].sum() == mixed.agg(F.sum("taken")).first()[0]
    assert len(by) > 3 and by["n"].max() < 2 * by["n"].mean()


def test_tree_keeps_quotas():
    quotas = np.array([100, 0, 7, 1000])
    parts = mixing.split_quotas(quotas, 9, np.random.default_rng(0))
    assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all() and np.ptp(parts.sum(axis=1)) <= 9


def test_odd_rows(odd_documents, no_documents):
    got = mixing.mixture(odd_documents).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].size == 0 and by_id[3].taken == 0 and by_id[2].source_size == by_id[6].source_size == 12
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixture(no_documents).collect() == []
    assert mixing.mixture(no_documents.union(odd_documents.where("doc_id = 4"))).first().taken == 0


def test_places_are_the_shards_order(odd_documents, documents):
    mixed = mixing.mixture(documents, keep=("doc_id", "source"), shard_words=6000)
    rows = mixing.with_places(mixed).collect()
    assert len(rows) == documents.count() and all(sum(p.words for p in r.places) == r.taken for r in rows)
    places = sorted((p.shard, p.position) for r in rows for p in r.places)
    shards = sorted({s for s, _ in places})
    assert places == [(s, i + 1) for s in shards for i in range(sum(x == s for x, _ in places))]
    assert len(mixing.with_places(mixing.mixture(odd_documents)).collect()) == 12


def test_whole_rows_round_to_the_nearer_document(documents):
    rows = mixing.whole_rows(mixing.mixture(documents, keep=("doc_id", "source"), shard_words=6000)).toPandas()
    assert (rows["taken"] == rows["size"] * rows["draws"].map(len)).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by["taken"] - by["target"]) <= 0.5 * by["most"] + 1).all()
