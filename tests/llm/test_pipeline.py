"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute_force as near_groups
from tests.llm.test_mixing import reference_targets
from tests.llm.test_packing import check_rows
from tests.llm.test_pii import brute_force as base_spans
from tidemark.llm.shared import stage

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], DATA), name))
    return out


def test_stages(steps):
    raw, known, single, clean, mixed, packed = ([tuple(r) for r in s.collect()] for s in steps)
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:5])
    assert set(known) <= set(raw) and len(known) >= 0.97 * len(raw)
    groups = near_groups([(r[0], r[1]) for r in known])
    assert sorted(single) == sorted(r for r in known if groups[r[0]][1] == r[0])
    text = {r[0]: r for r in single}
    assert len(clean) == len(single)
    for doc, new, lang, source, n in clean:
        spans = base_spans(text[doc][1])
        assert (lang, source, n) == (text[doc][2], text[doc][3], len(new))
        assert not any(text[doc][1][a:b] in new for a, _, _, b in spans) and (spans or new == text[doc][1] or "<" in new)
    size = {r[0]: len(r[1].split()) for r in clean}
    of = {r[0]: r[3] for r in clean}
    names = sorted(set(of.values()))
    sizes = [sum(n for d, n in size.items() if of[d] == s) for s in names]
    want = reference_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    taken = Counter()
    for doc, new, _, source, n in mixed:
        taken[source] += len(new.split())
        assert n == len(new)
    most = {s: max(n for d, n in size.items() if of[d] == s) for s in names}
    assert all(abs(taken[s] - t) <= 0.5 * most[s] + 1 for s, t in zip(names, want)) and max(Counter(r[0] for r in mixed).values()) <= 3
    assert {r[:3] for r in mixed} <= {r[:3] for r in clean}
    assert sum(r[3] for r in packed if r[2] == 0) > 0 and {r[0] for r in packed} == {r[0] for r in mixed}


def test_packing_stage_is_whole(steps):
    single = steps[3].dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in single.collect()]
    check_rows(rows, corpus_pipeline.best_fit_packing(single.sparkSession, single, DATA).collect(), 4096)


def test_empty_and_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, function in corpus_pipeline.STAGES:
            docs = stage(function(spark, docs, DATA), name)
        assert docs.columns[:3] == ["doc_id", "piece", "start"]


def test_mixing_stage_takes_whole_documents(spark):
    texts = [(i, "\n".join(f"w{i} x" for _ in range(1 + i * 37 % 101)) + " end" * (i // 2 % 2), "en", "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame([(*t, len(t[1])) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.source_mixing(spark, docs, DATA).collect()
    whole = {t[0]: t[1] for t in texts}
    assert all(r.text == whole[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    sizes = [sum(len(t[1].split()) for t in texts if t[3] == s) for s in "ab"]
    taken = [sum(len(r.text.split()) for r in rows if r.source == s) for s in "ab"]
    largest = max(len(t[1].split()) for t in texts)
    assert all(abs(t - w) <= 0.5 * largest + 0.5 for t, w in zip(taken, reference_targets(sizes, [5, 2])))
    assert max(Counter(r.doc_id for r in rows).values()) <= 2


def test_mixing_stage_never_cuts(spark):
    docs = spark.createDataFrame([(1, "a\nb  c\n d e\tf", "en", "a", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.source_mixing(spark, docs, DATA).collect()] == ["a\nb  c\n d e\tf"] * 2


def test_dedup_stage_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", None, 1), (1, text, "en", "a", 2), (2, text + " x", None, "b", 3), (3, None, "en", "a", 4), (None, text, "en", "a", 5),
            (4, "only here", None, None, None), (1, "another text of the same number " * 9, "en", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()]
    assert set(got) <= set(rows) and sorted(r[0] or 0 for r in got) == [0, 1, 3, 4]
