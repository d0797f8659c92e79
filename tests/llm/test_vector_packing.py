import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_packing import whole_ids
from tidemark.llm import vector_packing as vp


def check(got, examples, limits):
    """``got`` holds (doc, start, length, crc, whole, sequence, offset, loss); examples {doc: (ids, prompt)}."""
    pieces, content = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, whole, sequence, offset, loss in got:
        ids, prompt = examples[doc]
        assert n > 0 and whole == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
        assert loss == sum(i >= prompt and i > start for i in range(start, start + n))
        pieces[doc].append((start, n))
        content[sequence].append((offset, n, loss))
    assert pieces.keys() == examples.keys()
    for doc, own in pieces.items():
        own.sort()
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == len(examples[doc][0])
    padding = 0
    for own in content.values():
        own.sort()
        held = sum(n for _, n, _ in own)
        assert [o for o, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]]
        assert held <= limits.tokens and len(own) <= limits.segments and sum(x for _, _, x in own) <= limits.loss
        if held & (held - 1):
            padding += limits.tokens - held
            assert limits.tokens - held <= limits.slack
    return padding


def plain(examples, limits):
    for sequence, held in enumerate(vp.sequences(iter([(d, np.array(i, np.uint32), p) for d, (i, p) in examples.items()]), limits)):
        offset = 0
        for p in held:
            yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.whole, sequence, offset, p.loss
            offset += len(p.ids)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 90), st.integers(0, 60)), max_size=40),
    st.sampled_from([(32, 4, 32, 2), (32, 100, 9, 0), (17, 1, 17, 3), (64, 3, 1, 0), (16, 2, 5, 1)]),
)
def test_any_limits(sizes, limits):
    limits = vp.Limits(*limits)
    examples = {k: (list(range(k, k + n)), min(p, n)) for k, (n, p) in enumerate(sizes)}
    check(list(plain(examples, limits)), examples, limits)


def test_small_pools(monkeypatch):
    monkeypatch.setattr(vp, "POOL", 400)
    monkeypatch.setattr(vp, "POOL_PIECES", 30)
    rng = np.random.default_rng(5)
    for mean in (2, 20, 200):
        examples = {k: (list(range(n)), int(rng.integers(0, n + 1))) for k, n in enumerate(rng.integers(1, 2 * mean, 500).tolist())}
        limits = vp.Limits(64, 12, 50, 2)
        check(list(plain(examples, limits)), examples, limits)


def test_dot_product_picks_what_the_room_has_most_of():
    pool = vp.Pool(vp.Limits(100, 10, 100, 0))
    for doc, (n, prompt) in enumerate([(40, 39), (40, 0), (30, 0)]):
        pool.add(vp.Piece(doc, 0, np.zeros(n, np.uint32), n, prompt))
    best = pool.best((100, 10, 100))
    assert pool.keys[best] == (40, 39)
    # With no room for loss left only the prompt fits.
    assert pool.keys[pool.best((100, 10, 1))] == (40, 1)


def test_documents(documents):
    rows = documents.collect()
    ids = whole_ids([r.text or "" for r in rows])
    examples = {r.doc_id: (x + [2], 0) for r, x in zip(rows, ids)}
    got = [tuple(r) for r in vp.pack_vectors(documents).collect()]
    total = sum(len(x) for x, _ in examples.values())
    assert check(got, examples, vp.Limits()) <= 0.01 * total
    assert len(got) <= len(rows) + 2 * len({r[5] for r in got})


def test_prompts(spark):
    rows = [(k, "say it " * (k % 9), "well done " * (k % 50)) for k in range(200)] + [(200, None, None), (201, "", "x " * 9000)]
    docs = spark.createDataFrame(rows, "key long, ask string, answer string")
    limits = vp.Limits(512, 6, 300, 8)
    got = vp.pack_vectors(docs, limits=limits, id_col="key", text_col="answer", prompt_col="ask").collect()
    asks, answers = (whole_ids([r[i] or "" for r in rows]) for i in (1, 2))
    check([tuple(r) for r in got], {r[0]: (a + b + [2], len(a)) for r, a, b in zip(rows, asks, answers)}, limits)


def test_odd_rows(odd_documents, no_documents):
    got = vp.pack_vectors(odd_documents).collect()
    assert {r.doc_id for r in got} == {None, *range(1, 11)} and {r.doc_id: r.doc_tokens for r in got}[3] == 1
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * {r.doc_id: r.doc_tokens for r in got}[1]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert vp.pack_vectors(no_documents).collect() == []
