import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_alignment as ta


@pytest.fixture(scope="module")
def use():
    return ta.encoders(*ta.default_paths())


def plain(text):
    """Ids and bytes of both tokenizations by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = ta.default_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(_alphabet())}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    want = (" " + text).encode()
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], []
    return ids_a, ids_b, bytes_a, bytes_b


def _alphabet():
    others = iter(range(256, 512))
    return [chr(b) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b else chr(next(others)) for b in range(256)]


def brute_force(rows):
    """The result for (doc_id, text) rows, links by comparing all byte ranges that can overlap."""
    of, counts = [], Counter()
    for _, text in rows:
        ids_a, ids_b, bytes_a, bytes_b = plain(text or "")
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = []
        for i, hi in enumerate(ends_a):
            lo = hi - len(bytes_a[i])
            for j in range(np.searchsorted(ends_b, lo, "right"), len(ends_b)):
                if ends_b[j] - len(bytes_b[j]) >= hi:
                    break
                links.append((ids_a[i], ids_b[j]))
        groups = []
        for cut in sorted(set(ends_a) & set(ends_b)):
            before = groups[-1][0] if groups else 0
            groups.append((cut, *[[str(t) for t, e in zip(ids, ends) if before < e <= cut] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]))
        named = ";".join(",".join(x) + "|" + ",".join(y) for _, x, y in groups)
        of.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(named.encode()).hexdigest() if named else ""))
        counts.update(links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (doc, a, b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha)
        for (doc, _), (a, b, g, links, sha) in zip(rows, of)
    ]


def result(df):
    return sorted((tuple(r) for r in ta.aligned_tokens(df).collect()), key=str)


HARD = ["", "x", " ", "  a  b ", "▁a", "a▁b", "<0x41> <s> </s> <unk>", "<|endoftext|>", "é́ 漢字かな 😀😀 ﬁ", "naïve—café…", "\x00\x01\n\r\t\x85\xa0",
        "a" * 3000, " " * 3000, "\n" * 700 + "x", "１２３ ½ ² 12345678901234567890", "é ﻿z ‍ "]


def test_hard_texts_equal_brute_force(spark):
    rows = list(enumerate([None, *HARD, *HARD[3:5]]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == sorted(brute_force(rows), key=str)


def test_documents_equal_brute_force(documents):
    docs = documents.where("length(text) < 3000 or text is null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) > 100
    assert result(docs.repartition(3)) == sorted(brute_force(rows), key=str)


def test_small_blocks_give_the_same(documents, monkeypatch):
    some = documents.where("doc_id < 60")
    whole = result(some)
    monkeypatch.setattr(ta, "BLOCK", 2000)
    assert result(some) == whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6), st.sampled_from([1, 2, 7, 256]))
def test_any_text_and_lane(texts, lane):
    use = ta.encoders(*ta.default_paths())
    frame, pairs = ta.align(use(texts), use, lane)
    want = brute_force(list(enumerate(texts)))
    got = list(zip(frame["n_a"], frame["n_b"], frame["n_groups"], frame["n_links"], frame["groups_sha256"]))
    assert got == [(w[1], w[2], w[3], w[4], w[7]) for w in want]
    assert [len(p) for p in pairs] == [w[4] for w in want]


def test_steps_are_bounded_by_lanes(use):
    text = "the quick brown fox jumps over lazy dogs " * 4000
    a, b = use([text])[0]
    a_end, b_end = np.cumsum(use.size_a[a]), np.cumsum(use.size_b[b])
    first, first_b, stop = ta.lanes(a_end, b_end, np.array([0]))
    assert (stop - first).max() <= 2 * ta.LANE and len(first) > len(a) / (2 * ta.LANE)
    assert (np.concatenate([[0], a_end])[first] == np.concatenate([[0], b_end])[first_b]).all()


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = result(odd_documents)
    short = [r for r in rows if len(r[1] or "") < 1000]
    assert len(got) == len(rows)
    want = {(w[0], *w[1:5], w[7]) for w in brute_force(short)}
    assert want <= {(g[0], *g[1:5], g[7]) for g in got}
    assert result(no_documents) == []
