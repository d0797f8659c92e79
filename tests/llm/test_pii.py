import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import pii


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def count(m):
    return len(re.findall("[0-9]", m[0]))


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= count(m) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= count(m) <= 15),
]


def brute_force(text):
    return sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m))


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(pii.training_texts(docs))


def test_equals_brute_force(documents, tagger):
    rows = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.personal_data(documents, tagger).collect():
        base = brute_force(rows[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_added or r.spans == text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == i for b in base) for i in range(4)]


def test_random_strings_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(rng.choice(list("aZ0125@.-+ ()%_é\n"), rng.integers(0, 60)))
        assert pii.base_spans(text) == brute_force(text)
    for text in ("4111 1111-1111 1111", "1.2.3.4.5.6.7.8 999.1.1.1", "a@b a@b.c@d.e a.@x.y @x.y", "+1 (988) 555-2485 +1 +123456789", "1" * 5000 + "." + "@" * 3000):
        assert pii.base_spans(text) == brute_force(text)


def test_tagger_adds_other_forms(tagger):
    texts = ["please call the office under (269) 555-3296 for this", "write to jane.doe42 (at) mail3.example.com about it",
             "the server 10[.]20[.]30[.]40 is down", "paid with 4111.1111.1111.1111 at the shop", "no numbers in this one"]
    got = [[s[2] for s in added] for _, added in pii.find(texts, tagger)]
    assert sum(g == w for g, w in zip(got, [["phone"], ["email"], ["ip"], ["card"], []])) >= 4 and got[4] == []


def test_clean_documents_stay_clean(tables, tagger):
    docs = tables("documents")
    got = pii.personal_data(docs, tagger)
    assert got.where("n_email + n_ip + n_card + n_phone = 0 and n_added > 0").count() == 0


def test_crf_gradient():
    rng = np.random.default_rng(1)
    k, lengths = pii.LABELS, np.array([4, 2])
    scores, moves = rng.normal(size=(2, 4, k)), rng.normal(size=(k, k))
    labels = rng.integers(k, size=(2, 4))

    def loss(s, m):
        total = 0.0
        for row, n in enumerate(lengths):
            a = s[row, 0]
            for t in range(1, n):
                a = np.log(np.exp(a[:, None] + m).sum(axis=0)) + s[row, t]
            own = sum(s[row, t, labels[row, t]] for t in range(n)) + sum(m[labels[row, t - 1], labels[row, t]] for t in range(1, n))
            total += np.log(np.exp(a).sum()) - own
        return total

    ds, dm = pii.crf_gradient(scores.astype(np.float32), lengths, labels, moves)
    for target, grad in ((scores, ds), (moves, dm)):
        for i in [np.unravel_index(j, target.shape) for j in range(0, target.size, 7)]:
            old = target[i]
            target[i] = old + 1e-4
            up = loss(scores, moves)
            target[i] = old - 1e-4
            down = loss(scores, moves)
            target[i] = old
            assert abs((up - down) / 2e-4 - grad[i]) < 1e-3


def test_decode_is_the_best_path():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(2, 4, 3)) * 2, rng.normal(size=(3, 3))
    got = pii.decode(scores, np.array([4, 3]), moves)
    for row, n in enumerate((4, 3)):
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        value = [scores[row, range(n), p].sum() + moves[p[:-1], p[1:]].sum() for p in paths]
        assert list(got[row, :n]) == list(paths[int(np.argmax(value))])


def test_odd_rows(odd_documents, no_documents, tagger):
    got = pii.personal_data(odd_documents, tagger, keep=("source", "lang")).collect()
    assert len(got) == 12 and all(r.spans == "" for r in got) and {r.doc_id: r.redacted for r in got}[3] == ""
    assert pii.personal_data(no_documents, pii.fit([])).collect() == []


def test_redaction():
    text = "a b@c.de, +1 (988) 555-2485!"
    assert pii.redact(text, pii.base_spans(text)) == "a <EMAIL>, <PHONE>!"
    assert pii.redact("0123456789", [(1, 0, "ip", 5), (3, 1, "card", 7)]) == "0<IP>789"


def test_long_digit_runs():
    text = "0" * 5000 + "1.2.3.4 and 256.1.1.1 and " + "9" * 6000 + ".1.1.1"
    assert pii.base_spans(text) == brute_force_long(text)
    assert not pii.plausible("ip", "1" * 5000 + ".1.1.1") and pii.is_byte("0" * 5000) and not pii.is_byte("256")


def brute_force_long(text):
    return [(0, 1, "ip", 5007)]


def test_a_long_region_stands_alone(monkeypatch):
    assert [len(g) for g in pii._padded_groups([0, 1, 2, 3], [5, 6, 7, 100], 21)] == [3, 1]
    tagger = pii.Tagger()
    texts = ["call 555 123 4567 now " * k for k in (1, 2, 3)] + ["7 1" * 3000]
    regions = [pii.classes(t) for t in texts]
    whole = tagger.labels(regions)
    assert all((a == b).all() for a, b in zip(whole, [tagger.labels([r])[0] for r in regions]))


def test_training_texts_are_few_and_different(spark):
    rows = [(i % 3, f"mail{i % 7}@x.org") for i in range(500)] + [(None, "a@b.cd"), (5, None), (6, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.training_texts(docs, 10)
    assert len(got) == 10 and pii.training_texts(docs.repartition(5), 10) == got
    assert len(pii.training_texts(docs, 1000)) == 22 and pii.training_texts(docs.where("false")) == []
