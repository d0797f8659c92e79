import hashlib
import zlib

from tidemark.llm import media


def brute_force(text):
    data = (text or "").encode()
    n = len(data)
    data += b"\0" * (-n % 64 if n else 64)
    return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])


def test_equals_brute_force(documents, odd_documents, no_documents):
    for table in (documents, odd_documents):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = media.media_columns(table).collect()
        assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in got) == sorted((str(i), *brute_force(t)) for i, t in rows)
        by_text = {}
        for r in got:
            by_text.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
        assert all(len(v) == 1 for v in by_text.values())
    assert media.media_columns(no_documents).collect() == []


def test_image_round_trip():
    for data in (b"", b"a", b"\0" * 64, bytes(range(256)) * 5, b"P5\n255\n"):
        stored = media.encode_image(data)
        samples, n = media.decode_image(stored)
        assert samples[:n] == data and not samples[n:].strip(b"\0") and len(samples) % 64 == 0 and samples


def test_parts_stay_in_order():
    page = ('<title>t</title><p>one <b>two</b><img src="sha256:aa" alt="x &amp; y"><p>three<figure><img src=sha256:bb><img src="u.png">'
            "<figcaption>cap  tion</figcaption></figure>four<script>no</script>")
    assert media.parts(page) == [
        (0, "text", "one two", None, None), (1, "media", None, "aa", "x & y"), (2, "text", "three", None, None),
        (3, "media", None, "bb", "cap tion"), (4, "media", None, None, "cap tion"), (5, "text", "four", None, None)]


def test_references_without_payload_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><img src="sha256:zz">'), (2, None), (2, "text")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, n_bytes long")
    got = media.resolved(media.interleaved(pages), store, "page_id").select("page_id", "position", "digest", "n_bytes").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "aa", 5), (1, 1, "zz", None), (2, 0, None, None)]
