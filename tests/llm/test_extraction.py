import re

from tidemark.llm import blocks, extraction


def by_tags(page):
    """The article's blocks by a plain reading of the page's own tags."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    body = re.sub(r"<[^>]*\Z", "", body)
    parts = re.split(r"</?(?:p|h1)[^>]*>", body)
    texts = [blocks.clean(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)) for p in parts]
    return "\n".join(t for t in texts if t)


def test_equals_the_article(tables):
    table = tables("pages")
    labeller = extraction.fit(extraction.training_pages(table))
    rows = {r.page_id: r.html for r in table.collect()}
    got = extraction.extract(table, labeller).collect()
    assert len(got) == len(rows) and all(r.text == by_tags(rows[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_other_layouts(tables):
    table = tables("pages")
    labeller = extraction.fit(extraction.training_pages(table))
    texts = [leaf.text for r in table.limit(30).collect() for leaf in blocks.leaves(r.html) if extraction.own_label(leaf) and len(leaf.text) > 60]
    right = total = 0
    for i in range(0, 40, 4):
        main, other = texts[i : i + 3], texts[i + 3 : i + 6]
        page = (
            "<html><body><header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav></header>"
            f"<div class='cookie-notice'>{other[0]}</div><div class='content'><h1>Title here</h1>"
            + "".join(f"<p>{t}</p>" for t in main)
            + f"</div><aside class='sidebar'><p>{other[1]}</p></aside><section class='comments'><div class='comment'><p>{other[2]}</p></div>"
            "</section><form><p>Subscribe now</p></form><footer>All rights</footer></body></html>")
        leaves = blocks.leaves(page)
        (p,) = labeller.probabilities([extraction.features(leaves)])
        want = [leaf.text in main or leaf.text == "Title here" for leaf in leaves]
        right += sum((x >= 0.5) == y for x, y in zip(p, want))
        total += len(want)
    assert right >= 0.95 * total


def test_gradients():
    import numpy as np

    from tidemark.llm.lstm import BiLstm

    rng = np.random.default_rng(0)
    net, x, lengths = BiLstm(3, 4, rng), rng.normal(size=(2, 5, 3)).astype(np.float32), np.array([5, 3])
    weight = rng.normal(size=(2, 5, 8)).astype(np.float32) * (np.arange(5)[None, :] < lengths[:, None])[:, :, None]
    net.forward(x, lengths)
    for p, g in zip(net.parameters(), net.backward(weight)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, values = p[i], []
        for d in (1e-2, -1e-2):
            p[i] = old + d
            values.append(float((net.forward(x, lengths) * weight).sum()))
        p[i] = old
        assert abs((values[0] - values[1]) / 2e-2 - g[i]) < 0.02 * max(1, abs(g[i]))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a &amp;&nbsp; b<br>c"), (3, "u", "<article><p>a &amp;&nbsp; b<br>c"),
            (None, "u", "plain < text"), (4, "u", "<p>" * 3000 + "x"), (5, "u", "<article>" + "<p>some words here.</p>" * 2000 + "<footer>f</footer>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as n_main")
    labeller = extraction.fit([f"<nav>m</nav><article><p>{'word ' * k}.</p></article><footer>f</footer>" for k in range(1, 20)])
    got = extraction.extract(table, labeller).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.page_id == 3] == ["a & b c"] * 2
    assert next(r for r in got if r.page_id == 5).n_blocks == 2001
    assert extraction.extract(table.where("false"), extraction.fit([])).collect() == []


def test_long_pages_are_one_sequence(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    labeller = extraction.Labeller()
    labeller.skip[:] = rng.normal(size=extraction.DIMS) * 0.1
    pages = [rng.normal(size=(n, extraction.DIMS)).astype(np.float32) for n in (3, 0, 1500, 40, 700, 1)]
    got = labeller.probabilities(pages)
    for page, own in zip(pages, got):
        if len(page):
            alone = extraction.sigmoid(labeller._logits(page[None], np.array([len(page)]))[0])[0]
            assert np.allclose(own, alone, atol=1e-5)
    # The first block of a long page is read in the light of its last one.
    changed = pages[2].copy()
    changed[-1] += 50
    assert len(got[1]) == 0 and not np.array_equal(labeller.probabilities([changed])[0][:-1], got[2][:-1])
    monkeypatch.setattr(extraction, "BLOCKS_TOGETHER", 100)
    labeller.train([(p, np.zeros(len(p), np.float32)) for p in pages if len(p)], steps=2)
