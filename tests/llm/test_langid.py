import numpy as np

from tidemark.llm import langid


def test_held_out_accuracy(documents):
    rows = langid.training_rows(documents)
    model = langid.fit(rows)
    got = langid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang_pred = lang").count()
    assert right >= 0.97 * got.count() > 0


def test_spans_of_mixed_text(documents):
    model = langid.fit(langid.training_rows(documents))
    texts = {r.lang: r.text for r in documents.where("length(text) > 800").collect()}
    mixed = texts["de"][:600] + " " + texts["es"][:600]
    (lang, score, spans), = langid.Labeller(model)([mixed])
    found = [s.split(":") for s in spans.split(",")]
    assert [s[2] for s in found[:2]] == ["de", "es"] and abs(int(found[1][0]) - 600) < 60 and 0.4 < score < 0.6


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)) * 3
    got, begin = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        own = scores[begin : begin + n]
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), int)
        value = [own[np.arange(n), p].sum() - 2.0 * (np.diff(p) != 0).sum() for p in paths]
        assert list(got[begin : begin + n]) == list(paths[int(np.argmax(value))])
        begin += n


def test_scripts_narrow_candidates():
    model = langid.fit([("мама мыла раму и окно", "ru"), ("the cat sat on a mat", "en")] * 5)
    labels = [x[0] for x in langid.Labeller(model)(["окно кот", "cat mat", "猫", None, "12 !"])]
    assert labels[:2] == ["ru", "en"] and labels[3:] == ["und", "und"]


def test_odd_rows(odd_documents, no_documents):
    model = langid.fit(langid.training_rows(odd_documents))
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd_documents, model).collect()}
    assert [got[i] for i in (3, 4, 5, 10)] == ["und"] * 4 and got[8] != "und"
    assert langid.identify(no_documents, langid.fit(langid.training_rows(no_documents))).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_documents, langid.fit([])).collect()} == {"und"}


FOREIGN = {
    "zh": "委员会昨天决定推迟对预算的讨论，因为该地区的一些重要文件仍然缺失。",
    "th": "คณะกรรมการ ตัดสินใจ เมื่อวานนี้ ให้ เลื่อน การอภิปราย",
    "zh_some_en": "委员会昨天决定推迟对预算的讨论因为该地区的一些重要文件仍然缺失 the of",
    "fi": "Valiokunta päätti eilen lykätä talousarviota koskevaa keskustelua koska joitakin tärkeitä asiakirjoja puuttui vielä. ",
    "pl": "Komisja zdecydowała wczoraj odłożyć dyskusję nad budżetem ponieważ brakowało jeszcze kilku ważnych dokumentów. ",
    "it": "La commissione ha deciso ieri di rinviare la discussione sul bilancio perché mancavano ancora alcuni documenti. ",
}


def test_foreign_documents_are_not_accepted(spark, documents):
    rows = langid.training_rows(documents)
    model = langid.fit(rows)
    floors = langid.floors(model, rows)
    docs = documents.select("doc_id", "text")
    texts = [t * 20 if k in ("fi", "pl", "it") else t for k, t in FOREIGN.items()]
    foreign = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in langid.accepted(docs.union(foreign), model, floors).collect()}
    assert not kept & set(range(-len(texts), 0))
    unread = docs.where(langid.held_out() & (documents["lang"].isNotNull())).collect()
    assert sum(r.doc_id in kept for r in unread) >= 0.98 * len(unread) > 0
