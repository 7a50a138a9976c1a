import random

from llm_helpers import ODD, doc

from crossloom.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.query(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").filter("held_out").collect()
    assert got.count() == lang.count() and len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(documents):
    model = [("en", b"the house and the garden of the king "), ("de", b"das haus und der garten des herrn ")]
    rows = ODD + [doc(7, "123 ... ! ² ½"), doc(8, "das Haus und der Garten"), doc(9, "THE HOUSE!! AND THE GARDEN")]
    got = {r.id: r for r in langid.identify(documents(rows), model).collect()}
    assert got[7].lang_pred == got[1].lang_pred == got[2].lang_pred == got[4].lang_pred == "und" and got[7].score == 0
    assert got[8].lang_pred == "de" and got[9].lang_pred == "en" and got[8].score > langid.MIN_MARGIN
    kept = langid.accepted(documents(rows), model).collect()
    assert {8, 9} <= {r.doc_id for r in kept} and not {1, 2, 4, 7} & {r.doc_id for r in kept}


def test_nothing_to_learn_from(documents):
    assert langid.learn(documents([])) == [] and langid.learn(documents([doc(1, "text", None)])) == []
    assert [r.lang_pred for r in langid.identify(documents([doc(1, "text")]), []).collect()] == ["und"]
    assert langid.identify(documents([]), [("en", b"the house and")]).collect() == []
    one = langid.learn(documents([doc(1, "only one language here"), doc(1, "only one language here")]))
    assert [x[0] for x in one] == ["en"] and one[0][1].count(b"only") == 2


def test_long_text_is_read_to_its_end(documents):
    model = langid.Model([("en", b"the house and the garden of the king " * 20), ("de", b"das haus und der garten des herrn " * 20)])
    text = "the house and the garden " * 10 + "das haus und der garten des herrn " * 4000
    assert model.predict(text)[0] == "de"


def _language(seed, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(60)]


def _text(words, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_languages_of_long_texts_and_rows_without_ids_are_learned(documents):
    """All rows of x are longer than the sampled bytes; all rows of y have no id."""
    x, y, z = _language(1, "abcdefghijk"), _language(2, "lmnopqrstuv"), _language(3, "abcdeqrstuv")
    rows = [doc(i, _text(x, i, 4000), "x") for i in range(3)] + [doc(None, _text(y, 10 + i, 200), "y") for i in range(3)] + [doc(20 + i, _text(z, 20 + i, 200), "z") for i in range(3)]
    model = langid.Model(langid.learn(documents(rows)))
    assert [model.predict(_text(w, 99, 80))[0] for w in (x, y, z)] == ["x", "y", "z"]


def test_every_language_is_learned(documents):
    langs = [_language(i, "abcdefghijklmnopqrstuv") for i in range(130)]
    found = langid.learn(documents([doc(i, _text(w, i, 300), f"l{i:03d}") for i, w in enumerate(langs)]))
    assert len(found) == 130 and sum(len(d) for _, d in found) <= langid.DICTIONARY_BYTES * langid.LANGUAGES
    model = langid.Model(found)
    assert all(model.predict(_text(w, 500 + i, 80))[0] == f"l{i:03d}" for i, w in enumerate(langs))
