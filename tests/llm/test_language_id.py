import zlib

import numpy as np

from spanloom.llm.language_id import DIMS, _PART, fit, held_out, language_id, term_weights

WORDS = {
    "en": "the of and that with this from have which their about would there",
    "de": "der und nicht mit eine auch sich über werden wird nach schon für",
    "fr": "les des est dans une pour qui avec sont cette après même être",
}


def corpus(spark):
    r = np.random.RandomState(3)
    rows = [
        (i, " ".join(r.choice(WORDS[l].split(), 12)), l, None)
        for i, l in enumerate(np.repeat(list(WORDS), 150).tolist())
    ]
    rows += [(900, None, "en", 1), (901, "123 ++ ½", "de", 1), (902, "", None, 1), (None, "the of and that", "en", 1)]
    rows += [(903, "Привет как твои дела сегодня мой хороший старый друг", None, 1), (904, "und " * 600_000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_held_out_accuracy_and_edges(spark):
    docs = corpus(spark)
    got = language_id(docs, fit(docs)).withColumn("held", held_out(docs["doc_id"])).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held"] and r["lang"] and r["doc_id"] < 900]
    assert len(held) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert not any(r["rejected"] for r in got if r["lang"] and r["text"] and r["doc_id"] != 901)
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[903]["rejected"] and by[903]["lang_pred"] in WORDS
    assert by[904]["lang_pred"] == "de" and 0 <= by[904]["score"] <= 1
    assert by[None]["lang_pred"] == "en"


def test_only_text_decides(spark):
    docs = corpus(spark)
    model = fit(docs)
    changed = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'src' AS source")
    a = {r["text"]: tuple(r[-3:]) for r in language_id(docs, model).select("text", "lang_pred", "score", "rejected").collect()}
    b = {r["text"]: tuple(r[-3:]) for r in language_id(changed, model).select("text", "lang_pred", "score", "rejected").collect()}
    assert a == b


def test_long_texts_count_every_gram_once():
    text = "abcdefgh ijk " * (_PART // 6)
    w = term_weights(text)
    raw = np.frombuffer(f" {text.strip()} ".encode(), dtype=np.uint8)
    grams = len(raw) - 1 + len(raw) - 2
    assert abs(np.exp(w[w > 0] - 1).sum() - grams) / grams < 1e-4 and len(w) == DIMS


def test_no_rows_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id(empty, fit(empty)).collect() == []
    one = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r[-3:]) for r in language_id(one, fit(one)).collect()] == [("und", 0.0, True)]


def test_the_fit_holds_its_rows_once():
    import tracemalloc

    import numpy as np

    from spanloom.llm import language_id

    rows = np.random.default_rng(2).random((2000, language_id.DIMS), dtype=np.float32)
    tracemalloc.start()
    model = language_id.fit_weights(rows, [f"l{i % 4}" for i in range(len(rows))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * rows.nbytes and model.languages == ["l0", "l1", "l2", "l3"]
