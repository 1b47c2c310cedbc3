"""Extra columns with names that operators might use, and texts without letters."""

import pytest

import corpus_pipeline
from faultline.llm import lang_id

NAMES = ("_verdict", "__lines", "__copy", "__key", "__k", "__content", "__gone", "__id", "__VERDICT", "n_lines", "n_removed", "_id", "_text", "_key", "_lang", "___id")
WORDS = {"en": "the house and the garden of the old town are open to all", "de": "das Haus und der Garten der alten Stadt sind allen offen"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        words = WORDS[lang].split()
        text = " ".join(words[(i * i + k * i + k) % len(words)] for i in range(60)) + f"\nline {k}"
        rows.append((k, text, lang, "ab"[k % 2], len(text), *[f"{n} of {k}" for n in NAMES]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_stages_keep_columns_of_any_name(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert [r[n] for n in NAMES] == [f"{n} of {r['doc_id']}" for n in NAMES], name
        d = out
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= len(rows)


def test_texts_without_letters_are_undetermined(spark, docs):
    model = lang_id.learn(docs)
    texts = ["½ ² 7", "Ⅷ ①", "123 _ -", "", None, "́̂", "👍"]
    got = lang_id.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [(r["_lang"]["lang"], r["_lang"]["score"], r["_lang"]["rejected"]) for r in got] == [("und", 0.0, True)] * len(texts)


def test_marks_stay_with_their_letters():
    assert lang_id._fold("हिन्दी में लिखा! 5 é_É").decode() == "हिन्दी में लिखा é é "


def test_parts_share_the_dictionary(spark):
    rows = [(k, "да нет привет мир " * 400, "ru") for k in range(900)]
    content = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["ru"]
    assert len(content) <= lang_id.DICT_BYTES and content.count(b"\n") == lang_id.PER_LANGUAGE - 1


def test_empty_tables_and_tables_without_labels(spark, docs):
    assert lang_id.learn(docs.limit(0)) == {}
    none = docs.withColumn("lang", lang_id.F.lit(None).cast("string"))
    assert lang_id.keep_identified(none, lang_id.learn(none)).isEmpty()
    d = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
        assert d.count() == 0, name
