import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import language_id as l

ALPHABETS = {"aa": "abcde ", "bb": "fghij ", "cc": "äöüßn ", "dd": "абвгд "}


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lang = list(ALPHABETS)[i % 4]
        text = "x" + "".join(draw.choice(list(ALPHABETS[lang]), 120))
        rows.append((i, text, None if i % 40 == 0 else lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_codewords_differ_in_half_of_their_bits():
    for n in (2, 5, 9):
        codes = l.codewords(n)
        differing = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(differing) >= (codes.shape[1] + 1) // 2


def test_held_out_rows_are_predicted_right(docs):
    marked = docs.withColumn("held_out", l.held_out())
    assert {r.doc_id for r in marked.where("held_out").collect()} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    model = l.train(marked.where("not held_out"))
    assert model.languages == ("aa", "bb", "cc", "dd")
    got = l.predicted(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_wrong_bits_are_outvoted_and_ties_flagged():
    codes = l.codewords(4)
    model = l.Model(("a", "b", "c", "d"), codes, np.zeros((8, 7)), np.zeros(7), np.ones(7), 0.6)
    margins = 4.0 * codes[2].copy()
    margins[0] *= -1
    assert model.scores(margins[None, :])[0].argmax() == 2
    assert model.scores(np.zeros((1, 7)))[0].max() == pytest.approx(0.25)


def test_odd_rows(docs, odd_docs, no_docs):
    model = l.train(docs)
    got = l.predicted(odd_docs.withColumn("score", F.lit("clash")), model)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and got.columns[-3:] == ["lang_pred", "score", "ambiguous"]
    for r in rows:
        unknown = not (r.text or "").strip()
        assert (r.lang_pred == "und") == unknown and (r.score == 0) == unknown
    assert l.predicted(no_docs, model).count() == 0


def test_nothing_or_one_language_to_learn(docs, no_docs):
    nothing = l.train(no_docs)
    assert {r.lang_pred for r in l.predicted(docs, nothing).collect()} == {"und"}
    one = l.train(docs.where("lang = 'aa'"))
    assert {(r.lang_pred, r.score) for r in l.predicted(docs, one).collect()} == {("aa", 1.0)}


def test_long_texts_are_read_whole():
    weights = np.random.default_rng(2).normal(size=(1 << 10, 3))
    raw = bytes(np.random.default_rng(3).integers(97, 123, 3_000_000, dtype=np.uint8))
    whole = l.grams(raw, 10)
    want = np.bincount(whole, minlength=1 << 10) @ weights / len(whole) * l.SCALE
    assert l.margins(raw, weights, np.zeros(3), 10) == pytest.approx(want, abs=1e-3)


def test_every_language_is_learned(spark):
    letters = [chr(0x4E00 + 7 * i) + chr(0x4E01 + 7 * i) + chr(0x4E02 + 7 * i) for i in range(70)]
    draw = np.random.default_rng(4)
    rows = [
        (100 * i + k, "".join(draw.choice(list(letters[i]), 40)), f"l{i:02}") for i in range(70) for k in range(4 if i else 8)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = l.Training(most_rows=140)
    sample = l.training_rows(docs.union(docs), settings).groupBy("lang").count().collect()
    assert {r["count"] for r in sample} == {2} and len(sample) == 70
    model = l.train(docs, settings)
    assert len(model.languages) == 70
    got = l.predicted(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_whole_texts_are_learned(spark):
    header = "the same header in every text " * 50
    rows = [(i, header + ["abcde " * 300, "vwxyz " * 300][i % 2], ["aa", "bb"][i % 2]) for i in range(40)]
    model = l.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([("abcde abcde abcde abcde",), ("vwxyz vwxyz vwxyz vwxyz",)], "text string")
    assert [r.lang_pred for r in l.predicted(asked, model).orderBy("text").collect()] == ["aa", "bb"]
