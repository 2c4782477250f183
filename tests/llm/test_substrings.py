import hashlib
from collections import Counter

from pyspark.sql import functions as F

from gatewarden.llm import substrings as s
from tests.llm.conftest import words_of


def plain(rows):
    """(doc_id, n_words, n_removed, digest) of every row."""
    first = {}
    for r in rows:
        if r.doc_id is not None:
            words = words_of(r.text)
            for i in range(len(words) - 12):
                key = tuple(words[i : i + 13])
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        words = words_of(r.text)
        gone = [False] * len(words)
        if r.doc_id is not None:
            for i in range(len(words) - 12):
                if first[tuple(words[i : i + 13])] < r.doc_id:
                    gone[i : i + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((r.doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_cover_meets_every_shift():
    assert {(i - j) % s.PERIOD for i in s.COVER for j in s.COVER} == set(range(s.PERIOD))
    assert s.ANCHOR + s.PERIOD - 1 == s.LENGTH


def test_matches_a_plain_version_at_every_alignment(spark, odd_docs, sentences):
    passage = sentences(9, 13)
    rows = [(1000 + k, f"{sentences(k, 20 + k)}\n{passage}\t{sentences(100 + k, 9)}", None, None, None) for k in range(16)]
    rows += [(2000, " ".join(passage.split()[:12]), None, None, None), (2001, passage + " " + passage, None, None, None)]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    got = Counter(tuple(r) for r in s.digest(s.deduplicated(docs)).collect())
    assert got == plain(docs.collect())


def test_texts_and_other_columns_stay(spark, sentences):
    passage = sentences(9, 14)
    rows = [
        (1, f"a  b\n{passage}", {"k": 1}, 0),
        (2, f"  first\t line\n\n{passage} last  \n", {"k": 2}, 9),
        (3, "untouched \n\n text ", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, extra map<string,int>, n_words int")
    got = {r.doc_id: r for r in s.deduplicated(docs).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "first\t line last" and got[2].n_removed == 14 and got[2].extra == {"k": 2}


def test_empty_table(no_docs):
    found = s.deduplicated(no_docs.withColumn("bucket", F.lit(1)))
    assert found.count() == 0 and found.columns[-3:] == ["bucket", "n_words", "n_removed"]
