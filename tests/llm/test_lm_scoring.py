import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import chunks, lm_scoring
from tests.llm.conftest import words_of


def plain(texts, order=3, backoff=0.4):
    """(n_words, n_full, n_unseen, log_score) of every text."""
    grams = []
    for text in texts:
        words = [w.lower() for w in words_of(text)]
        grams.append(Counter(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)))
    total = sum(grams, Counter())
    n = sum(c for g, c in total.items() if len(g) == 1)
    out = []
    for text, own in zip(texts, grams, strict=True):
        words = [w.lower() for w in words_of(text)]
        score, full, unseen = 0.0, 0, 0
        for i in range(len(words)):
            most = min(order, i + 1)
            for k in range(most, -1, -1):
                if k == 0:
                    value, unseen = -math.log(max(n - len(words), 1)), unseen + 1
                    break
                gram = tuple(words[i - k + 1 : i + 1])
                count = total[gram] - own[gram]
                if count > 0:
                    below = total[gram[:-1]] - own[gram[:-1]] if k > 1 else n - len(words)
                    value = math.log(count / below)
                    full += k == order
                    break
            score += value + (most - k) * math.log(backoff)
        out.append((len(words), full, unseen, round(score, 6) + 0.0))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_a_plain_version(odd_docs, order):
    rows = odd_docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows], order), strict=True))
    got = lm_scoring.scores(odd_docs.withColumn("n_words", F.lit("clash")), order).collect()
    assert Counter((r.doc_id, r.n_words, r.n_full, r.n_unseen, round(r.log_score, 6) + 0.0) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_one_document_and_none(spark, no_docs):
    one = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    (row,) = lm_scoring.scores(one).collect()
    assert (row.n_words, row.n_full, row.n_unseen) == (3, 0, 3)
    assert row.log_score == pytest.approx((1 + 2 + 3) * math.log(0.4))
    assert lm_scoring.scores(no_docs).count() == 0


def test_portions_do_not_change_scores(monkeypatch, sentences):
    texts = [sentences(i, n, "ab") for i, n in enumerate((0, 3, 500, 1, 0, 2000, 40))] + [None]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    words = chunks.Words(table, lower=True)
    known = []
    for k in range(4):
        grams, counts = lm_scoring._distinct(words, k)
        known.append((grams, (counts * 2).astype(np.uint64)))

    def all_portions():
        parts = [lm_scoring._scored(words, a, b, known, 0.4) for a, b in lm_scoring._portions(words.count)]
        return [np.concatenate(column) for column in zip(*parts, strict=True)]

    whole = all_portions()
    monkeypatch.setattr(lm_scoring, "PORTION", 100)
    assert len(lm_scoring._portions(words.count)) > 3
    for a, b in zip(whole, all_portions(), strict=True):
        assert np.array_equal(a, b)
