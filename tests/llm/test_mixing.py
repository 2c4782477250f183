import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import mixing


def plain_rake(tokens, targets, rounds=500):
    """tokens: {(source, lang, topic): n}; targets: one {category: share} per dimension."""
    whole = sum(tokens.values())
    share = {c: n / whole for c, n in tokens.items()}
    raked = dict(share)
    for _ in range(rounds):
        for d, wanted in enumerate(targets):
            sums = {}
            for c, x in raked.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            raked = {c: x * wanted[c[d]] / sums[c[d]] for c, x in raked.items()}
    ratio = {c: raked[c] / share[c] for c in raked}
    return {c: r / max(ratio.values()) for c, r in ratio.items()}


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(600):
        source, lang = f"s{min(3, i % 7)}", ["en", "de", None][i % 3]
        text = " ".join(["word"] * int(draw.integers(1, 60))) + (" copyright" if i % 5 == 0 else "")
        rows.append((i, text, lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_probabilities_match_a_plain_version(spark, docs):
    stated = {
        "source": spark.createDataFrame([("s0", 1.0), ("s1", 1.0), ("s2", 1.0), ("s3", 1.0), ("absent", 4.0)], "category string, target double"),
        "lang": spark.createDataFrame([("en", 2.0), ("de", 1.0), ("?", 1.0)], "category string, target double"),
        "topic": spark.createDataFrame([("legal", 0.5), ("plain", 0.5)], "category string, target double"),
    }
    rows = mixing.mixed(docs, stated).collect()
    tokens = {}
    for r in rows:
        cell = (r.source, r.lang or "?", r.topic)
        tokens[cell] = tokens.get(cell, 0) + len(r.text.split())
    want = plain_rake(tokens, [{f"s{i}": 0.25 for i in range(4)}, {"en": 0.5, "de": 0.25, "?": 0.25}, {"legal": 0.5, "plain": 0.5}])
    for r in rows:
        assert r.probability == pytest.approx(want[(r.source, r.lang or "?", r.topic)], rel=1e-3)
    # Expected tokens of the sample have the raked shares.
    expected = sum(r.probability * len(r.text.split()) for r in rows)
    legal = sum(r.probability * len(r.text.split()) for r in rows if r.topic == "legal")
    assert legal / expected == pytest.approx(0.5, abs=1e-3)
    assert all(r.kept for r in rows if r.probability == 1.0)
    assert 0.5 < sum(r.kept for r in rows) / sum(r.probability for r in rows) < 1.5


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    found = mixing.mixed(odd_docs.withColumn("kept", F.lit("clash")).withColumn("tokens", F.lit(1)))
    rows = found.collect()
    assert len(rows) == odd_docs.count() and "tokens" in found.columns
    assert all(0 < r.probability <= 1 for r in rows)
    repeated = [r.kept for r in rows if r.doc_id == 3]
    assert len(set(repeated)) == 1
    assert {r.topic for r in rows if r.doc_id in (5, 6)} == {"other"}
    assert mixing.mixed(no_docs).count() == 0


def test_topics_ignore_case_and_need_whole_addresses(spark):
    want = {
        "TOKEN = 9233": "technical", "a Token": "technical", "SECRET": "technical", "Secret": "technical",
        "PassWord": "technical", "my apikey": "technical", "API_KEY": "technical", "Api-Key": "technical",
        "HTTPS://EXAMPLE": "technical", "Http://x": "technical", "ALL RIGHTS RESERVED": "legal",
        "All Rights Reserved": "legal", "LiCeNcE": "legal", "CopyRight 2020": "legal", "token under License": "legal",
        "write to a.b@example.org": "contact", "token a@bc": "contact", "5 pens @ 3": "plain", "only @": "plain",
        "@ token": "technical", "api key": "plain", "12 @ 3": "other", "": "other",
    }
    rows = spark.createDataFrame([(t,) for t in want], "text string")
    got = {r.text: r.topic for r in rows.select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()}
    assert got == want
