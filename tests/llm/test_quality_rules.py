import math
import re
from collections import Counter

from pyspark.sql import functions as F

from gatewarden.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_match_a_plain_version(spark, odd_docs):
    more = spark.createDataFrame(
        [
            (20, "a b c a b c a b c", None, None, None),
            (21, "a a a a a", None, None, None),
            (22, "x y z\nx y z\n \nq # $ | w\nx y z x y", None, None, None),
            (23, "the cat sat on the cat sat on the mat\x0bwith\x0cthe cat\r\nsat on", None, None, None),
        ],
        odd_docs.schema,
    )
    docs = odd_docs.union(more)
    got = Counter(tuple(r)[2:] + (r.doc_id,) for r in q.text_counts(docs).collect())
    want = Counter((*brute(r.text), r.doc_id) for r in docs.collect())
    assert got == want


def test_allowed_rejections_is_the_exact_binomial_bound(spark):
    cases = [(0, 0.1, 0.05), (10, 0.1, 0.05), (40, 0.1, 0.05), (400, 0.02, 0.01), (5000, 0.0125, 0.001), (90_000, 0.01, 0.01)]
    rows = spark.createDataFrame(cases, "n long, p double, e double")
    got = rows.select(q.allowed_rejections(F.col("n"), F.col("p"), F.col("e"))).collect()
    for (n, p, e), (k,) in zip(cases, got, strict=True):
        below, want = 0.0, -1
        for i in range(n + 1):
            below += math.exp(
                math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            )
            if below > e:
                break
            want = i
        assert k == want, (n, p, e)


def test_cutoffs_catch_junk_and_leave_good_texts(spark, sentences):
    rows, labels = [], []
    for i in range(900):
        junk = i % 9 == 0
        text = sentences(i, 60)
        rows.append((i, text.replace(" ", "### ") if junk else text, "en" if i % 3 else "de", None, None))
        labels.append((i, 0 if junk else 1, 0))
    # Languages with few labels share one stratum; a null language belongs to it.
    rows += [(10_000 + i, sentences(i, 60).replace(" ", "%% "), None, None, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.quality_verdicts(docs, table).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(900) if i % 9)
    assert not any(got[i].kept for i in range(0, 900, 9) if i % 3)
    # Too few good labels to prove anything at this level: the base rule alone decides.
    strict = q.quality_verdicts(docs, table, q.Risk(false_rejections=0.001)).collect()
    assert all(r.kept == (not r.base_failed) for r in strict)


def test_every_stratum_can_prove_a_cutoff(spark):
    risk = q.Risk()
    share, rule = risk.false_rejections / len(q.RULES), next(iter(q.RULES))

    def provable(n, strata):
        return (1 - share) ** n <= risk.error / (len(q.RULES) * strata)

    cases = {
        ("en", "fr"): {"en": 5000, "fr": 700, "de": 470, "es": 307, None: 3},
        ("en",): {"en": 5000, "fr": 500, "de": 100},
        (): {"en": 600, "fr": 300},
        tuple(f"l{i:02}" for i in range(60)): {**{f"l{i:02}": 900 for i in range(60)}, None: 900},
    }
    for want, good in cases.items():
        tally = spark.createDataFrame([(lang, rule, 0, n, 5) for lang, n in good.items()], "lang string, rule string, level int, good long, bad long")
        named = sorted(r.lang for r in q.named_strata(tally, risk).collect())
        assert tuple(named) == want
        pool = sum(n for lang, n in good.items() if lang not in named)
        assert all(provable(n, len(named) + 1) for n in [*(good[x] for x in named), pool])


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.quality_verdicts(odd_docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)), labels).collect()
    assert len(got) == odd_docs.count()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert {r.base_failed for r in got if r.doc_id in (5, 6, 7)} == {True}
    assert q.quality_verdicts(no_docs, labels).count() == 0
