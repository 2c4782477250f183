"""Quality rules whose cutoffs are chosen under a proven bound on false rejections.

Every rule compares one measure of a text with a cutoff. Documents labelled good are the
holdout: a cutoff may be used in a stratum only if the exact binomial test shows, at a level
corrected for all rules and strata, that it rejects at most a stated share of good documents.

Within a rule and stratum the cutoffs are tested from the loosest to the tightest and testing
stops at the first failure (a fixed sequence, so the grid itself needs no correction); across
rules and strata the level is divided by their number (Bonferroni). False rejections of the
rules add up at most, so the stated share is divided by the number of rules as well.

A language has a stratum of its own if its good labels suffice to prove a cutoff at that level
(``least_good``: without a single false rejection, at least); all others are judged together. Languages
are named in the order of their labels for as long as they, and those that are left, suffice, so every
stratum can prove a cutoff unless all labels together cannot. Of the
cutoffs that hold, the one with the largest surplus of bad over good shares rejected is used
(ties: the loosest); a rule without a surplus, or that catches hardly any bad document, stays off.

Only DataFrame functions run here.

Defined results
    null or empty text     no words: all counts 0, base_failed true, kept false
    null doc_id            judged like any other; never part of the holdout
    null language          belongs to the pooled stratum
    repeated rows          each is judged; a repeated label counts once, its worst quality holds
    no labels              no cutoff holds: kept is the opposite of base_failed
    extra columns          ignored
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join

WORD = r"[^\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
POOLED = "*"

#: Measures (share of something, larger is worse) and the cutoffs tested for each, loosest first.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "long_word_mean": (40.0, 30.0, 25.0, 20.0, 17.5, 15.0, 12.5, 11.0, 10.0, 9.0),
}


@dataclass(frozen=True)
class Risk:
    """Parameters of the guarantee."""

    #: Share of a stratum's good documents that all rules together may reject.
    false_rejections: float = 0.05
    #: Probability that the guarantee fails anywhere.
    error: float = 0.05
    #: A rule that rejects a smaller share of a stratum's bad documents is not worth its risk and stays off.
    min_capture: float = 0.02


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text; one pass, no shuffle.

    A text without a 3-word window found twice is known by its set of window hashes. In the
    others the hashes are sorted, each with its position in the low bits, so that equal ones
    stand side by side; the words of such neighbours are then compared.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ", -1), "").alias("words"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(WORD_CHAR))).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))),"
               " 1, greatest(size(words) - 2, 0))").alias("hashes"),
        # Bits that hold a position in this text.
        F.ceil(F.log2(F.size("words") + F.lit(2))).cast("int").alias("bits"),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn(
        "sorted",
        F.when(repeats, F.expr(
            "sort_array(transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i as bigint)))")),
    ).drop("hashes")
    rows = rows.withColumn("again", F.expr(
        """transform(
             filter(sequence(1, size(sorted) - 1), j -> shiftright(sorted[j] ^ sorted[j - 1], bits) = 0),
             j -> struct(cast(sorted[j - 1] & (shiftleft(1L, bits) - 1) as int) as a,
                         cast(sorted[j] & (shiftleft(1L, bits) - 1) as int) as b))"""
    )).drop("sorted")
    rows = rows.withColumn("starts", F.expr(
        """sort_array(array_distinct(flatten(transform(
             filter(again, x -> words[x.a] = words[x.b] and words[x.a + 1] = words[x.b + 1]
                                and words[x.a + 2] = words[x.b + 2]),
             x -> array(x.a, x.b)))))"""
    ))
    covered = F.expr(
        """coalesce(if(size(starts) = 0, 0L, aggregate(
             sequence(0, size(starts) - 1), 0L,
             (s, j) -> s + least(3, coalesce(get(starts, j + 1) - starts[j], 3)))), 0L)"""
    )
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def measured(counts: DataFrame) -> DataFrame:
    """The counts with the measure of every rule and the fixed base rule."""
    return counts.withColumns(
        {
            "symbol_share": _share("n_symbols", "word_chars"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "long_word_mean": _share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def allowed_rejections(n: Column, share: Column, error: Column) -> Column:
    """Most rejections among n good documents that still prove a rate of ``share`` at most.

    The largest k with P(Binomial(n, share) <= k) <= error, or -1. Terms follow from each other
    in logarithms, so large n cannot underflow where it matters.
    """
    log_p, log_q = F.ln(share), F.ln(F.lit(1.0) - share)
    steps = F.sequence(F.lit(0), F.ceil(n * share).cast("int"))
    start = F.struct((n * log_q).alias("term"), F.exp(n * log_q).alias("below"), F.lit(-1).alias("k"))

    def step(state: Column, i: Column) -> Column:
        # state.term belongs to i, state.below sums the terms 0..i.
        following = state["term"] + F.ln(F.greatest(n - i, F.lit(1)) / (i + 1)) + log_p - log_q
        return F.struct(
            following.alias("term"),
            (state["below"] + F.when(i < n, F.exp(following)).otherwise(0.0)).alias("below"),
            F.when(state["below"] <= error, i).otherwise(state["k"]).alias("k"),
        )

    return F.aggregate(steps, start, step, lambda state: state["k"])


def tallies(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, rule, level, good, bad: labelled documents by how many cutoffs would reject them.

    The level counts a rule's cutoffs, tightest first, that reject the document.
    """
    judged = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
    )
    holdout = facts.where(~F.col("base_failed")).join(judged, "doc_id")
    levels = [
        F.struct(F.lit(rule).alias("rule"), sum((F.col(rule) > c).cast("int") for c in grid).alias("level"))
        for rule, grid in RULES.items()
    ]
    return (
        holdout.select("lang", "good", F.explode(F.array(*levels)).alias("at"))
        .groupBy("lang", "at.rule", "at.level")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )


def least_good(strata: Column, risk: Risk) -> Column:
    """Good labels with which a cutoff that rejects none of them is proven, when there are so many strata."""
    level = F.lit(risk.error / len(RULES)) / strata
    return F.ln(level) / F.ln(F.lit(1.0 - risk.false_rejections / len(RULES)))


def named_strata(tally: DataFrame, risk: Risk) -> DataFrame:
    """lang, stratum of the languages that are judged on their own; works on one row per language."""
    first = tally.where(F.col("rule") == next(iter(RULES))).groupBy("lang").agg(F.sum("good").alias("n"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    order = Window.orderBy(F.desc("n"), "lang")
    ranked = first.where(F.col("lang").isNotNull()).select(
        "lang", "n", F.row_number().over(order).alias("place"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("so_far"),
        total.alias("total"),
    )
    need = least_good(F.col("place") + 1, risk)
    enough = (F.col("n") >= need) & (F.col("total") - F.col("so_far") >= need)
    judged = ranked.withColumn("last", F.max(F.when(enough, F.col("place"))).over(Window.partitionBy()))
    return judged.where(F.col("place") <= F.col("last")).select("lang", F.col("lang").alias("stratum"))


def cutoffs(tally: DataFrame, strata: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """stratum, rule, cutoff of every cutoff in force, with the counts that justify it.

    Works on one row per language, rule and level; the result has a row per stratum and rule.
    """
    tally = (
        tally.join(strata, "lang", "left")
        .groupBy(F.coalesce("stratum", F.lit(POOLED)).alias("stratum"), "rule", "level")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tally.select(
        "stratum",
        "rule",
        "level",
        F.sum("good").over(whole).alias("n_good"),
        F.sum("bad").over(whole).alias("n_bad"),
        F.sum("good").over(above).alias("good_rejected"),
        F.sum("bad").over(above).alias("bad_rejected"),
    )
    tests = tally.groupBy().agg((F.count_distinct("stratum") * len(RULES)).alias("tests"))
    allowed = allowed_rejections(
        F.col("n_good"), F.lit(risk.false_rejections / len(RULES)), F.lit(risk.error) / F.col("tests")
    )
    sizes = found.groupBy("stratum").agg(F.max("n_good").alias("n_good")).withColumn("tests", tests.scalar())
    surplus = _share("bad_rejected", "n_bad") - _share("good_rejected", "n_good")
    return (
        found.where(F.col("level") > 0)
        .join(sizes.select("stratum", allowed.alias("allowed")), "stratum")
        .where((F.col("good_rejected") <= F.col("allowed")) & (surplus > 0))
        .where(_share("bad_rejected", "n_bad") >= risk.min_capture)
        .groupBy("stratum", "rule")
        .agg(
            F.max_by(
                F.struct("level", "n_good", "n_bad", "good_rejected", "bad_rejected", "allowed"),
                F.struct(surplus, F.col("level")),
            ).alias("best")
        )
        .select("stratum", "rule", "best.*")
        .withColumn("cutoff", _cutoff_at_level())
    )


def _cutoff_at_level() -> Column:
    """The cutoff whose rejections start at a level (1 is the tightest)."""
    grids = F.lit(None).cast("double")
    for rule, grid in RULES.items():
        ascending = F.array(*[F.lit(c) for c in sorted(grid)])
        grids = F.when(F.col("rule") == rule, F.element_at(ascending, F.col("level"))).otherwise(grids)
    return grids


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the counts, base_failed, the rules that fired and ``kept``, one row per input row.

    The counts are stored once: the cutoffs and the verdicts both read them. Strata and cutoffs, a row per
    language at most, are stored too, so Spark knows their size and broadcasts them where they fit.
    """
    facts = measured(materialize(text_counts(docs), "quality-counts"))
    tally = materialize(tallies(facts, labels), "quality-tallies")
    strata = materialize(named_strata(tally, risk), "quality-strata")
    limits = materialize(
        cutoffs(tally, strata, risk).groupBy("stratum").agg(
            *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_limit") for rule in RULES]
        ),
        "quality-limits",
    )
    rows = skew_join(facts, strata, "lang", "left").withColumn(
        "stratum", F.coalesce("stratum", F.lit(POOLED))
    )
    rows = skew_join(rows, limits, "stratum", "left")
    fired = F.array_compact(
        F.array(*[F.when(F.col(rule) > F.col(f"{rule}_limit"), F.lit(rule)) for rule in RULES])
    )
    rows = rows.withColumn("rules_fired", F.array_join(fired, ","))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rules_fired") == "")).alias("kept"),
        "rules_fired",
    )
