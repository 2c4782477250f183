"""Mixing to target weights: token weights raked to marginals, then a calibrated sample.

Tokens are summed per cell (source, language, topic). Iterative proportional fitting scales the
cells' weights until their sums agree with the target share of every source, language and topic.
A document's probability is its cell's raked share over its present share, divided by the largest
such ratio, so the expected tokens of the sample have exactly the raked shares and the cell that is
scarcest against its target is kept whole.

Only sums per cell are iterated on, as stored tables; documents are read twice (sums, sample).

Defined results
    null source or lang    a category of its own, "?"
    null or empty text     no tokens, topic "other"; drawn like the rest of its cell
    a cell without tokens  probability 1 (it weighs nothing)
    null doc_id            drawn by the text alone
    repeated rows          drawn alike: all kept or none
    empty table            empty result
    category without target     keeps its present share before all shares are scaled to 1
    target without documents    has no effect
    extra columns          kept; topic, n_tokens, probability and kept of the input are replaced
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.plans.durable import materialize, materialize_with, release
from gatewarden.plans.joins import skew_join

DIMENSIONS = ("source", "lang", "topic")
MOST_SWEEPS = 60
TOLERANCE = 1e-5

#: Topics by what a text speaks of; the first that fits counts (fixed values): a pattern, and lower-case
#: words of which every text that fits the pattern contains one.
TOPICS = (
    ("legal", r"(?i)licen[sc]e|copyright|all rights reserved", ("license", "licence", "copyright", "all rights reserved")),
    ("contact", r"[\w.]+@[\w.]+\w", ("@",)),
    (
        "technical", r"(?i)password|token|secret|api[_-]?key|https?://",
        ("password", "token", "secret", "api_key", "api-key", "apikey", "http://", "https://"),
    ),
)


def topic_of(text: Column) -> Column:
    """The first topic whose pattern a text fits, ``plain`` for other texts with a letter, else ``other``."""
    text = F.coalesce(text, F.lit(""))

    def named(lowered: Column) -> Column:
        found = F.when(text.rlike(r"\p{L}"), F.lit("plain")).otherwise(F.lit("other"))
        for topic, pattern, words in reversed(TOPICS):
            # Substring searches first: a pattern takes several times as long, and few texts reach it.
            speaks = F.lit(False)
            for word in words:
                speaks = speaks | F.contains(lowered, F.lit(word))
            found = F.when(speaks & text.rlike(pattern), F.lit(topic)).otherwise(found)
        return found

    # An element of an array, so that a text is lowered once and not for every word.
    return F.get(F.transform(F.array(F.lower(text)), named), F.lit(0))


def token_count(text: Column) -> Column:
    """Words split at ASCII white space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.size(F.array_remove(F.split(plain, " ", -1), "")).cast("long")


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with topic and the three cell columns ``__source``, ``__lang`` and ``__topic``."""
    named = docs.drop("topic", "n_tokens", "probability", "kept")
    named = named.withColumn("topic", topic_of(F.col("text")) if topic is None else topic)
    return named.withColumns({f"__{d}": F.coalesce(F.col(d).cast("string"), F.lit("?")) for d in DIMENSIONS})


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(category, target): present shares to a power; below 1 it lifts small categories."""
    sums = cells.groupBy(F.col(f"__{dimension}").alias("category")).agg(F.sum("tokens").alias("tokens"))
    return sums.select("category", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("target"))


def _scaled_targets(cells: DataFrame, dimension: str, targets: DataFrame | None) -> DataFrame:
    """(category, target) of every category present, summing to 1."""
    present = cells.groupBy(F.col(f"__{dimension}").alias("category")).agg(F.sum("share").alias("share"))
    if targets is None:
        return present.select("category", F.col("share").alias("target"))
    stated = targets.groupBy("category").agg(F.sum("target").alias("stated"))
    total = stated.groupBy().agg(F.sum("stated").alias("total"))
    joined = present.join(stated, "category", "left").withColumn(
        "wanted", F.coalesce(F.try_divide(F.col("stated"), total.scalar()), F.col("share"))
    )
    whole = joined.groupBy().agg(F.sum("wanted").alias("whole"))
    return joined.select("category", (F.col("wanted") / whole.scalar()).alias("target"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """Cells (``__source``, ``__lang``, ``__topic``, tokens) with share, raked share and probability."""
    whole = cells.groupBy().agg(F.sum("tokens").alias("whole"))
    cells = cells.where(F.col("tokens") > 0).withColumn("share", F.col("tokens").cast("double") / whole.scalar())
    cells = materialize(cells, "mixing-cells")
    wanted = {
        d: materialize(_scaled_targets(cells, d, targets.get(d)), f"mixing-wanted-{d}").withColumnRenamed("category", f"__{d}")
        for d in DIMENSIONS
    }
    current = materialize(cells.withColumn("raked", F.col("share")), "mixing-sweep")
    for _ in range(MOST_SWEEPS):
        swept, moved = current, F.lit(0.0)
        for d in DIMENSIONS:
            key = f"__{d}"
            sums = swept.groupBy(key).agg(F.sum("raked").alias("__sum"))
            factor = wanted[d].join(sums, key).select(key, F.try_divide("target", "__sum").alias(f"__by_{d}"))
            swept = swept.join(factor, key).withColumn("raked", F.col("raked") * F.col(f"__by_{d}"))
            moved = F.greatest(moved, F.abs(F.col(f"__by_{d}") - 1.0))
        after, seen = materialize_with(
            swept.withColumn("__moved", moved).select(*cells.columns, "raked", "__moved"),
            "mixing-sweep", {"moved": F.max("__moved")},
        )
        release(current)
        current = after
        if (seen.get("moved") or 0.0) < TOLERANCE:
            break
    ratio = F.try_divide("raked", "share")
    most = current.groupBy().agg(F.max(ratio).alias("most"))
    return current.drop("__moved").withColumn("probability", F.try_divide(ratio, most.scalar()))


def mixed(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, *, power: float = 0.9, seed: int = 17,
    topic: Column | None = None,
) -> DataFrame:
    """``docs`` with topic, probability and kept.

    ``targets`` maps a dimension to (category, target); a dimension left out is tempered with ``power``.
    """
    named = with_cells(docs, topic)
    cells = named.groupBy(*[f"__{d}" for d in DIMENSIONS]).agg(F.sum(token_count(F.col("text"))).alias("tokens"))
    cells = materialize(cells, "mixing-sums")
    targets = dict(targets or {})
    for d in DIMENSIONS:
        targets.setdefault(d, tempered(cells, d, power))
    keys = [f"__{d}" for d in DIMENSIONS]
    rates = materialize(raked(cells, targets).select(*keys, "probability"), "mixing-rates")
    # A cell per row: broadcast after a check of its size, salted for hot cells beyond it.
    rows = skew_join(named, rates, keys, "left", spread_by=["doc_id"])
    rows = rows.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.withColumn("kept", draw < F.col("probability")).drop(*keys)
