"""URL verdicts from host and path rules, and from a logistic regression where no rule fits.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: from there
up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and all subdomains if the path
starts with the rule's; the longest rule wins. The regression sees hashed character n-grams
of host and path (digits alike, host and path apart) and is trained from a small labelled table.

The table is small (``TRAINING_ROWS`` at most), so the regression is fitted in the driver; URLs are
judged by DataFrame functions, with the 2 to the ``HASH_BITS`` weights as a broadcast row.

Defined results
    null url, no ://       host and path empty, no rule; verdict of the regression on nothing
    no labelled row, or one class only    URLs without a rule are allowed, or all get that class
    repeated rows          each judged alone
    extra columns          kept; host, path, rule, p_block and verdict of the input are replaced
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_BITS = 14
GRAMS = (3, 4, 5)
#: Rows of the labelled table that are used, smallest hashes first.
TRAINING_ROWS = 3000

#: A small hand-labelled table of hosts and paths (fixed values).
LABELLED = (
    ("https://www.spam-farm.example.org/en/100/", "block"),
    ("http://spam-farm.example.net/offers", "block"),
    ("https://m.link-farm.example.com/de/20.html", "block"),
    ("https://casino-bonus.example.org/play", "block"),
    ("http://www.free-casino.example.net/en/55", "block"),
    ("https://cheap-pills.example.com/buy/now", "block"),
    ("https://adult-cams.example.net/live", "block"),
    ("http://m.adult-x.example.org/fr/7", "block"),
    ("https://xxx-video.example.com/es/9", "block"),
    ("https://ads.tracker.example.org/click?id=1", "block"),
    ("https://ads-track.example.net/en/31#top", "block"),
    ("http://blog.win-prizes.example.com/claim", "block"),
    ("https://download-crack.example.org/keygen", "block"),
    ("https://free-bets.example.net/slots/", "block"),
    ("http://www.casino-win.example.com/en/640", "block"),
    ("https://www.gardening.example.org/en/12", "allow"),
    ("https://blog.gardening.example.net/de/4711/", "allow"),
    ("http://citylibrary.example.com/catalogue/", "allow"),
    ("https://m.weather.example.org/de/1200.html", "allow"),
    ("https://news.example.net/fr/2024?page=2", "allow"),
    ("https://www.news.example.com/en/38250/", "allow"),
    ("http://docs.project.example.org/guide/install", "allow"),
    ("https://university.example.net/es/917#top", "allow"),
    ("https://blog.museum.example.org/fr/80", "allow"),
    ("https://recipes.example.com/es/311.html", "allow"),
    ("http://www.recipes.example.net/en/22366", "allow"),
    ("https://wiki.example.org/en/4091?utm_source=feed", "allow"),
    ("https://m.forum.example.net/de/33", "allow"),
    ("http://blog.letters.example.com/en/17/", "allow"),
    ("https://history.example.org/de/6512", "allow"),
    ("https://www.theatre.example.net/fr/150/", "allow"),
    ("https://m.transport.example.com/es/48", "allow"),
    ("http://northern.example.org/en/29043.html", "allow"),
    ("https://blog.another.example.net/en/771?page=2", "allow"),
    ("https://station.example.com/de/1001#top", "allow"),
    ("https://www.heather.example.org/es/65", "allow"),
    ("http://m.thinkers.example.net/fr/902", "allow"),
    ("https://ration.example.org/en/5", "allow"),
    ("https://blog.reading.example.com/fr/12345/", "allow"),
)

Rule = tuple[str, str]


def labelled(spark: SparkSession, rows: Sequence[tuple[str, str]] = LABELLED) -> DataFrame:
    """The hand-labelled table as (url, label)."""
    return spark.createDataFrame([tuple(r) for r in rows], "url string, label string")


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER),
            "path": F.regexp_extract(url, pattern, 2),
        }
    )


def _winner(rules: Sequence[Rule], value) -> Column:
    """``value(verdict, rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    # Tried from the longest to the shortest, so built from the shortest.
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(
            F.col("path"), F.lit(slash + path)
        )
        found = F.when(fits, F.lit(value(verdict, rule))).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` with host, path, the rule that decides (or null) and its verdict (or null)."""
    parts = with_parts(pages)
    return parts.withColumns(
        {"rule": _winner(rules, lambda _, rule: rule), "verdict": _winner(rules, lambda verdict, _: verdict)}
    )


def with_grams(parts: DataFrame) -> DataFrame:
    """``__grams``: the distinct hashed n-grams of host and path."""
    # Characters are taken from an array, so a long URL costs time in proportion to its length.
    split = {
        f"__{kind}": F.split(F.concat(F.lit("^"), F.regexp_replace(kind, "[0-9]", "0"), F.lit("$")), "")
        for kind in ("host", "path")
    }
    grams = []
    for name in split:
        for size in GRAMS:
            following = ", ".join(f"get({name}, i + {j})" for j in range(1, size))
            gram = f"xxhash64('{name[2]}', concat(c, {following}))"
            grams.append(
                F.expr(
                    f"transform(slice({name}, 1, greatest(size({name}) - {size - 1}, 0)), "
                    f"(c, i) -> cast(pmod({gram}, {1 << HASH_BITS}) as int))"
                )
            )
    return parts.withColumns(split).withColumn("__grams", F.array_distinct(F.concat(*grams))).drop(*split)


def fit(grams: list[list[int]], blocked: list[bool], passes: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of hashed n-grams (adaptive gradient steps)."""
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    column = np.concatenate([np.array(g, np.int64) for g in grams])
    target = np.array(blocked, float)
    # Long URLs have more n-grams; all count alike.
    scale = 1.0 / np.sqrt(np.bincount(row, minlength=len(grams)))
    weights, bias = np.zeros(1 << HASH_BITS), 0.0
    pace, bias_pace = np.full(len(weights), 1e-8), 1e-8
    for _ in range(passes):
        margin = np.bincount(row, weights=weights[column], minlength=len(grams)) * scale + bias
        push = (target - 1.0 / (1.0 + np.exp(-margin))) / len(grams)
        step = np.bincount(column, weights=(push * scale)[row], minlength=len(weights)) - penalty * weights / len(grams)
        pace += step**2
        bias_pace += push.sum() ** 2
        weights += 0.3 * step / np.sqrt(pace)
        bias += 0.3 * push.sum() / np.sqrt(bias_pace)
    return weights, float(bias)


def judged(pages: DataFrame, rules: Sequence[Rule], table: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule, p_block and verdict; ``table`` (url, label) trains the regression."""
    pages = pages.drop("host", "path", "rule", "p_block", "verdict")
    known = (
        table.where(F.col("url").isNotNull() & F.col("label").isin("allow", "block"))
        .select("url", (F.col("label") == "block").alias("__blocked"))
        .orderBy(F.xxhash64("url"), "url", "__blocked")
        .limit(TRAINING_ROWS)
    )
    known = with_grams(with_parts(known)).select("__grams", "__blocked").collect()
    ruled = with_rules(pages, rules)
    if len({r["__blocked"] for r in known}) < 2:
        rows = ruled.withColumn("p_block", F.lit(float(any(r["__blocked"] for r in known))))
    else:
        weights, bias = fit([r["__grams"] for r in known], [r["__blocked"] for r in known])
        model = pages.sparkSession.createDataFrame([(0, weights.tolist())], "__model int, __weights array<double>")
        rows = with_grams(ruled).withColumn("__model", F.lit(0)).join(F.broadcast(model), "__model")
        total = F.expr("aggregate(__grams, 0D, (s, g) -> s + __weights[g])")
        margin = total / F.sqrt(F.greatest(F.size("__grams"), F.lit(1))) + F.lit(bias)
        rows = rows.withColumn("p_block", 1.0 / (1.0 + F.exp(-margin))).drop("__grams", "__model", "__weights")
    by_model = F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce("verdict", by_model))
