"""The text pipeline: languages, near-copies, repeated passages, mixture, tokens.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns the
documents that stay, the last one their tokens. ``run`` applies them to ``documents``, each
stage's result stored in the shared folder and read again as the next one's input.

No SQL can express the whole (``ORACLE_SQL`` is None); tests hold every stage against a plain
version on small tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewarden.llm import byte_bpe, language_id, mixing, simhash, substrings
from gatewarden.llm.workers import importable
from gatewarden.plans.durable import materialize

RANKS = "byte_bpe_50k.tiktoken"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter at all, or two languages too close to tell."""
    importable(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predicted(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that overlap by 0.8 or more of their 5-word shingles the smallest doc_id stays."""
    importable(spark)
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words or more that a document with a smaller doc_id holds; drop what is left empty by it."""
    importable(spark)
    cut = substrings.deduplicated(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn(
            "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    return cut.where(~emptied).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample so that expected tokens follow the raked shares of source, language and topic."""
    importable(spark)
    return mixing.mixed(docs).where(F.col("kept")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text; a text that decoding does not give back fails the job (``byte_bpe.Codec.run``)."""
    importable(spark)
    found = byte_bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == text).alias("exact"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
