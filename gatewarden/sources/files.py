"""Files below a folder: listed without their content, remembered in a manifest, and big JSON documents read in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gatewarden.functions.scalars import as_of_lit, iso_timestamp
from gatewarden.plans.durable import materialize

#: One row per log file: the moments of its first and last dated event, and how many events it holds.
MANIFEST = "feed string, file string, first_at timestamp, last_at timestamp, events long"


def listed_files(spark: SparkSession, path: str, pattern: str = r"\.json(\.gz)?$") -> DataFrame:
    """(file) of all files below a folder; nothing of their content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file")).where(F.col("file").rlike(pattern))


def first_files(spark: SparkSession, path: str, count: int, pattern: str = r"\.json(\.gz)?$") -> list[str]:
    """The first ``count`` files by path."""
    return [r.file for r in listed_files(spark, path, pattern).orderBy("file").limit(count).collect()]


def metadata_path() -> Column:
    """The file of a row, as a plain path: the metadata column is a URI, in which a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def log_manifest(
    spark: SparkSession, path: str, feed: str, schema: str, time_column: str, known: DataFrame | None = None
) -> DataFrame:
    """Manifest rows of the log files below ``path`` that ``known`` does not have yet; each is read once, for its times.

    Append the result to the stored manifest. Log files do not change once they are there.
    """
    files = listed_files(spark, path, r".")
    if known is not None:
        files = files.join(known.where(F.col("feed") == feed).select("file"), "file", "left_anti")
    fresh = [r.file for r in files.collect()]
    if not fresh:
        return spark.createDataFrame([], MANIFEST)
    at = iso_timestamp(F.col(time_column))
    events = spark.read.schema(schema).json(fresh).select(metadata_path().alias("file"), at.alias("at"))
    found = events.groupBy("file").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("events")
    )
    return materialize(found.select(F.lit(feed).alias("feed"), "file", "first_at", "last_at", "events"), "manifest")


def read_by_manifest(
    spark: SparkSession, manifest: DataFrame, feed: str, schema: str, time_column: str, since: str, until: str
) -> DataFrame:
    """Events of a closed time range, from the files that can hold any; others are never opened."""
    inside = (
        (F.col("feed") == feed) & (F.col("last_at") >= as_of_lit(since)) & (F.col("first_at") <= as_of_lit(until))
    )
    wanted = [r.file for r in manifest.where(inside).select("file").distinct().collect()]
    if not wanted:
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    events = spark.read.schema(schema).json(wanted)
    return events.where(iso_timestamp(F.col(time_column)).between(as_of_lit(since), as_of_lit(until)))


def split_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, broken) of JSON objects ``{"key": [...], ...}`` of any size, one object per file.

    entries: (file, key, items) with ``items`` the list's JSON. Files are read by byte ranges, a piece ending at
    each closing bracket, so one document feeds many tasks and no piece is larger than its list. A closing
    bracket inside a text cuts a list in two; then neither part is a list, and the file is named in ``broken`` for a
    reader of whole files. A list within a list is broken in the same way.
    """
    pieces = spark.read.option("lineSep", "]").text(path).select(metadata_path().alias("file"), "value")
    head = r'(?s)^\s*[{,]\s*("(?:[^"\\]|\\.)*")\s*:\s*(\[.*)$'
    key, items = F.regexp_extract("value", head, 1), F.concat(F.regexp_extract("value", head, 2), F.lit("]"))
    parsed = pieces.select("file", "value", key.alias("name"), items.alias("items"))
    whole = (F.col("name") != "") & F.try_parse_json("items").isNotNull()
    # What follows the last list closes the object; an object without lists is one piece.
    closing = F.rlike("value", F.lit(r"^\s*(\{\s*)?\}?\s*$"))
    judged = parsed.select("file", "name", "items", whole.alias("whole"), closing.alias("closing"))
    broken = judged.where(~F.col("whole") & ~F.col("closing")).select("file").distinct()
    text = F.try_variant_get(F.try_parse_json("name"), "$", "string")
    return judged.where("whole").select("file", text.alias("key"), "items"), broken
