"""Resolve the same person across systems and compare their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.plans.durable import materialize, materialize_with, release
from gatewarden.plans.joins import skew_join
from gatewarden.plans.ranking import ordered_rank

WHITESPACE = " \t\n\r\x0b\x0c"
MAX_ROUNDS = 60


def stripped_lower(text: Column) -> Column:
    return F.btrim(F.lower(text), F.lit(WHITESPACE))


def subject_numbers(subject: DataFrame) -> DataFrame:
    """(subject_id, vertex) of every non-group subject: dense numbers in the order of the ids, stored."""
    people = subject.where(F.col("type") != "group").select(F.col("id").alias("subject_id")).distinct()
    return materialize(ordered_rank(people, "subject_id").withColumnRenamed("place", "vertex"), "subject-numbers")


def identity_keys(subject: DataFrame) -> DataFrame:
    """(subject_id, source, key): normalised mail address and name of each non-group subject."""
    mail = F.when(F.col("email") != "", F.concat(F.lit("mail:"), stripped_lower(F.col("email"))))
    bare = F.replace(stripped_lower(F.col("display_name")), F.lit("  "), F.lit(" "))
    name = F.when(bare != "", F.concat(F.lit("name:"), bare))
    return (
        subject.where(F.col("type") != "group")
        .select(F.col("id").alias("subject_id"), "source", F.explode(F.array(mail, name)).alias("key"))
        .where(F.col("key").isNotNull())
    )


def identity_links(subject: DataFrame, numbers: DataFrame) -> DataFrame:
    """Links (u, v) with v < u, over ``subject_numbers``, that tie subjects sharing a key.

    A shared mail address always links. A shared name links only when its bearers
    come from more than one source. Each key gives one link per bearer (to the
    bearer with the smallest id), so a placeholder address used by a third of all
    subjects costs a third of the subjects in links, not their square.
    """
    named = identity_keys(subject).join(numbers, "subject_id")
    keys = materialize(named.select("vertex", F.xxhash64("source").alias("origin"), "key"), "identity-keys")
    shared = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("bearers"),
        F.min("origin").alias("first_origin"),
        F.max("origin").alias("last_origin"),
        F.min("vertex").alias("v"),
    )
    linking = (
        shared.where(F.col("bearers") > 1)
        .where(F.startswith("key", F.lit("mail:")) | (F.col("first_origin") != F.col("last_origin")))
        .select("key", "v")
    )
    return (
        skew_join(keys.select("key", F.col("vertex").alias("u")), linking, "key")
        .where(F.col("u") != F.col("v"))
        .select("u", "v")
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a vertex to the smallest vertex around it."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        skew_join(both.where(F.col("v") > F.col("u")), smallest, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a vertex and its smaller neighbours to the smallest of them."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    return (
        skew_join(links, smallest, "u")
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("link")
        )
        .select("link.*")
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component_id) for every linked vertex; the id is the smallest vertex.

    Alternates the two star operations, which takes a number of rounds that is
    logarithmic in the component size, so long chains are no problem. Each round
    is stored; the count and a checksum of the links, taken while writing, tell
    when nothing changes any more.
    """
    measures = {
        "n": F.count(F.lit(1)),
        "xor": F.expr("bit_xor(xxhash64(u, v))"),
        "total": F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))"),
    }
    current, before = materialize_with(links, "links", measures)
    for _ in range(MAX_ROUNDS):
        wide = materialize(_large_star(current), "large-star")
        after_table, after = materialize_with(_small_star(wide), "small-star", measures)
        release(current)
        release(wide)
        current = after_table
        if after == before:
            vertices = current.select(F.col("u").alias("vertex"), F.col("v").alias("component_id"))
            centres = current.select(F.col("v").alias("vertex"), F.col("v").alias("component_id"))
            return vertices.union(centres.distinct())
        before = after
    raise RuntimeError("connected components did not settle")


def identity_components(subject: DataFrame) -> DataFrame:
    """(subject_id, component_id) of every non-group subject; alone = own id."""
    numbers = subject_numbers(subject)
    found = connected_components(identity_links(subject, numbers)).withColumnRenamed("component_id", "centre")
    centres = numbers.select(F.col("subject_id").alias("component_id"), F.col("vertex").alias("centre"))
    placed = numbers.join(found, "vertex", "left").withColumn("centre", F.coalesce("centre", "vertex"))
    return skew_join(placed, centres, "centre").select("subject_id", "component_id")


def correlated_members(subject: DataFrame) -> DataFrame:
    """Members of the components that span more than one source.

    Columns: component_id, subject_id, source, type, status, department,
    display_name, email, ingest_seq, sources (sorted), source_count. ``sources``
    has one entry per source system; members stay one per row, however many.
    """
    facts = subject.select(
        F.col("id").alias("subject_id"), "source", "type", "status", "department",
        "display_name", "email", "ingest_seq",
    )
    members = materialize(identity_components(subject).join(facts, "subject_id"), "members")
    spans = (
        members.groupBy("component_id", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("component_id")
        .agg(
            F.array_sort(F.collect_set("source")).alias("sources"),
            F.count(F.lit(1)).alias("source_count"),
            F.sum("n").alias("member_count"),
        )
        .where(F.col("source_count") > 1)
    )
    return materialize(skew_join(members, spans, "component_id"), "correlated")


def component_summary(members: DataFrame) -> DataFrame:
    """One row per correlated identity: member, mail and name counts and its sources."""
    return members.groupBy("component_id").agg(
        F.first("sources").alias("sources"),
        F.count(F.lit(1)).alias("subjects"),
        F.countDistinct(F.when(F.col("email") != "", F.col("email"))).alias("emails"),
        F.countDistinct("display_name").alias("names"),
    )


def component_values(members: DataFrame) -> DataFrame:
    """Distinct mail addresses and names of each correlated identity, one per row."""
    mails = members.where(F.col("email") != "").select(
        "component_id", F.lit("email").alias("kind"), F.col("email").alias("value")
    )
    names = members.select("component_id", F.lit("name").alias("kind"), F.col("display_name").alias("value"))
    return mails.union(names).distinct()


def cross_system_subjects(members: DataFrame) -> DataFrame:
    """Subjects seen in several systems, with the systems."""
    return members.select("subject_id", "component_id", "sources", "source_count")


def singletons(subject: DataFrame, members: DataFrame) -> DataFrame:
    """Subjects outside every correlated identity, group subjects included."""
    return subject.select(F.col("id").alias("subject_id"), "source").join(
        members.select("subject_id"), "subject_id", "left_anti"
    )


def identity_units(subject: DataFrame, members: DataFrame) -> DataFrame:
    """(subject_id, unit_id): correlated identity, or the subject itself."""
    return (
        subject.select(F.col("id").alias("subject_id"))
        .join(members.select("subject_id", "component_id"), "subject_id", "left")
        .select("subject_id", F.coalesce("component_id", "subject_id").alias("unit_id"))
    )


def values_by_source(members: DataFrame) -> DataFrame:
    """Per correlated identity and source: the last subject's status, department and name."""
    order = F.struct("ingest_seq", "subject_id")
    has_department = F.col("department") != ""
    return members.groupBy("component_id", "source").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("department", F.when(has_department, order)).alias("department"),
        F.max_by(stripped_lower(F.col("display_name")), order).alias("name"),
    )


def inconsistency_profile(members: DataFrame) -> DataFrame:
    """What differs between the systems of each correlated identity.

    The arrays hold at most one entry per source system.
    """
    by_source = values_by_source(members)
    return by_source.groupBy("component_id").agg(
        F.countDistinct("status").alias("statuses"),
        F.count("department").alias("department_sources"),
        F.countDistinct("department").alias("departments"),
        F.countDistinct("name").alias("names"),
        F.array_sort(F.collect_list("source")).alias("sources"),
        F.array_sort(
            F.collect_list(F.when(F.col("department").isNotNull(), F.col("source")))
        ).alias("sources_with_department"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "deleted", F.col("source")))).alias("deleted_in"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "active", F.col("source")))).alias("active_in"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "status")))).alias("status_by_source"),
        F.map_from_entries(
            F.filter(
                F.array_sort(F.collect_list(F.struct("source", "department"))),
                lambda e: e["department"].isNotNull(),
            )
        ).alias("department_by_source"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "name")))).alias("name_by_source"),
    )


def consistency_scores(members: DataFrame) -> DataFrame:
    """Consistency score of each correlated identity (1 = records agree)."""
    name = stripped_lower(F.col("display_name"))
    department = F.nullif(F.col("department"), F.lit(""))

    def differs(value: Column) -> Column:
        return F.coalesce(F.min(value) != F.max(value), F.lit(False))

    return members.groupBy("component_id").agg(
        F.greatest(
            F.lit(0.0),
            F.lit(1.0)
            - F.when(differs(F.col("status")), 0.4).otherwise(0.0)
            - F.when(differs(department), 0.3).otherwise(0.0)
            - F.when(differs(name), 0.2).otherwise(0.0),
        ).alias("cross_system_consistency_score")
    )
