"""The identity graph as node and edge tables, and measures over it.

Searches run over a vertex dictionary (``numbered``): names are mapped once to dense 64-bit integers in
the order of the names, so that every round moves and groups longs, and the smallest number is the
smallest name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.operators import backward
from gatewarden.plans.durable import materialize, materialize_with, release
from gatewarden.plans.joins import skew_join
from gatewarden.plans.ranking import hashed_rank, ordered_rank
from gatewarden.schemas import Estate

NODE_TYPES = ("unknown", "subject", "permission", "resource")

MAX_MANAGER_HOPS = 20
#: Stored (source, vertex) rows of a batch of sources in betweenness.
PAIRS_PER_BATCH = 1 << 30


def node_id(kind: str, entity: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(entity) if isinstance(entity, str) else entity)


def permission_resources(estate: Estate) -> DataFrame:
    """Distinct (permission_id, resource_id) through resource strings or assignment scopes.

    A string names a resource by ARN or by name; that is two equi joins and a
    distinct union rather than one join on an OR. ``*`` and empty strings name
    nothing. All snapshots are seen, whatever order they arrived in.
    """
    kept = estate.derived("permission_resource")
    if kept is not None:
        return kept
    strings = (
        estate.permission.select(
            F.col("id").alias("permission_id"), F.explode("resources").alias("resource_string")
        )
        .where(~F.col("resource_string").isin("*", ""))
        .distinct()
    )
    by_arn = estate.resource.select(F.col("arn").alias("resource_string"), F.col("id").alias("resource_id"))
    by_name = estate.resource.select(F.col("name").alias("resource_string"), F.col("id").alias("resource_id"))
    named = skew_join(strings, by_arn.where(F.col("resource_string").isNotNull()), "resource_string").unionByName(
        skew_join(strings, by_name, "resource_string")
    )
    return named.select("permission_id", "resource_id").unionByName(scoped_resources(estate)).distinct()


def scoped_resources(estate: Estate) -> DataFrame:
    """Distinct (permission_id, resource_id) of assignments limited to a resource."""
    return (
        estate.assignment.where(F.col("resource_id").isNotNull() & (F.col("resource_id") != ""))
        .select("permission_id", "resource_id")
        .distinct()
    )


def manager_edges(estate: Estate) -> DataFrame:
    """(manager_id, subject_id) for every subject with a manager."""
    return estate.subject.where(F.col("manager_id") != "").select(
        "manager_id", F.col("id").alias("subject_id")
    )


def membership_edges(estate: Estate) -> DataFrame:
    """(subject_id, group_id) where the permission is a group that is also a subject."""
    groups = estate.permission.where(F.col("type") == "group").select(F.col("id").alias("permission_id"))
    group_subjects = groups.join(
        estate.subject.select(F.col("id").alias("permission_id")), "permission_id", "left_semi"
    )
    pairs = estate.assignment.select("subject_id", "permission_id").distinct()
    return skew_join(pairs, group_subjects, "permission_id", "left_semi").select(
        "subject_id", F.col("permission_id").alias("group_id")
    )


def edges(estate: Estate) -> DataFrame:
    """Distinct (src, dst, edge_type) with one edge per pair; inactive assignments included.

    A membership written after a manager edge replaces it.
    """
    named = lambda rows, names, source, kinds, target: rows.select(
        node_id(kinds[0], source).alias("src"), node_id(kinds[1], target).alias("dst"), names.alias("edge_type")
    )
    among = ("subject", "subject")
    ranked = named(manager_edges(estate), F.lit(1), "manager_id", among, "subject_id").unionByName(
        named(membership_edges(estate), F.lit(4), "subject_id", among, "group_id")
    )
    between = ranked.groupBy("src", "dst").agg(F.max("edge_type").alias("rank")).select(
        "src", "dst", F.when(F.col("rank") == 4, "member_of").otherwise("manages").alias("edge_type")
    )
    # Only links among subjects can meet; the others have no pair in common and are distinct in themselves.
    held = named(held_edges(estate), F.lit("has_permission"), "subject_id", ("subject", "permission"), "permission_id")
    granted = named(
        permission_resources(estate), F.lit("grants_access"), "permission_id", ("permission", "resource"), "resource_id"
    )
    return between.unionByName(held).unionByName(granted)


def declared_nodes(estate: Estate) -> DataFrame:
    """(node, code) of the entities that have a row; the code is the place in ``NODE_TYPES``."""
    parts = [
        getattr(estate, kind).select(node_id(kind, "id").alias("node"), F.lit(code).alias("code"))
        for code, kind in enumerate(NODE_TYPES)
        if code
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nodes(estate: Estate, edge_table: DataFrame | None = None) -> DataFrame:
    """Every node; endpoints without an entity row have type ``unknown``."""
    links = edges(estate) if edge_table is None else edge_table
    endpoints = links.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(0).alias("code"))
    tagged = endpoints.unionByName(declared_nodes(estate)).groupBy("node").agg(F.max("code").alias("code"))
    names = F.array(*[F.lit(t) for t in NODE_TYPES])
    return tagged.select("node", F.element_at(names, F.col("code") + 1).alias("node_type"))


@dataclass(frozen=True)
class Graph:
    """The graph over numbers, stored: the dictionary, the links, and how many vertices there are."""

    #: (vertex, node, node_type)
    vertices: DataFrame
    #: (src, dst, edge_type, from_subject, to_subject)
    links: DataFrame
    n: int
    #: Links from subjects to permissions, where all links go from subjects to subjects or permissions, or
    #: from permissions to resources; None where others do, or where nobody has looked.
    held: int | None = None

    def subjects(self) -> DataFrame:
        """(subject_id, vertex) of the subjects that have a row."""
        prefix = len("subject:")
        return self.vertices.where(F.col("node_type") == "subject").select(
            F.substr("node", F.lit(prefix + 1)).alias("subject_id"), "vertex"
        )

    def resources(self) -> DataFrame:
        """(resource_id, vertex) of the resources that have a row."""
        prefix = len("resource:")
        return self.vertices.where(F.col("node_type") == "resource").select(
            F.substr("node", F.lit(prefix + 1)).alias("resource_id"), "vertex"
        )


def numbered(estate: Estate, edge_table: DataFrame | None = None) -> Graph:
    """The estate's graph over a vertex dictionary. Names are joined twice per edge, here and never again."""
    named = materialize(edges(estate), "edges") if edge_table is None else edge_table
    ranked = ordered_rank(nodes(estate, named), "node").withColumnRenamed("place", "vertex")
    vertices, seen = materialize_with(ranked.select("vertex", "node", "node_type"), "vertices", {"n": F.count(F.lit(1))})
    release(ranked)
    from_subject, to_subject, from_permission, to_permission, to_resource = (
        F.startswith(c, F.lit(p))
        for c, p in (("src", "subject:"), ("dst", "subject:"), ("src", "permission:"), ("dst", "permission:"), ("dst", "resource:"))
    )
    layer = F.when(from_subject & to_subject, 0).when(from_subject & to_permission, 1).when(from_permission & to_resource, 2)
    links = named.select(
        "src", "dst", "edge_type", from_subject.alias("from_subject"), to_subject.alias("to_subject"), layer.alias("layer")
    )
    for end in ("src", "dst"):
        # A name has one row in the dictionary, so its side is hashed without sorting; a hot name's links are split
        # while running.
        key = vertices.select(F.col("node").alias(end), F.col("vertex").alias(f"{end}_vertex"))
        links = links.join(key.hint("shuffle_hash"), end).drop(end).withColumnRenamed(f"{end}_vertex", end)
    measures = {"held": F.count_if(F.col("layer") == 1), "odd": F.count_if(F.col("layer").isNull())}
    stored, counts = materialize_with(
        links.select("src", "dst", "edge_type", "from_subject", "to_subject", "layer"), "links", measures
    )
    if edge_table is None:
        release(named)
    held = None if counts.get("odd") else int(counts.get("held") or 0)
    return Graph(vertices, stored.drop("layer"), int(seen["n"] or 0), held)


def graph_statistics(estate: Estate, snapshots: DataFrame | None = None) -> DataFrame:
    """Long table (metric, value): nodes and edges in all and by type, entity and source counts.

    ``snapshots`` (source, extracted_at), if given, adds the number of extractions taken in.
    """
    links = edges(estate)
    by_node = nodes(estate, links).groupBy("node_type").agg(F.count(F.lit(1)).alias("value"))
    by_edge = links.groupBy("edge_type").agg(F.count(F.lit(1)).alias("value"))
    named_nodes = by_node.select(F.concat(F.lit("nodes:"), "node_type").alias("metric"), "value")
    named_edges = by_edge.select(F.concat(F.lit("edges:"), "edge_type").alias("metric"), "value")
    total_nodes = by_node.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("total_nodes").alias("metric"), "value"
    )
    total_edges = by_edge.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("total_edges").alias("metric"), "value"
    )
    out = named_nodes.unionByName(named_edges).unionByName(total_nodes).unionByName(total_edges)
    for entity in ("subject", "permission", "resource", "assignment", "escalation_path"):
        out = out.unionByName(
            getattr(estate, entity).agg(F.count(F.lit(1)).alias("value")).select(
                F.lit(f"{entity}s").alias("metric"), "value"
            )
        )
    sources = estate.subject.select("source").union(estate.permission.select("source"))
    counted = {"sources": sources}
    if snapshots is not None:
        counted["snapshots_ingested"] = snapshots.select("source", "extracted_at")
    for metric, rows in counted.items():
        out = out.unionByName(
            rows.distinct().agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")
        )
    return out.select("metric", F.col("value").cast("bigint").alias("value"))


def degree_centrality(estate: Estate, graph: Graph | None = None) -> DataFrame:
    """(subject_id, degree_centrality): (in + out) / (n - 1) over all nodes.

    A self-loop counts twice, n includes endpoints without an entity row, and a
    graph of one node scores 1.
    """
    graph = numbered(estate) if graph is None else graph
    degree = (
        graph.links.select(F.explode(F.array("src", "dst")).alias("vertex"))
        .groupBy("vertex")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    score = F.coalesce("degree", F.lit(0)).cast("double") / F.lit(max(graph.n - 1, 1))
    found = graph.subjects().join(degree, "vertex", "left")
    return found.select("subject_id", (F.lit(1.0) if graph.n <= 1 else score).alias("degree_centrality"))


def distance_to_critical(estate: Estate, graph: Graph | None = None) -> DataFrame:
    """(subject_id, distance_to_nearest_critical_resource); -1 where none is reachable.

    One breadth-first search backwards from all critical resources at once. Each
    level is stored; the search ends with the first empty level.
    """
    graph = numbered(estate) if graph is None else graph
    critical = estate.resource.where(F.col("sensitivity") == "critical").select(F.col("id").alias("resource_id"))
    start = graph.resources().join(critical, "resource_id", "left_semi").select("vertex", F.lit(0).alias("distance"))
    frontier, seen = materialize_with(start, "level", {"n": F.count(F.lit(1))})
    reached = frontier
    distance = 0
    while seen["n"]:
        distance += 1
        step = skew_join(graph.links.select("src", "dst"), frontier.select(F.col("vertex").alias("dst")), "dst", "left_semi")
        fresh = (
            step.select(F.col("src").alias("vertex"))
            .distinct()
            .join(reached.select("vertex"), "vertex", "left_anti")
            .withColumn("distance", F.lit(distance))
        )
        frontier, seen = materialize_with(fresh, "level", {"n": F.count(F.lit(1))})
        reached = reached.unionByName(frontier)
    return graph.subjects().join(reached, "vertex", "left").select(
        "subject_id", F.coalesce("distance", F.lit(-1)).alias("distance_to_nearest_critical_resource")
    )


def manager_depth(subject: DataFrame) -> DataFrame:
    """(subject_id, manager_depth): hops up the chain, at most 20.

    A manager without a row still counts one hop; the walk stops before a manager
    it has already left; a self-manager gives 1. Only subjects whose walk goes on
    stay in the table that is joined again.
    """
    managers = materialize(
        subject.where(F.col("manager_id").isNotNull()).select(
            F.col("id").alias("current"), "manager_id"
        ),
        "managers",
    )
    walking, seen = materialize_with(
        managers.select(
            F.col("current").alias("subject_id"),
            F.col("manager_id").alias("current"),
            F.array("current").alias("visited"),
        ),
        "walk",
        {"n": F.count(F.lit(1))},
    )
    finished = []
    hops = 1
    while seen["n"] and hops < MAX_MANAGER_HOPS:
        onward = (
            skew_join(walking, managers, "current")
            .where(~F.array_contains("visited", F.col("manager_id")))
            .select(
                "subject_id",
                F.col("manager_id").alias("current"),
                F.array_append("visited", F.col("current")).alias("visited"),
            )
        )
        following, seen = materialize_with(onward, "walk", {"n": F.count(F.lit(1))})
        finished.append(walking.select("subject_id", F.lit(hops).alias("hops")))
        walking = following
        hops += 1
    finished.append(walking.select("subject_id", F.lit(hops).alias("hops")))
    walked = finished[0]
    for part in finished[1:]:
        walked = walked.unionByName(part)
    depth = walked.groupBy("subject_id").agg(F.max("hops").alias("manager_depth"))
    return subject.select(F.col("id").alias("subject_id")).join(depth, "subject_id", "left").select(
        "subject_id", F.coalesce("manager_depth", F.lit(0)).alias("manager_depth")
    )


def held_edges(estate: Estate) -> DataFrame:
    """Distinct (subject_id, permission_id) of all assignments, active or not."""
    kept = estate.derived("held_edge")
    if kept is not None:
        return kept
    return estate.assignment.select("subject_id", "permission_id").distinct()


def resource_words(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """Resources that permissions lead to, as bit sets: (permission_id, word, bits) and (word, bit, resource columns).

    Resources are numbered in the order of a hash of the smallest permission that leads to them, so those that
    a permission grants together share words of 64 bits. A set of resources is then a few longs, which are
    or-ed by hash aggregates (byte bitmaps would have to be sorted, 4 kB a row).
    """
    links = permission_resources(estate)
    if estate.derived("permission_resource") is None:
        links = materialize(links, "permission-resources")
    lead = links.groupBy("resource_id").agg(F.min(F.xxhash64("permission_id")).alias("lead"))
    info = estate.resource.select(F.col("id").alias("resource_id"), "name", "type", "sensitivity", "source")
    known = skew_join(info, lead, "resource_id")
    # A sortable text: the hash without its sign, then the id.
    order = F.concat(F.lpad(F.hex("lead"), 16, "0"), F.lit(" "), F.col("resource_id"))
    placed = ordered_rank(known.withColumn("__order", order), "__order")
    bit = F.pmod("place", F.lit(64)).cast("int")
    dictionary = materialize(
        placed.select(
            F.floor(F.col("place") / 64).alias("word"), bit.alias("bit"), "resource_id", "name", "type", "sensitivity", "source"
        ),
        "resource-words",
    )
    numbers = dictionary.select("resource_id", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    sets = skew_join(links, numbers, "resource_id").groupBy("permission_id", "word").agg(F.bit_or("bits").alias("bits"))
    return materialize(sets, "permission-words"), dictionary


def reached_words(estate: Estate, sets: DataFrame) -> DataFrame:
    """(subject_id, word, bits): the resources of every subject through all its permissions, inactive assignments included."""
    return (
        skew_join(held_edges(estate), sets, "permission_id")
        .groupBy("subject_id", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def reachable_resources(estate: Estate) -> DataFrame:
    """One row per subject and distinct resource it reaches through a permission, with what the resource is.

    (subject_id, resource_id, name, type, sensitivity, source); inactive assignments count. Bits become rows
    only after the sets have been or-ed.
    """
    sets, dictionary = resource_words(estate)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    single = reached_words(estate, sets).select("subject_id", "word", F.explode(bits).alias("bit"))
    return skew_join(single, dictionary, ["word", "bit"]).drop("word", "bit")


def critical_resources(estate: Estate) -> DataFrame:
    """One row per subject, permission and critical resource it leads to: a resource appears once per permission.

    (subject_id, permission_id, resource_id, name, type, source)
    """
    critical = estate.resource.where(F.col("sensitivity") == "critical").select(
        F.col("id").alias("resource_id"), "name", "type", "source"
    )
    led = skew_join(permission_resources(estate), critical, "resource_id")
    return skew_join(held_edges(estate), led, "permission_id")


def escalation_resources(estate: Estate) -> DataFrame:
    """One row per escalation path of a subject: (subject_id, path_id, end_result, confidence, steps)."""
    return estate.escalation_path.select(
        "subject_id", F.col("id").alias("path_id"), "end_result", "confidence", F.size("steps").alias("steps")
    )


def blast_radius(estate: Estate) -> DataFrame:
    """Reach of every subject: distinct resources, critical ones, escalation paths, total.

    ``critical_resources`` counts a resource once per permission that leads to it
    (it is summed over permissions, not over distinct resources).
    """
    sets, dictionary = resource_words(estate)
    grave = (
        dictionary.where(F.col("sensitivity") == "critical")
        .groupBy("resource_id")
        .agg(F.min(F.struct("word", "bit")).alias("at"))
        .groupBy("at.word")
        .agg(F.bit_or(F.expr("shiftleft(1L, at.bit)")).alias("grave"))
    )
    # A permission's sets hold a resource once, so its critical resources are counted there, and both numbers of a
    # subject come from one pass over what it holds.
    counted = skew_join(sets, grave, "word", "left").select(
        "permission_id", "word", "bits",
        F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("grave"))), F.lit(0)).cast("bigint").alias("critical"),
    )
    direct = (
        skew_join(held_edges(estate), counted, "permission_id")
        .groupBy("subject_id", "word")
        .agg(F.bit_or("bits").alias("bits"), F.sum("critical").alias("critical"))
        .groupBy("subject_id")
        .agg(
            F.sum(F.bit_count("bits")).cast("bigint").alias("direct_resources"),
            F.sum("critical").alias("critical_resources"),
        )
    )
    paths = estate.escalation_path.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("escalation_resources")
    )
    zero = F.lit(0).cast("bigint")
    return (
        estate.subject.select(F.col("id").alias("subject_id"))
        .join(direct, "subject_id", "left")
        .join(paths, "subject_id", "left")
        .select(
            "subject_id",
            F.coalesce("direct_resources", zero).alias("direct_resources"),
            F.coalesce("critical_resources", zero).alias("critical_resources"),
            F.coalesce("escalation_resources", zero).alias("escalation_resources"),
        )
        .withColumn("total_reach", F.col("direct_resources") + F.col("escalation_resources"))
    )


def pivots_for(error: float, n: int, failure: float = 0.01) -> int:
    """Sampled sources that keep every vertex's normalised betweenness within ``error`` with probability 1 - ``failure``.

    A source contributes between 0 and 1 (its dependency over n - 2), so by Hoeffding's inequality and a union
    over n vertices ln(2 n / failure) / (2 error^2) sources suffice; n / (n - 1), the step from sources to pairs,
    is covered by scaling the error.
    """
    scaled = error * (n - 1) / n
    return min(n, math.ceil(math.log(2 * n / failure) / (2 * scaled * scaled)))


def _path_sources(graph: Graph) -> tuple[DataFrame, int]:
    """(source, place) of the vertices from which a path can lead through a subject, and how many they are.

    Such a path enters the subject by an edge. Where all edges into subjects leave subjects, its
    source is a subject with an edge to a subject too; otherwise every vertex is taken.
    """
    entering = graph.links.where(F.col("to_subject") & (F.col("src") != F.col("dst")))
    starts, seen = materialize_with(
        entering.groupBy(F.col("src").alias("source")).agg(F.bool_and("from_subject").alias("inside")), "path-sources",
        {"others": F.count_if(~F.col("inside")), "n": F.count(F.lit(1))},
    )
    if seen.get("others"):
        return graph.vertices.select(F.col("vertex").alias("source"), F.col("vertex").alias("place")), graph.n
    return ordered_rank(starts.select("source"), "source"), int(seen["n"] or 0)


def _dependencies(links: DataFrame, sources: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(vertex, delta) added up over the given sources, and the stored tables it reads.

    Shortest-path counts are pushed forward level by level (rows: source, vertex, sigma), then
    dependencies are pulled back over the same levels.
    """
    start = sources.select("source", F.col("source").alias("vertex"), F.lit(1.0).alias("sigma"))
    frontier, seen = materialize_with(start, "paths", {"n": F.count(F.lit(1))})
    levels, visited, held = [frontier], frontier.select("source", "vertex"), [frontier]
    while seen["n"]:
        onward = skew_join(links, frontier.select(F.col("vertex").alias("src"), "source", "sigma"), "src")
        fresh = (
            onward.groupBy("source", F.col("dst").alias("vertex"))
            .agg(F.sum("sigma").alias("sigma"))
            .join(visited, ["source", "vertex"], "left_anti")
        )
        frontier, seen = materialize_with(fresh, "paths", {"n": F.count(F.lit(1))})
        held.append(frontier)
        if seen["n"]:
            levels.append(frontier)
            visited = visited.unionByName(frontier.select("source", "vertex"))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    totals = None
    for level in reversed(levels[1:-1]):
        shares = below.select(
            "source", F.col("vertex").alias("dst"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("share")
        )
        parents = skew_join(links, level.select("source", F.col("vertex").alias("src"), "sigma"), "src")
        gained = (
            parents.join(shares, ["source", "dst"])
            .groupBy("source", F.col("src").alias("vertex"))
            .agg(F.sum(F.col("sigma") * F.col("share")).alias("gained"))
        )
        below = materialize(
            level.join(gained, ["source", "vertex"], "left").select(
                "source", "vertex", "sigma", F.coalesce("gained", F.lit(0.0)).alias("delta")
            ),
            "dependencies",
        )
        held.append(below)
        part = below.groupBy("vertex").agg(F.sum("delta").alias("delta"))
        totals = part if totals is None else totals.unionByName(part)
    return totals, held


def betweenness_centrality(
    estate: Estate,
    graph: Graph | None = None,
    *,
    error: float | None = None,
    failure: float = 0.01,
    seed: int = 7,
    pairs_per_batch: int | None = None,
) -> DataFrame:
    """(subject_id, betweenness_centrality), directed, normalised by (n-1)(n-2).

    Exact by default: paths are followed back from all their ends (``backward``). Where other links exist than
    those of ``edges``, or links among subjects are too many to be sent to every worker, or
    ``pairs_per_batch`` is given, it goes by sources instead, those whose paths can pass through a subject at
    all (managers and members of groups), in batches of ``pairs_per_batch`` / n, so the stored (source,
    vertex) rows never pass that number; each batch adds its sums to a stored total and is deleted. With
    ``error`` a seeded sample of ``pivots_for(error, n, failure)`` vertices stands for all sources.
    """
    graph = numbered(estate) if graph is None else graph
    n = graph.n
    nothing = graph.subjects().select("subject_id", F.lit(0.0).alias("betweenness_centrality"))
    if n <= 2:
        return nothing
    sampled = error is not None and pivots_for(error, n, failure) < n
    if graph.held is not None and not sampled and pairs_per_batch is None:
        total = backward.dependency_sums(graph.links.where(F.col("src") != F.col("dst")), graph.held)
        if total is not None:
            return _scored(graph, total, 1.0)
    pairs_per_batch = pairs_per_batch or PAIRS_PER_BATCH
    sources, many = _path_sources(graph)
    scale = 1.0
    if sampled:
        pivots = pivots_for(error, n, failure)
        placed = hashed_rank(graph.vertices.select(F.col("vertex").alias("source")), "source", seed)
        sources = placed.select("source", (F.col("place") - 1).alias("place")).where(F.col("place") < pivots)
        many, scale = pivots, n / pivots
    sources = materialize(sources, "path-sources")
    links = graph.links.where(F.col("src") != F.col("dst")).select("src", "dst")
    per_batch = max(1, pairs_per_batch // n)
    total = None
    for first in range(0, many, per_batch):
        batch = sources.where((F.col("place") >= first) & (F.col("place") < first + per_batch)).select("source")
        part, held = _dependencies(links, batch)
        if part is not None:
            both = part if total is None else part.unionByName(total)
            following = materialize(both.groupBy("vertex").agg(F.sum("delta").alias("delta")), "betweenness")
            if total is not None:
                release(total)
            total = following
        for table in held:
            release(table)
    if total is None:
        return nothing
    return _scored(graph, total, scale)


def _scored(graph: Graph, total: DataFrame, scale: float) -> DataFrame:
    factor = scale / ((graph.n - 1) * (graph.n - 2))
    return graph.subjects().join(total, "vertex", "left").select(
        "subject_id",
        F.coalesce(F.col("delta") * F.lit(factor), F.lit(0.0)).alias("betweenness_centrality"),
    )
