"""Features taken from activity events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.scalars import as_of_lit, fixed_map, whole_days
from gatewarden.operators.access import holders, subject_actions
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate

# Log source -> identity source its actors belong to; other logs match any source.
LOG_FAMILIES = {"aws_cloudtrail": "aws_iam", "okta_syslog": "okta", "entra_audit": "entra"}
LOGIN = "auth.login"


def actor_subjects(subject: DataFrame) -> DataFrame:
    """(actor_id, family, subject_id): the names by which events of a log family mean a subject.

    Besides its id in the source a subject is known by the last part of its ARN (user or role
    name), its mail address, and the login or principal name among its attributes. Addresses
    match in any case. A name that several subjects of a family bear, other than an id, means none.
    """
    attribute = lambda name: F.get_json_object("attributes", f"$.{name}")
    arn_name = F.when(
        F.startswith("external_id", F.lit("arn:")) & F.contains("external_id", F.lit("/")),
        F.element_at(F.split("external_id", "/"), -1),
    )
    names = F.array(
        F.struct(F.col("external_id").alias("name"), F.lit(True).alias("is_id")),
        *[
            F.struct(name.alias("name"), F.lit(False).alias("is_id"))
            for name in (
                arn_name, F.col("email"), attribute("login"), attribute("user_principal_name"),
                attribute("userPrincipalName"), attribute("app_id"),
            )
        ],
    )
    known = (
        subject.select(F.col("id").alias("subject_id"), "source", F.explode(names).alias("known"))
        .select("subject_id", "source", actor_key(F.col("known.name")).alias("actor_id"), "known.is_id")
        .where(F.col("actor_id") != "")
        .withColumn("family", F.explode(F.array("source", F.lit("*"))))
    )
    bearers = known.groupBy("actor_id", "family").agg(
        F.min("subject_id").alias("first"), F.max("subject_id").alias("last"), F.bool_or("is_id").alias("has_id"),
    )
    alone = bearers.where((F.col("first") == F.col("last")) & ~F.col("has_id")).select(
        "actor_id", "family", F.col("first").alias("subject_id")
    )
    ids = known.where("is_id").select("actor_id", "family", "subject_id")
    return ids.unionByName(alone)


def actor_key(name: Column) -> Column:
    """Addresses in lower case without outer blanks, other names as they are."""
    return F.when(F.contains(name, F.lit("@")), F.lower(F.btrim(name))).otherwise(name)


def event_action(events: DataFrame) -> Column:
    """``service:Event`` of an event; profiles that name the event alone have the service in the payload."""
    name = F.col("raw_event_name")
    service = F.substring_index(F.get_json_object("raw_payload", "$.eventSource"), ".", 1)
    bare = (F.col("source") == "aws_cloudtrail") & ~F.contains(name, F.lit(":")) & (service != "")
    return F.when(bare, F.concat(service, F.lit(":"), name)).otherwise(name)


def _with_family(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "family": F.coalesce(fixed_map(LOG_FAMILIES)[F.col("source")], F.lit("*")),
            "actor_id": actor_key(F.col("actor_id")),
        }
    )


def recent(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Events in the half-open window (as_of - days, as_of]."""
    end = as_of_lit(as_of)
    start = end - F.make_dt_interval(F.lit(days))
    return events.where((F.col("timestamp") > start) & (F.col("timestamp") <= end))


def entropy_bits(counts: Column) -> Column:
    """Aggregate: Shannon entropy (base 2) of a group of positive counts."""
    n = counts.cast("double")
    return F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)


def activity(estate: Estate, as_of: str) -> DataFrame:
    """Calls per day, distinct source addresses and login-hour entropy over 30 days.

    Events are reduced to one row per actor before they meet the subjects, so an
    actor behind a third of all events is aggregated map-side first.
    """
    window = _with_family(recent(estate.event, as_of))
    key = ["actor_id", "family"]
    bearers = actor_subjects(estate.subject)
    # Reduced to few rows per actor first; a subject may be several actors, so sums are taken again.
    volume = (
        skew_join(window.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), bearers, key)
        .groupBy("subject_id")
        .agg((F.sum("n") / F.lit(30.0)).alias("avg_daily_api_calls_30d"))
    )
    addresses = (
        skew_join(window.where(F.col("source_ip") != "").select(*key, "source_ip").distinct(), bearers, key)
        .select("subject_id", "source_ip")
        .distinct()
        .groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("distinct_source_ips_30d"))
    )
    logins = (
        window.where(F.col("event_type") == LOGIN)
        .groupBy(*key, F.hour("timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hours = (
        skew_join(logins, bearers, key)
        .groupBy("subject_id", "hour")
        .agg(F.sum("n").alias("n"))
        .groupBy("subject_id")
        .agg(entropy_bits(F.col("n")).alias("login_time_entropy"))
    )
    return (
        volume.join(hours, "subject_id", "left")
        .join(addresses, "subject_id", "left")
        .select(
            "subject_id",
            "avg_daily_api_calls_30d",
            F.coalesce("login_time_entropy", F.lit(0.0)).alias("login_time_entropy"),
            F.coalesce("distinct_source_ips_30d", F.lit(0).cast("bigint")).alias("distinct_source_ips_30d"),
        )
    )


def usage_ratios(estate: Estate) -> DataFrame:
    """(subject_id, usage_ratio): granted actions seen in events / granted actions."""
    seen = (
        _with_family(estate.event)
        .select("actor_id", "family", event_action(estate.event).alias("action"))
        .distinct()
    )
    seen = skew_join(seen, actor_subjects(estate.subject), ["actor_id", "family"]).select(
        "subject_id", "action", F.lit(1).alias("used")
    ).distinct()
    return (
        subject_actions(estate)
        .join(seen, ["subject_id", "action"], "left")
        .groupBy("subject_id")
        .agg((F.count("used") / F.count(F.lit(1))).alias("usage_ratio"))
    )


def holder_usage(estate: Estate) -> DataFrame:
    """(permission_id, average_usage_rate_across_holders)."""
    ratios = usage_ratios(estate)
    return (
        holders(estate)
        .join(ratios, "subject_id", "left")
        .groupBy("permission_id")
        .agg(F.avg(F.coalesce("usage_ratio", F.lit(0.0))).alias("average_usage_rate_across_holders"))
    )


def days_since_last_activity(estate: Estate, as_of: str, include_events: bool = False) -> DataFrame:
    """(subject_id, days): whole days since last_seen, -1 when never seen.

    ``include_events`` also counts the subject's newest event.
    """
    base = estate.subject.select(F.col("id").alias("subject_id"), "last_seen")
    if include_events:
        newest = _with_family(estate.event).groupBy("actor_id", "family").agg(
            F.max("timestamp").alias("newest")
        )
        newest = newest.join(actor_subjects(estate.subject), ["actor_id", "family"]).groupBy(
            "subject_id"
        ).agg(F.max("newest").alias("newest"))
        base = base.join(newest, "subject_id", "left").select(
            "subject_id", F.greatest("last_seen", "newest").alias("last_seen")
        )
    return base.select(
        "subject_id",
        F.coalesce(whole_days(as_of_lit(as_of), F.col("last_seen")), F.lit(-1).cast("bigint")).alias(
            "days_since_last_activity"
        ),
    )


def mfa_usage_rate(mfa_enabled: Column) -> Column:
    """Enrolled 1, not enrolled 0, unknown one half."""
    return F.when(mfa_enabled.isNull(), 0.5).when(mfa_enabled, 1.0).otherwise(0.0)


#: Size of distinct-count sketches as a power of two; the standard error is 1.04 / sqrt(2 ** 14), 0.8 %.
SKETCH_SIZE = 14


def event_log_statistics(events: DataFrame) -> DataFrame:
    """One row: totals, distinct actors, actions and addresses, flags, time range.

    Exact, with one exchange: each event gives its three values, equal values are combined map-side
    together with the totals (which ride on the actors), and what is left is one row per distinct value.
    """
    values = (F.col("actor_id"), F.col("raw_event_name"), F.nullif("source_ip", F.lit("")))
    cells = (
        events.select(
            F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in enumerate(values)])).alias("v"),
            "is_privileged_action", "success", "timestamp",
        )
        .groupBy("v.kind", "v.value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("is_privileged_action")).alias("privileged"),
            F.count_if(~F.col("success")).alias("errors"),
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
        )
    )
    own = lambda column: F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col(column))), F.lit(0))
    distinct = [F.count_if((F.col("kind") == kind) & F.col("value").isNotNull()) for kind in range(3)]
    return cells.agg(
        own("n").alias("total_events"),
        distinct[0].alias("unique_subjects"),
        distinct[1].alias("unique_actions"),
        distinct[2].alias("unique_ips"),
        own("privileged").alias("privileged_events"),
        own("errors").alias("error_events"),
        F.min("first_at").alias("time_range_start"),
        F.max("last_at").alias("time_range_end"),
    )


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, source, ...): counts and mergeable distinct-count sketches, a few kilobytes per day, to be stored and added to."""
    address = F.nullif("source_ip", F.lit(""))
    return events.groupBy(F.date_trunc("day", "timestamp").alias("day"), "source").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.hll_sketch_agg("actor_id", F.lit(SKETCH_SIZE)).alias("subjects"),
        F.hll_sketch_agg("raw_event_name", F.lit(SKETCH_SIZE)).alias("actions"),
        F.hll_sketch_agg(address, F.lit(SKETCH_SIZE)).alias("ips"),
        F.count_if(F.col("is_privileged_action")).alias("privileged_events"),
        F.count_if(~F.col("success")).alias("error_events"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


def statistics_of_days(days: DataFrame) -> DataFrame:
    """The columns of :func:`event_log_statistics` over any set of days, distinct counts estimated from their sketches."""
    estimate = lambda column: F.hll_sketch_estimate(F.hll_union_agg(column))
    return days.agg(
        F.sum("total_events").alias("total_events"),
        estimate("subjects").alias("unique_subjects"),
        estimate("actions").alias("unique_actions"),
        estimate("ips").alias("unique_ips"),
        F.sum("privileged_events").alias("privileged_events"),
        F.sum("error_events").alias("error_events"),
        F.min("first_at").alias("time_range_start"),
        F.max("last_at").alias("time_range_end"),
    )


def event_type_distribution(events: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent event types (the report lists the first 20)."""
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "event_type")
        .limit(top)
    )


def ingestion_summary(events: DataFrame) -> DataFrame:
    """Per source: total, counts by event type, oldest and newest event."""
    by_type = events.groupBy("source", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
    )
    return by_type.groupBy("source").agg(
        F.sum("n").alias("total_events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("events_by_type"),
        F.min("oldest").alias("oldest_event"),
        F.max("newest").alias("newest_event"),
    )
