"""Signals: severity, construction from labels and findings, deduplication, ranking, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import half_even
from gatewarden.operators.access import first_by
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate

HUMAN_THRESHOLD = 0.7
MAX_PAGE_SIZE = 200

# How a finding's first action is classified, first match wins.
# Per source: (words, violation name, class); a plus sign asks for both words.
FINDING_CLASSES = {
    "netsuite": (((), "SoD Violation (ERP)", 1),),
    "healthcare": (
        (("break-glass", "break_glass"), "Break-Glass Abuse (HIPAA)", 14),
        (("dormant",), "Dormant Contractor (HIPAA)", 4),
        (("ai agent", "scope"), "AI Agent Scope Drift (HIPAA)", 10),
        (("cross-system", "cross_system", "aggregation"), "Cross-System PHI Access (HIPAA)", 9),
        (("mfa",), "Missing MFA — PHI Access (HIPAA)", 8),
        (("export", "exfiltration"), "Excessive PHI Export (HIPAA)", 11),
        (("vip", "celebrity"), "VIP Record Snooping (HIPAA)", 15),
        (("peer", "excessive record"), "Peer Deviation — Record Access (HIPAA)", 6),
        (("unauthorized", "minimum necessary"), "Unauthorized PHI Access (HIPAA)", 15),
        ((), "HIPAA Violation (Healthcare)", 15),
    ),
    "trading": (
        (("chinese wall",), "Chinese Wall Breach (SEC/FINRA)", 15),
        (("block order", "front-running"), "Block Trade Front-Running (SEC)", 15),
        (("mnpi",), "MNPI Access / Disclosure (SEC)", 15),
        (("compliance officer", "sod violation"), "Compliance Trading Violation (FINRA)", 1),
        (("cross-desk", "toxic permission"), "Cross-Desk Access (FINRA)", 13),
        (("dormant",), "Dormant Trader / Vendor (FINRA)", 4),
        (("ai agent+barrier",), "AI Agent MNPI Scope Drift (SEC)", 10),
        (("ai agent+wall",), "AI Agent Chinese Wall Breach (FINRA)", 10),
        (("mfa", "trading access without"), "Missing MFA — Trading (SEC)", 8),
        (("information arbitrage",), "Cross-Desk Access (FINRA)", 13),
        (("research bias",), "AI Agent Chinese Wall Breach (FINRA)", 10),
        ((), "SEC/FINRA Violation (Trading)", 15),
    ),
    "okta": (
        (("weak", "mfa", "authentication"), "Weak MFA (IdP)", 8),
        (("dormant",), "Dormant Admin (IdP)", 4),
        (("service.account", "api.token"), "Service Account Risk (IdP)", 10),
        (("excessive", "session", "threat"), "Tenant Misconfiguration (IdP)", 7),
        ((), "Identity Risk (IdP)", 9),
    ),
}


def model_severity(confidence: Column, critical_count: Column, total_reach: Column) -> Column:
    """Severity from confidence and blast radius."""
    return (
        F.when((confidence > 0.9) & (critical_count > 0), "critical")
        .when((confidence > 0.8) | (total_reach > 10), "high")
        .when(confidence > 0.6, "medium")
        .otherwise("low")
    )


def report_severity(confidence: Column, violation_class: Column) -> Column:
    """Severity from confidence and violation class, as the report ranks labels."""
    gravest = violation_class.isin(1, 2, 15)
    return (
        F.when(gravest & (confidence >= 0.9), "critical")
        .when(gravest & (confidence >= 0.8), "high")
        .when(confidence >= 0.85, "high")
        .when(confidence >= 0.6, "medium")
        .otherwise("low")
    )


def finding_severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "critical").when(confidence >= 0.90, "high").otherwise("medium")


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 0).when(severity == "high", 1)
        .when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)
    )


def build_signals(detections: DataFrame, radius: DataFrame, created_at: Column) -> DataFrame:
    """Complete signals from (model_id, entity_id, confidence, action, explanation, ...).

    ``radius`` is the blast-radius table; entities without a row reach nothing.
    """
    reach = radius.select(
        F.col("subject_id").alias("entity_id"),
        F.struct("direct_resources", "escalation_resources", "critical_resources", "total_reach").alias(
            "blast_radius"
        ),
    )
    nothing = F.lit(0).cast("bigint")
    empty = F.struct(
        nothing.alias("direct_resources"), nothing.alias("escalation_resources"),
        nothing.alias("critical_resources"), nothing.alias("total_reach"),
    )
    joined = skew_join(detections, reach, "entity_id", "left").withColumn(
        "blast_radius", F.coalesce("blast_radius", empty)
    )
    grave = F.col("severity").isin("critical", "high")
    return (
        joined.withColumn(
            "severity",
            model_severity(
                F.col("confidence"), F.col("blast_radius.critical_resources"), F.col("blast_radius.total_reach")
            ),
        )
        .withColumn("signal_id", F.concat_ws("/", "model_id", "entity_id"))
        .withColumn("requires_human", (F.col("confidence") < HUMAN_THRESHOLD) | grave)
        .withColumn("rollback", F.when(grave, "staged").otherwise("immediate"))
        .withColumn("confidence", half_even(F.col("confidence"), 4))
        .withColumn("created_at", created_at)
        .withColumn("status", F.lit("pending"))
    )


def signals_from_labels(labels: DataFrame, estate: Estate) -> DataFrame:
    """Report signals of all positive labels whose subject exists."""
    names = F.create_map(*[F.lit(x) for kv in fixed.VIOLATION_NAMES.items() for x in kv])
    subject = estate.subject.select(
        F.col("id").alias("subject_id"),
        F.col("display_name").alias("subject"),
        F.col("type").alias("subject_type"),
        F.coalesce(F.nullif("department", F.lit("")), F.lit("N/A")).alias("department"),
        F.col("mfa_enabled").alias("mfa"),
    )
    return skew_join(labels.where(F.col("label") == 1), subject, "subject_id").select(
        "subject_id", "subject", "subject_type", "department",
        F.coalesce(
            names[F.col("violation_class")],
            F.concat(F.lit("Class "), F.col("violation_class").cast("string")),
        ).alias("violation"),
        "violation_class", "confidence",
        report_severity(F.col("confidence"), F.col("violation_class")).alias("severity"),
        F.col("rule_id").alias("rule"),
        "evidence",
        F.col("source_systems").alias("sources"),
        "mfa",
    )


def finding_rule(source: Column, steps: Column) -> Column:
    """``SOURCE-`` plus the first 20 characters of the first step's action."""
    first = F.try_element_at(steps, F.lit(1))["action"]
    return F.concat(F.upper(source), F.lit("-"), F.coalesce(F.substring(first, 1, 20), F.lit("EP")))


def classify_finding(source: Column, action: Column) -> tuple[Column, Column]:
    """(violation name, class) of a finding by the ordered word lists of its source."""
    text = F.lower(F.coalesce(action, F.lit("")))

    def hit(word: str) -> Column:
        parts = [F.contains(text, F.lit(p)) for p in word.split("+")]
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]

    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for origin, branches in reversed(FINDING_CLASSES.items()):
        for words, title, violation_class in reversed(branches):
            matches = source == origin
            if words:
                any_word = hit(words[0])
                for word in words[1:]:
                    any_word = any_word | hit(word)
                matches = matches & any_word
            name = F.when(matches, title).otherwise(name)
            number = F.when(matches, violation_class).otherwise(number)
    return name, number


def signals_from_findings(
    estate: Estate, label_signals: DataFrame | None = None, sources: Sequence[str] = tuple(FINDING_CLASSES)
) -> DataFrame:
    """Report signals of escalation-path rows that adapters emitted as findings.

    A finding is dropped when the labels already signalled (subject name, rule),
    and of findings with equal name and rule the first (lowest id) stays.
    """
    found = estate.escalation_path.where(F.col("source").isin(*sources))
    subject = estate.subject.select(
        F.col("id").alias("subject_id"),
        F.col("display_name").alias("subject"),
        F.col("type").alias("subject_type"),
        F.coalesce(F.nullif("department", F.lit("")), F.lit("N/A")).alias("department"),
        F.col("mfa_enabled").alias("mfa"),
    )
    named = skew_join(found, subject, "subject_id").withColumn(
        "rule", finding_rule(F.col("source"), F.col("steps"))
    )
    if label_signals is not None:
        seen = label_signals.select("subject", "rule").distinct()
        named = named.join(seen, ["subject", "rule"], "left_anti")
    unique = first_by(named, ["subject", "rule"], [F.col("id")])
    action = F.try_element_at("steps", F.lit(1))["action"]
    name, number = classify_finding(F.col("source"), action)
    step = lambda i: F.try_element_at("steps", F.lit(i))
    texts = [F.concat(step(i)["action"], F.lit(": "), step(i)["description"]).alias(f"step_{i}") for i in (1, 2, 3)]
    return unique.select(
        "subject_id", "subject", "subject_type", "department",
        name.alias("violation"), number.alias("violation_class"), "confidence",
        finding_severity(F.col("confidence")).alias("severity"), "rule",
        F.to_json(
            F.struct(
                F.col("end_result").alias("end_result"), F.size("steps").alias("steps"), *texts,
            )
        ).alias("evidence"),
        F.array("source").alias("sources"), "mfa",
    )


def best_per_entity(signals: DataFrame, order: str = "seq") -> DataFrame:
    """Highest confidence per (model_id, entity_id); on a tie the first by ``order``."""
    return first_by(signals, ["model_id", "entity_id"], [-F.col("confidence"), F.col(order)])


def rank(signals: DataFrame, tie_break: str) -> DataFrame:
    """Critical first, then by confidence."""
    return signals.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), tie_break)


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """One page of a ranked table (page numbers start at 1, at most 200 rows)."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page >= 1 and 1 <= page size <= 200")
    return ranked.offset((number - 1) * size).limit(size)


def total(signals: DataFrame) -> DataFrame:
    """One row: how many rows a listing has in all."""
    return signals.groupBy().agg(F.count(F.lit(1)).alias("total"))


def page_after(
    signals: DataFrame, size: int, tie_break: str, last: tuple[str, float, str] | None = None
) -> DataFrame:
    """The next ``size`` rows in rank order after ``last`` (severity, confidence, tie break) of the page before.

    Only the rows of one page are gathered, however deep the page lies.
    """
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("1 <= page size <= 200")
    if last is not None:
        severity, confidence, key = last
        level, before = severity_rank(F.col("severity")), severity_rank(F.lit(severity))
        signals = signals.where(
            (level > before)
            | ((level == before) & (F.col("confidence") < confidence))
            | ((level == before) & (F.col("confidence") == confidence) & (F.col(tie_break) > key))
        )
    return rank(signals, tie_break).limit(size)


def list_signals(
    signals: DataFrame,
    severity: str | None = None,
    source: str | None = None,
    model_id: str | None = None,
    requires_human: bool | None = None,
    status: str | None = None,
) -> DataFrame:
    """Signals that pass the given filters."""
    out = signals
    wanted = {
        "severity": severity, "source": source, "model_id": model_id,
        "requires_human": requires_human, "status": status,
    }
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    return out


def of_source(signals: DataFrame, source: str) -> DataFrame:
    """Report signals that involve one source system."""
    return signals.where(F.array_contains("sources", source))


def rollup_by(signals: DataFrame, column: str) -> DataFrame:
    """Signal counts by severity, violation or another column."""
    return signals.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def rollup_by_source(signals: DataFrame) -> DataFrame:
    """Signal counts per source system; a signal counts for each of its systems."""
    return signals.select(F.explode("sources").alias("source")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n")
    )


def model_catalogue(spark: SparkSession) -> DataFrame:
    """(violation_class, model_id, model_name)."""
    rows = [(c, m, fixed.VIOLATION_NAMES[c]) for c, m in fixed.MODEL_IDS.items()]
    return literal_table(spark, "violation_class int, model_id string, model_name string", rows)
