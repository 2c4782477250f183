"""Inject known violations into an estate, as table operations with ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import as_of_lit
from gatewarden.plans.durable import materialize
from gatewarden.plans.ranking import hashed_rank
from gatewarden.schemas import Estate
from gatewarden.sources.canonical import conform

# Cohorts in order with their share of the subjects.
RATES = (
    ("sod", 0.05),
    ("excess", 0.10),
    ("dormant", 0.08),
    ("orphan", 0.03),
    ("escalation", 0.04),
    ("mfa", 0.15),
    ("open_trust", 0.05),
    ("toxic", 0.02),
    ("break_glass", 0.01),
)
EXTRA_PERMISSIONS = 15


def cohorts(subject: DataFrame, seed: int, rates=RATES) -> DataFrame:
    """(subject_id, source, type, cohort): disjoint cohorts in a seeded order of the ids."""
    people = subject.where(F.col("type") != "group").select(F.col("id").alias("subject_id"), "source", "type")
    ranked = hashed_rank(people, "subject_id", seed)
    cohort, upto = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    bounds = []
    for name, rate in rates:
        upto = upto + F.floor(F.col("group_size") * F.lit(rate)).cast("bigint")
        bounds.append((name, upto))
    for name, upto in reversed(bounds):
        cohort = F.when(F.col("place") <= upto, name).otherwise(cohort)
    return ranked.select("subject_id", "source", "type", cohort.alias("cohort")).where(
        F.col("cohort").isNotNull()
    )


def _draw(subject: Column, purpose: str, seed: int, low: int, high: int) -> Column:
    """Deterministic whole number in [low, high] for a subject."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), subject), F.lit(high - low + 1)).cast("int") + low


def _grants(chosen: DataFrame, seed: int) -> DataFrame:
    """One row per injected permission: subject_id, source, name, actions, keys, privileged, age."""
    subject = F.col("subject_id")

    def grant(name, actions, privileged=True, keys=None, age=None) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        no_keys = F.array().cast("array<string>")
        return F.struct(
            as_column(name).alias("name"),
            actions.alias("actions"),
            as_column(privileged).alias("is_privileged"),
            (no_keys if keys is None else keys).alias("permission_keys"),
            (F.lit(None).cast("int") if age is None else age).alias("age_days"),
        )

    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    pairs = F.array(*[words(*pair) for pair in fixed.ERP_SOD_PAIRS])
    pair = F.element_at(pairs, _draw(subject, "pair", seed, 1, len(fixed.ERP_SOD_PAIRS)))
    sod = F.transform(
        pair,
        lambda k: grant(
            F.concat(F.lit("SoD-"), k),
            F.array(F.concat(F.lit("netsuite:"), k, F.lit(".full"))),
            keys=F.array(k),
            age=_draw(subject, "sod-age", seed, 1, 200),
        ),
    )
    excess = F.array(
        *[
            grant(
                f"ExcessPerm-{i}", words(f"extra:action-{i}"),
                privileged=_draw(subject, f"excess-{i}", seed, 0, 9) < 3,
            )
            for i in range(EXTRA_PERMISSIONS)
        ]
    )
    patterns = F.array(*[words(*sorted(p[1])) for p in fixed.ESCALATION_PATTERNS])
    chain = F.element_at(patterns, _draw(subject, "chain", seed, 1, len(fixed.ESCALATION_PATTERNS)))
    escalation = F.transform(chain, lambda a: grant(F.concat(F.lit("EscPerm-"), a), F.array(a)))
    toxic = F.array(
        grant("SecurityAdmin", words("iam:*", "guardduty:*")),
        grant("FinanceAdmin", words("netsuite:TRAN_JOURNAL.full", "netsuite:ADMI_SETUP.full")),
    )
    break_glass = F.array(
        grant(
            "emergency-break-glass-admin", words("iam:*", "s3:*", "ec2:*"),
            age=_draw(subject, "break-glass-age", seed, 3, 30),
        )
    )
    dormant = F.array(grant("DormantPrivRole", words("iam:*")))
    cohort = F.col("cohort")
    grants = (
        F.when(cohort == "sod", sod).when(cohort == "excess", excess)
        .when(cohort == "dormant", dormant).when(cohort == "escalation", escalation)
        .when(cohort == "toxic", toxic).when(cohort == "break_glass", break_glass)
    )
    return chosen.select("subject_id", "source", F.posexplode(grants).alias("grant_no", "grant")).select(
        "subject_id", "source", "grant_no", "grant.*"
    )


def inject_violations(estate: Estate, as_of: str, seed: int = 42, rates=RATES) -> tuple[Estate, DataFrame]:
    """(changed estate, truth). Truth: subject_id, violation_class, label, confidence, rule_id."""
    now = as_of_lit(as_of)
    chosen = materialize(cohorts(estate.subject, seed, rates), "cohorts")
    grants = _grants(chosen, seed).withColumn(
        "permission_id", F.concat_ws("/", F.lit("injected"), "subject_id", F.col("grant_no").cast("string"))
    )
    new_permissions = conform(
        grants.select(
            F.col("permission_id").alias("id"), "source", "name", F.lit("role").alias("type"), "actions",
            "is_privileged", "permission_keys",
        ),
        "permission",
    )
    new_assignments = conform(
        grants.select(
            F.concat(F.lit("assignment/"), "permission_id").alias("id"), "subject_id", "permission_id", "source",
            (now - F.make_dt_interval(F.col("age_days"))).alias("granted_at"),
            F.lit(True).alias("is_active"),
        ),
        "assignment",
    )
    subject_column = F.col("subject_id")
    pattern_no = _draw(subject_column, "chain", seed, 1, len(fixed.ESCALATION_PATTERNS))
    facts = F.element_at(
        F.array(
            *[
                F.struct(
                    F.array(*[F.lit(a) for a in sorted(p[1])]).alias("actions"),
                    F.lit(p[3]).alias("end_result"),
                    F.lit(p[2]).alias("confidence"),
                )
                for p in fixed.ESCALATION_PATTERNS
            ]
        ),
        pattern_no,
    )
    new_paths = conform(
        chosen.where(F.col("cohort") == "escalation")
        .withColumn("facts", facts)
        .select(
            F.concat(F.lit("injected/"), "subject_id").alias("id"), "subject_id", "source",
            F.transform(
                "facts.actions",
                lambda a: F.struct(
                    a.alias("action"), F.lit("*").alias("resource"),
                    F.concat(F.lit("Has "), a).alias("description"),
                ),
            ).alias("steps"),
            "facts.end_result", "facts.confidence",
        ),
        "escalation_path",
    )
    marked = estate.subject.join(
        chosen.select(F.col("subject_id").alias("id"), "cohort"), "id", "left"
    )
    cohort = F.col("cohort")
    silence = _draw(F.col("id"), "dormant-days", seed, 100, 365)
    changed = (
        marked.withColumn(
            "last_seen",
            F.when(cohort == "dormant", now - F.make_dt_interval(silence)).otherwise(F.col("last_seen")),
        )
        .withColumn("status", F.when(cohort == "orphan", "deleted").otherwise(F.col("status")))
        .withColumn(
            "mfa_enabled",
            F.when((cohort == "mfa") & (F.col("type") == "human"), F.lit(False)).otherwise(F.col("mfa_enabled")),
        )
        .withColumn(
            "trust_policy_open",
            F.when(cohort == "open_trust", F.lit(True)).otherwise(F.col("trust_policy_open")),
        )
        .drop("cohort")
    )
    def pick(values: dict) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            out = F.when(F.col("cohort") == name, value).otherwise(out)
        return out

    truth = (
        chosen.where((F.col("cohort") != "mfa") | (F.col("type") == "human"))
        .withColumn("facts", facts)
        .select(
            "subject_id",
            pick({"sod": 1, "excess": 3, "dormant": 4, "orphan": 5, "escalation": 2, "mfa": 8,
                  "open_trust": 7, "toxic": 13, "break_glass": 14}).cast("int").alias("violation_class"),
            F.lit(1).alias("label"),
            pick({"sod": 0.95, "excess": 0.8, "dormant": 0.9, "orphan": 0.85, "mfa": 0.7,
                  "escalation": F.col("facts.confidence"), "open_trust": 0.95, "toxic": 0.9,
                  "break_glass": 0.9}).cast("double").alias("confidence"),
            pick({"sod": "SYNTH-SOD", "excess": "SYNTH-EP", "dormant": "SYNTH-DORMANT",
                  "orphan": "SYNTH-ORPHAN", "escalation": "SYNTH-ESC", "mfa": "SYNTH-MFA",
                  "open_trust": "SYNTH-OPEN-TRUST", "toxic": "SYNTH-TOXIC",
                  "break_glass": "SYNTH-BGA"}).alias("rule_id"),
            F.array("source").alias("source_systems"),
        )
    )
    injected = estate.with_tables(
        subject=changed,
        permission=estate.permission.unionByName(new_permissions),
        assignment=estate.assignment.unionByName(new_assignments),
        escalation_path=estate.escalation_path.unionByName(new_paths),
    )
    return injected, truth
