"""Remediation plans as tables: steps, impact, rollback, ledger, approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

REVIEW_SYSTEM = "access_review"


def plan_steps(signals: DataFrame) -> DataFrame:
    """Ordered steps of each signal's plan.

    ``signals``: signal_id, entity_id, source, action, model_id, severity, and
    optionally flagged_permissions (array). Revoking makes one reversible step per
    flagged permission (the model id when none is named); other actions make one.
    """
    flagged = (
        F.coalesce("flagged_permissions", F.array("model_id"))
        if "flagged_permissions" in signals.columns
        else F.array("model_id")
    )
    revoke = F.col("action") == "revoke_permission"
    targets = F.when(revoke, flagged).otherwise(F.array(F.lit(None).cast("string")))
    rows = signals.select("*", F.posexplode(targets).alias("pos", "target_permission"))
    entity, source = F.col("entity_id"), F.col("source")
    action = F.col("action")

    def by_action(revoking, disabling, mfa, review, other) -> Column:
        return (
            F.when(revoke, revoking)
            .when(action == "disable_account", disabling)
            .when(action == "require_mfa", mfa)
            .when(action == "flag_for_review", review)
            .otherwise(other)
        )

    nothing = F.lit(None).cast("string")
    permission_json = F.to_json(F.struct(F.col("target_permission").alias("permission_id")))
    return rows.select(
        "signal_id",
        (F.col("pos") + 1).alias("step_order"),
        by_action(
            F.lit("detach_policy"), F.lit("disable_account"), F.lit("enforce_mfa"),
            F.lit("create_review_ticket"), action,
        ).alias("action"),
        F.when(action == "flag_for_review", REVIEW_SYSTEM).otherwise(source).alias("target_system"),
        entity.alias("target_entity"),
        by_action(
            permission_json, F.lit("{}"), F.lit('{"mfa_type":"totp"}'),
            F.to_json(F.struct("signal_id", F.coalesce("severity", F.lit("medium")).alias("priority"))),
            F.lit("{}"),
        ).alias("parameters"),
        by_action(
            F.format_string("Detach permission '%s' from entity %s", "target_permission", "entity_id"),
            F.format_string("Disable account %s in %s", "entity_id", "source"),
            F.format_string("Enforce MFA on %s in %s", "entity_id", "source"),
            F.format_string("Create access review ticket for %s", "entity_id"),
            F.format_string("Execute '%s' on %s in %s", "action", "entity_id", "source"),
        ).alias("description"),
        (revoke | action.isin("disable_account", "require_mfa")).alias("is_reversible"),
        by_action(
            F.lit("attach_policy"), F.lit("enable_account"), F.lit("remove_mfa_requirement"), nothing, nothing
        ).alias("rollback_action"),
        F.when(revoke, permission_json).when(
            action.isin("disable_account", "require_mfa"), F.lit("{}")
        ).alias("rollback_parameters"),
    )


def estimated_impact(steps: Column, total_reach: Column, critical: Column) -> Column:
    return F.concat_ws(
        ", ",
        F.concat(steps.cast("string"), F.lit(" remediation step(s)")),
        F.when(total_reach > 0, F.concat(F.lit("affects "), total_reach.cast("string"), F.lit(" resources"))),
        F.when(critical > 0, F.concat(F.lit("including "), critical.cast("string"), F.lit(" critical"))),
    )


def plans(signals: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per signal: number of steps, impact, rollback type, approval need.

    Needs signal_id, requires_human, rollback, total_reach, critical_resources.
    """
    counted = steps.groupBy("signal_id").agg(F.count(F.lit(1)).alias("steps"))
    joined = signals.join(counted, "signal_id", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    return joined.select(
        F.concat(F.lit("plan/"), "signal_id").alias("plan_id"),
        "signal_id",
        "steps",
        F.col("requires_human").alias("requires_human_approval"),
        estimated_impact(F.col("steps"), F.col("total_reach"), F.col("critical_resources")).alias(
            "estimated_impact"
        ),
        F.col("rollback").alias("rollback_type"),
    )


def rollback_steps(steps: DataFrame) -> DataFrame:
    """Reversible steps with the order in which to undo them (last step first).

    ``undo_order`` is the negated step order; sort by it within a plan.
    """
    return steps.where(F.col("is_reversible") & F.col("rollback_action").isNotNull()).select(
        "signal_id",
        (-F.col("step_order")).alias("undo_order"),
        F.col("action").alias("original_action"),
        "rollback_action",
        "target_system",
        "target_entity",
        "rollback_parameters",
    )


def execution_ledger(steps: DataFrame, results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Outcome per plan from step results (signal_id, step_order, ok).

    Steps run in order up to the first failure; only steps with a result have run. A plan is
    completed when every step succeeded, failed at its first failure, else running, or not_run
    without any result. A dry run executes nothing and counts the planned steps.
    """
    ran = steps.select("signal_id", "step_order").join(results, ["signal_id", "step_order"], "left")
    outcome = ran.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count("ok").alias("reported"),
        F.min(F.when(~F.col("ok"), F.col("step_order"))).alias("failed_step"),
        F.count_if(F.col("ok")).alias("succeeded"),
    )
    if dry_run:
        return outcome.select(
            "signal_id", F.lit("dry_run").alias("status"), F.col("planned").alias("steps_completed"),
            F.lit(None).cast(steps.schema["step_order"].dataType).alias("failed_step"),
        )
    status = (
        F.when(F.col("failed_step").isNotNull(), "failed")
        .when(F.col("succeeded") == F.col("planned"), "completed")
        .when(F.col("reported") == 0, "not_run")
        .otherwise("running")
    )
    done = F.when(F.col("failed_step").isNull(), F.col("succeeded")).otherwise(
        F.least(F.col("succeeded"), F.col("failed_step") - 1)
    )
    return outcome.select(
        "signal_id", status.alias("status"), done.cast("bigint").alias("steps_completed"), "failed_step"
    )


def steps_to_undo(steps: DataFrame, ledger: DataFrame) -> DataFrame:
    """Completed reversible steps of failed executions, to undo last first."""
    failed = ledger.where(F.col("status") == "failed").select("signal_id", "failed_step")
    return rollback_steps(
        steps.join(failed, "signal_id").where(F.col("step_order") < F.col("failed_step"))
    )


def approval_gate(signals: DataFrame, approvals: DataFrame, executed: DataFrame) -> DataFrame:
    """Execution decision per signal: conflict, blocked or allowed.

    ``approvals`` and ``executed`` hold signal_id.
    """
    with_token = approvals.select("signal_id").distinct().withColumn("approved", F.lit(True))
    done = executed.select("signal_id").distinct().withColumn("done", F.lit(True))
    return (
        signals.select("signal_id", "requires_human")
        .join(done, "signal_id", "left")
        .join(with_token, "signal_id", "left")
        .select(
            "signal_id",
            F.when(F.col("done"), "conflict")
            .when(F.col("requires_human") & F.col("approved").isNull(), "blocked")
            .otherwise("allowed")
            .alias("decision"),
        )
    )


def audit_of(audit: DataFrame, signal_id: str) -> DataFrame:
    """Audit entries of one signal."""
    return audit.where(F.col("signal_id") == signal_id)
