"""Rules that every source's rows pass before they become canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gatewarden.schemas import TABLES


def apply_subject_rules(subject: DataFrame) -> DataFrame:
    """MFA means nothing for agents and groups, a department nothing for groups."""
    return subject.withColumn(
        "mfa_enabled", F.when(~F.col("type").isin("ai_agent", "group"), F.col("mfa_enabled"))
    ).withColumn("department", F.when(F.col("type") != "group", F.col("department")))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the canonical columns and types of ``table``; absent columns are NULL."""
    columns = []
    for field in TABLES[table].fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.ArrayType) and field.name in ("actions", "resources", "risk_keywords"):
            columns.append(F.array().cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    out = df.select(*columns)
    return apply_subject_rules(out) if table == "subject" else out


def reject_out_of_range(df: DataFrame, column: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) by a closed range; NULL is rejected."""
    inside = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return df.where(inside), df.where(~inside)
