"""Canonical tables and the bundle that carries them between operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

S, B, D, I, L, TS = (
    T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()
)
STRINGS = T.ArrayType(S)


def nested(columns: str) -> str:
    """``a string, b array<int>`` as the nested type ``struct<a:string,b:array<int>>``."""
    parts, depth, start = [], 0, 0
    for position, char in enumerate(columns + ","):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            name, kind = columns[start:position].strip().split(" ", 1)
            parts.append(f"{name}:{kind.strip()}")
            start = position + 1
    return f"struct<{','.join(parts)}>"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SUBJECT = _struct(
    ("id", S), ("external_id", S), ("source", S), ("type", S), ("display_name", S), ("email", S),
    ("department", S), ("manager_id", S), ("status", S), ("last_seen", TS), ("mfa_enabled", B),
    ("attributes", S), ("trust_policy_open", B), ("cross_account_trust", B),
    ("cross_account_no_conditions", B), ("cross_account_ids", STRINGS),
    ("created_at", TS), ("updated_at", TS), ("ingest_seq", L),
)
PERMISSION = _struct(
    ("id", S), ("source", S), ("name", S), ("type", S), ("actions", STRINGS), ("resources", STRINGS),
    ("is_privileged", B), ("risk_keywords", STRINGS), ("permission_keys", STRINGS), ("tags", STRINGS),
    ("attributes", S),
)
RESOURCE = _struct(
    ("id", S), ("source", S), ("type", S), ("name", S), ("sensitivity", S), ("arn", S), ("attributes", S)
)
ASSIGNMENT = _struct(
    ("id", S), ("subject_id", S), ("permission_id", S), ("resource_id", S), ("source", S),
    ("granted_at", TS), ("granted_by", S), ("last_used", TS), ("is_active", B), ("justification", S),
)
STEP = _struct(("action", S), ("resource", S), ("description", S))
ESCALATION_PATH = _struct(
    ("id", S), ("subject_id", S), ("steps", T.ArrayType(STEP)), ("end_result", S), ("confidence", D),
    ("source", S),
)
ACTIVITY_EVENT = _struct(
    ("id", S), ("source", S), ("source_event_id", S), ("event_type", S), ("raw_event_name", S),
    ("timestamp", TS), ("actor_id", S), ("actor_display_name", S), ("actor_type", S),
    ("target_id", S), ("target_type", S), ("target_name", S), ("source_ip", S), ("user_agent", S),
    ("geo_location", S), ("session_id", S), ("success", B), ("error_code", S), ("error_message", S),
    ("is_privileged_action", B), ("is_config_change", B), ("is_cross_boundary", B), ("raw_payload", S),
)
LABEL_COLUMNS = [
    "subject_id", "violation_class", "label", "confidence", "rule_id", "evidence",
    "source_systems", "is_cross_boundary",
]

TABLES = {
    "subject": SUBJECT,
    "permission": PERMISSION,
    "resource": RESOURCE,
    "assignment": ASSIGNMENT,
    "escalation_path": ESCALATION_PATH,
    "event": ACTIVITY_EVENT,
}


# Tables derived from the canonical ones that a run of many operators may keep.
DERIVED = ("held_pair", "held_edge", "subject_action", "permission_resource", "held_fact", "assignment_hit")


class Estate:
    """The canonical tables of one customer.

    A table may be given as a DataFrame or as a function that builds it; a
    function runs when the table is first asked for. Derived tables (DERIVED) are
    optional; operators build them when they are absent.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(TABLES) - set(DERIVED)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self._tables = dict(tables)

    def _table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    @property
    def subject(self) -> DataFrame:
        return self._table("subject")

    @property
    def permission(self) -> DataFrame:
        return self._table("permission")

    @property
    def resource(self) -> DataFrame:
        return self._table("resource")

    @property
    def assignment(self) -> DataFrame:
        return self._table("assignment")

    @property
    def escalation_path(self) -> DataFrame:
        return self._table("escalation_path")

    @property
    def event(self) -> DataFrame:
        return self._table("event")

    def derived(self, name: str) -> DataFrame | None:
        return self._tables.get(name)

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> "Estate":
        """A copy with other tables; derived tables are forgotten unless given."""
        kept = {n: t for n, t in self._tables.items() if n in TABLES}
        return Estate(**{**kept, **tables})

    def with_derived(self, **tables: DataFrame) -> "Estate":
        """A copy that also carries derived tables."""
        return Estate(**{**self._tables, **tables})


def estate_from_rows(spark: SparkSession, **rows: list[dict]) -> Estate:
    """Estate from small hand-written rows; missing columns are NULL."""
    frames = {}
    for name, schema in TABLES.items():
        wanted = [f.name for f in schema.fields]
        data = [tuple(row.get(c) for c in wanted) for row in rows.get(name, [])]
        unknown = {c for row in rows.get(name, []) for c in row} - set(wanted)
        if unknown:
            raise ValueError(f"unknown columns for {name}: {sorted(unknown)}")
        frames[name] = spark.createDataFrame(data, schema)
    return Estate(**frames)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
