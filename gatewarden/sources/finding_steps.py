"""Escalation steps of findings, filled in from evidence by text templates.

A template is plain text with ``{field|default}`` places. ``{field[]}`` joins a
list with commas, ``{field?yes:no}`` chooses by a flag.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

PLACE = re.compile(r"\{([a-z0-9_]+)(\[\]|\?[^:}]*:[^}]*)?(?:\|([^}]*))?\}")


def _filled(evidence: Column, field: str, mode: str | None, default: str | None) -> Column:
    value = F.get_json_object(evidence, f"$.{field}")
    if mode == "[]":
        return F.coalesce(F.array_join(F.from_json(value, "array<string>"), ", "), F.lit(""))
    if mode:
        yes, no = mode[1:].split(":", 1)
        return F.when(F.coalesce(value, F.lit("false")).isin("false", "0", "null", ""), no).otherwise(yes)
    # JSON booleans print with a capital, as the texts have always shown them.
    shown = F.when(value == "true", "True").when(value == "false", "False").otherwise(value)
    return F.coalesce(shown, F.lit(default or ""))


def render(evidence: Column, template: str) -> Column:
    """Template text as a column expression over a JSON evidence column."""
    parts, at = [], 0
    for place in PLACE.finditer(template):
        if place.start() > at:
            parts.append(F.lit(template[at : place.start()]))
        parts.append(_filled(evidence, *place.groups()))
        at = place.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def steps_of(kind: Column, evidence: Column, templates: dict, fallback: Column) -> Column:
    """Ordered steps array for a finding type; unknown types get ``fallback``."""
    steps = fallback
    for name, rows in reversed(templates.items()):
        built = F.array(
            *[
                F.struct(
                    F.lit(action).alias("action"),
                    render(evidence, resource).alias("resource"),
                    render(evidence, description).alias("description"),
                )
                for action, resource, description in rows
            ]
        )
        steps = F.when(kind == name, built).otherwise(steps)
    return steps
