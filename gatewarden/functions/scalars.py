"""Column expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, functions as F

# Fixed value: namespace of the deterministic entity ids.
ENTITY_NAMESPACE = uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890")

MICROS_PER_DAY = 86_400_000_000


def as_of_lit(as_of: datetime | str) -> Column:
    """Literal timestamp (UTC session) for an as-of parameter."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(text))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored (also for negative spans); NULL if either is NULL.

    Not ``datediff``: that counts calendar boundaries.
    """
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("bigint")


def entity_id(source: Column | str, external_id: Column) -> Column:
    """Version-5 UUID of ``source:external_id`` in the fixed namespace."""
    src = F.lit(source) if isinstance(source, str) else source
    name = F.concat(src, F.lit(":"), external_id)
    digest = F.sha1(
        F.concat(F.unhex(F.lit(ENTITY_NAMESPACE.hex)), F.encode(name, "UTF-8"))
    )
    variant_nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substr(F.lit("89ab"), F.pmod(variant_nibble, F.lit(4)) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def clean_email(email: Column) -> Column:
    """Lower-cased, trimmed address; NULL when nothing is left."""
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def clean_name(name: Column) -> Column:
    """Lower-cased, trimmed name with one pass over double spaces; NULL when empty."""
    return F.nullif(F.replace(F.trim(F.lower(name)), F.lit("  "), F.lit(" ")), F.lit(""))


def erp_key(action: Column) -> Column:
    """``netsuite:KEY.level`` -> ``KEY``."""
    return F.split_part(F.split_part(action, F.lit(":"), F.lit(2)), F.lit("."), F.lit(1))


def is_erp_action(action: Column) -> Column:
    return F.startswith(action, F.lit("netsuite:"))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to timestamp; text without an offset is UTC, bad text is NULL."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def half_even(value: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimal places."""
    return F.bround(value, digits)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def contains_any(text: Column, words) -> Column:
    """True when ``text`` contains one of the fixed ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def starts_with_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.startswith(text, F.lit(word))
    return hit


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 when the denominator is 0 or NULL."""
    return F.coalesce(
        numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0)
    )


def fixed_map(entries: dict[str, str]) -> Column:
    """Literal map column from a fixed dictionary."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
