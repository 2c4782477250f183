"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gatewarden.plans.durable import materialize_with

# A key is hot when it holds more than 1/HOT_KEY_DIVISOR of the rows, so there
# can never be more than HOT_KEY_DIVISOR hot keys: the list is safe to broadcast.
HOT_KEY_DIVISOR = 200


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate (file sizes for stored tables, an upper bound above)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes (-1 turns broadcasting off)."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def plan_nodes(df: DataFrame) -> set[str]:
    """Kinds of the optimised plan's operators."""
    found, waiting = set(), [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop()
        found.add(node.nodeName())
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.size()))
    return found


def fits_broadcast(df: DataFrame) -> bool:
    """True when the estimated size is below the broadcast threshold and rows are not multiplied on the way.

    The estimate counts an exploded row like the row it came from.
    """
    return 0 <= estimated_bytes(df) <= broadcast_limit(df) and "Generate" not in plan_nodes(df)


def size_is_known(df: DataFrame) -> bool:
    """True when the estimate rests on file sizes.

    Above a join or an explode it is a guess, and for rows handed over by the driver it is a placeholder.
    """
    return estimated_bytes(df) < 2**62 and not plan_nodes(df) & {"Join", "Generate"}


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``df`` that hold more than 1/HOT_KEY_DIVISOR of its rows, and over how many salts to deal them.

    The per-key counts are combined map-side and written once; the total comes along with that
    write. At most HOT_KEY_DIVISOR rows can qualify. A key gets as many salts as its share of the
    rows fills shuffle partitions.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    stored, seen = materialize_with(counts, "key-counts", {"total": F.sum("__rows")})
    total = int(seen.get("total") or 0)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.greatest(F.lit(2), F.ceil(F.col("__rows") * F.lit(partitions) / F.lit(max(total, 1))).cast("int"))
    return stored.where(F.col("__rows") * HOT_KEY_DIVISOR > F.lit(total)).select(*on, salts.alias("__salts"))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    *,
    spread_by: Sequence[str] | None = None,
    force_salting: bool = False,
) -> DataFrame:
    """Join ``big`` with ``small`` on equal keys without piling a hot key on one task.

    ``small`` is broadcast when its checked size allows it. When it is known to be
    larger, rows of hot keys in ``big`` are dealt over several salts, and only the
    hot keys' rows of ``small`` are repeated per salt. Rows whose key is NULL are
    dealt out too (they match nothing, but an outer join keeps them). When the size
    of ``small`` is not known before it runs, adaptive execution decides: it
    broadcasts a small result and splits a skewed reducer (see ``session``).

    ``how`` is inner, left, left_semi or left_anti; ``spread_by`` names the columns
    that tell rows of ``big`` apart (all of them by default).
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if not force_salting:
        if fits_broadcast(small):
            return big.join(F.broadcast(small), keys, how)
        if not size_is_known(small):
            return big.join(small, keys, how)

    hot = F.broadcast(hot_keys(big, keys))
    spread = F.xxhash64(*(spread_by or big.columns))
    anywhere = F.lit(int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key_missing = F.lit(False)
    for key in keys:
        key_missing = key_missing | F.col(key).isNull()
    dealt = big.join(hot, keys, "left").withColumn(
        "__salt",
        F.pmod(spread, F.coalesce("__salts", F.when(key_missing, anywhere), F.lit(1))).cast("int"),
    ).drop("__salts")
    repeated = small.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    ).drop("__salts")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
