"""Registry of verified queries: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden import bind
from gatewarden.operators import access, features, identity, sod
from gatewarden.operators.labels import RuleInputs, label_all
from gatewarden.plans.durable import materialize
from gatewarden.schemas import Estate
from gatewarden.sources.tables import stored
from gatewarden.session import prepare
from verification.binding_sql import with_ctes


# Stored tables that several queries of one session over one folder read.
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def forget_shared() -> None:
    """Let the next query build everything anew (for timings)."""
    _SHARED.clear()


class Bound:
    """One run's lazily built inputs over a test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    @cached_property
    def estate(self) -> Estate:
        return bind.estate(self.spark, self.sf_dir)

    @cached_property
    def kept(self) -> "Bound":
        """The same inputs with the canonical tables stored, for runs of many operators."""
        other = Bound(self.spark, self.sf_dir)
        other.__dict__["estate"] = stored(self.estate)
        return other

    @cached_property
    def members(self) -> DataFrame:
        return identity.correlated_members(self.estate.subject)

    @cached_property
    def pairs(self) -> DataFrame:
        return sod.pair_table(self.spark)

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table stored once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = materialize(build(), name)
        return _SHARED[key]

    @cached_property
    def features(self) -> DataFrame:
        settings = features.FeatureSettings(
            bind.AS_OF, bind.EVENT_AS_OF, bind.DRIFT_AS_OF,
            review_events=F.startswith("raw_event_name", F.lit(bind.REVIEW_PREFIX)),
        )
        return self.shared(
            "features",
            lambda: features.subject_features(self.kept.estate, settings, self.kept.members, self.pairs),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """The labels of all rules."""
        return self.shared("labels", lambda: label_all(self.kept.rules))

    @cached_property
    def rules(self) -> RuleInputs:
        return LazyRuleInputs(self)

    def table(self, name: str) -> DataFrame:
        return bind.table(self.spark, self.sf_dir, name)


class LazyRuleInputs:
    """Rule inputs that build only what a rule touches."""

    def __init__(self, bound: Bound):
        self._bound = bound
        self.as_of = bind.AS_OF

    @property
    def estate(self) -> Estate:
        return self._bound.estate

    @property
    def features(self) -> DataFrame:
        return self._bound.features

    @property
    def members(self) -> DataFrame:
        return self._bound.members

    @property
    def pairs(self) -> DataFrame:
        return self._bound.pairs


class PartialInputs(LazyRuleInputs):
    """Rule inputs whose feature table has only the parts a rule reads."""

    def __init__(self, bound: Bound, *parts: Callable[[Bound], DataFrame]):
        super().__init__(bound)
        self._parts = parts

    @cached_property
    def features(self) -> DataFrame:
        table = features.profile(self._bound.estate, bind.AS_OF)
        for part in self._parts:
            table = table.join(part(self._bound), "subject_id", "left")
        return table.fillna(0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def case(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``build(bound) -> DataFrame`` under ``name`` with its SQL."""

    def register(build: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, extra)
        return build

    return register


def r6(column: Column | str, alias: str | None = None) -> Column:
    """Round to six places so both engines print the same digits (never -0)."""
    col = F.col(column) if isinstance(column, str) else column
    name = alias or (column if isinstance(column, str) else None)
    return (F.round(col, 6) + F.lit(0.0)).alias(name)


def joined(column: str, alias: str | None = None) -> Column:
    """Array as comma-separated text."""
    return F.array_join(column, ",").alias(alias or column)
