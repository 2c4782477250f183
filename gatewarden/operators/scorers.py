"""Registered models of any kind, run over all subjects; a row that a model fails on is counted, not fatal.

A ``PythonModel`` is a user's class: ``load()`` makes the object once per worker, its ``predict(row)`` gets one
subject's features as a dict and returns detections. It runs in Arrow batches; an exception concerns one
row of one model, becomes a row of the failures, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewarden.plans.durable import materialize
from gatewarden.plans.workers import importable

DETECTIONS = "model_id string, subject_id string, confidence double, action string, error string"
#: What a failed row keeps of its exception.
ERROR_LENGTH = 500

#: Loaded models of this Python worker.
_LOADED: dict[tuple[str, str], Any] = {}


@dataclass(frozen=True)
class PythonModel:
    """A user's model: how to load it, and what it is called."""

    model_id: str
    load: Callable[[], Any]
    version: str = "0.1.0"

    def __call__(self, features: DataFrame) -> DataFrame:
        return predictions(self, features)


def predictions(model: PythonModel, features: DataFrame) -> DataFrame:
    """(model_id, subject_id, confidence, action, error): detections and failures of one model over all rows.

    ``predict`` returns an iterable of (confidence, action) pairs, or of confidences alone. A model that cannot
    be loaded fails every row it would have seen.
    """
    importable(features.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model.model_id, model.version)
        broken = None
        if key not in _LOADED:
            try:
                _LOADED[key] = model.load()
            except Exception as error:
                broken = f"not loaded: {type(error).__name__}: {error}"[:ERROR_LENGTH]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                who = row["subject_id"]
                try:
                    if broken:
                        raise RuntimeError(broken)
                    found = [_detection(d) for d in _LOADED[key].predict(row) or ()]
                except Exception as error:
                    said = broken or f"{type(error).__name__}: {error}"[:ERROR_LENGTH]
                    out.append((model.model_id, who, None, None, said))
                else:
                    out.extend((model.model_id, who, confidence, action, None) for confidence, action in found)
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["model_id", "subject_id", "confidence", "action", "error"],
            )

    return features.mapInArrow(run, DETECTIONS)


def _detection(found: Any) -> tuple[float, str]:
    confidence, action = found if isinstance(found, tuple) else (found, "flag_for_review")
    return float(confidence), str(action)


class Registry:
    """Models by id: the last one registered under an id holds."""

    def __init__(self, models: Iterable[PythonModel] = ()):
        self._models: dict[str, Callable[[DataFrame], DataFrame]] = {}
        for model in models:
            self.register(model)

    def register(self, model: PythonModel) -> None:
        self._models[model.model_id] = model

    def register_tier2(self, policy_id: str, model: PythonModel) -> None:
        """A customer's own model, named after the policy it belongs to."""
        self.register(PythonModel(f"T2-{policy_id}", model.load, model.version))

    def register_scorer(self, model_id: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
        """A scorer in DataFrame operations: it returns (subject_id, confidence) and optionally action."""

        def run(features: DataFrame) -> DataFrame:
            found = scorer(features)
            action = F.col("action") if "action" in found.columns else F.lit("flag_for_review")
            return found.select(
                F.lit(model_id).alias("model_id"), "subject_id", F.col("confidence").cast("double").alias("confidence"),
                action.alias("action"), F.lit(None).cast("string").alias("error"),
            )

        self._models[model_id] = run

    def get(self, model_id: str) -> Callable[[DataFrame], DataFrame] | None:
        return self._models.get(model_id)

    def ids(self) -> list[str]:
        return sorted(self._models)

    def run(self, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(detections, failures) of all models over all rows, from one stored pass."""
        if not self._models:
            raise ValueError("no models registered")
        parts = [scorer(features) for scorer in self._models.values()]
        everything = parts[0]
        for part in parts[1:]:
            everything = everything.unionByName(part)
        stored = materialize(everything, "detections")
        failed = stored.where(F.col("error").isNotNull())
        return stored.where(F.col("error").isNull()).drop("error"), failed.select("model_id", "subject_id", "error")
