"""Named stages over tables: registered callables, preloaded evidence, memoised runs, and a trace table."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_TRACE = "sequence int, stage string, cache_key string, cache_status string, parameters string, status string, error string"


class Stages:
    """Stages turn parameters into a table. A run is kept by name and parameters; a stage that raises gives None and a
    failed trace row, and is not run again. External producers (models, media tools) take part as preloaded tables."""

    def __init__(self) -> None:
        self._stages: dict[str, Callable[..., DataFrame]] = {}
        self._kept: dict[str, tuple[DataFrame | None, str | None]] = {}
        self._trace: list[tuple] = []

    @staticmethod
    def cache_key(stage: str, parameters: dict[str, Any]) -> str:
        body = json.dumps(parameters, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        return f"{stage}:{sha256(body.encode()).hexdigest()}"

    def register(self, stage: str, fn: Callable[..., DataFrame], replace: bool = False) -> None:
        if stage in self._stages and not replace:
            raise ValueError(f"stage {stage} is registered")
        self._stages[stage] = fn

    def preload(self, stage: str, table: DataFrame, **parameters: Any) -> None:
        self._kept[self.cache_key(stage, parameters)] = (table, None)
        self._note(stage, parameters, "preloaded", None)

    def run(self, stage: str, **parameters: Any) -> DataFrame | None:
        key = self.cache_key(stage, parameters)
        hit = key in self._kept
        if not hit:
            try:
                self._kept[key] = (self._stages[stage](**parameters), None)
            except Exception as e:  # a failed stage is evidence that is missing, not an end of the plan
                self._kept[key] = (None, f"{type(e).__name__}: {e}")
        table, error = self._kept[key]
        self._note(stage, parameters, "hit" if hit else "miss", error)
        return table

    def _note(self, stage: str, parameters: dict[str, Any], cache: str, error: str | None) -> None:
        self._trace.append((len(self._trace) + 1, stage, self.cache_key(stage, parameters), cache, json.dumps(parameters, sort_keys=True, ensure_ascii=False), "failed" if error else "ok", error))

    def trace(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._trace, _TRACE)
