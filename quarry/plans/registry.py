"""Models by name: functions from (instruction, context) to detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Model = Callable[[dict, dict[str, DataFrame]], DataFrame]


class Registry:
    """Named models; a later one of the same name replaces the earlier."""

    def __init__(self) -> None:
        self._models: dict[str, Model] = {}

    def register(self, name: str, model: Model) -> None:
        self._models[name] = model

    def get(self, name: str) -> Model | None:
        return self._models.get(name)

    def names(self) -> list[str]:
        return sorted(self._models)


def default_registry() -> Registry:
    """The models that need no external weights, by their names."""
    from quarry.plans import models

    out = Registry()
    for f in (models.traditional_code, models.well_log_analyzer, models.well_log_ml, models.attribute_extractor, models.facies_classifier, models.horizon_tracker, models.seismic_domain_model, models.sam, models.cig_fault, models.cig_channel):
        out.register(f.__name__, f)
    return out
