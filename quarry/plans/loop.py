"""The closed loop: run the steps, verify, drop false positives, retry a step.

The plan is a few rows and stays on the driver; its results are DataFrames, written
to the shared folder after each step, so that lineage does not grow and no round runs
the models of an earlier one again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from quarry.plans.registry import Registry
from quarry.session import written


@dataclass
class Step:
    """A step of a plan and the parameters of its model."""

    number: int
    model: str
    instruction: dict = field(default_factory=dict)


@dataclass
class Verdict:
    """False positives to drop (a column ``det_id``) and the parameters of a step to retry."""

    drop: DataFrame | None = None
    retry_step: int | None = None
    adjusted: dict | None = None


def apply_retry(steps: list[Step], step: int | None, adjusted: dict | None) -> int | None:
    """Merges adjusted parameters into the step; its number, or None if there is none."""
    if step is None or not adjusted:
        return None
    for s in steps:
        if s.number == step:
            s.instruction = {**s.instruction, **adjusted}
            return step
    return None


def closed_loop(steps: list[Step], registry: Registry, context: dict[str, DataFrame], verify: Callable[[DataFrame, int], Verdict | None], rounds: int = 3, rerun_all: bool = False, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: written(d, "loop-step")) -> DataFrame | None:
    """Detections of the last round of each step, false positives removed.

    ``checkpoint`` is what becomes of each result: a written table, unless another is
    given. An unknown model gives nothing. ``rerun_all`` runs every step each round
    instead of the adjusted one. The loop ends without a retry that applies (in
    either mode: an unchanged plan gives the same rows), without detections, or
    after ``rounds``.
    """
    results: dict[int, DataFrame] = {}
    queue = list(steps)
    for n in range(rounds):
        for s in queue:
            if model := registry.get(s.model):
                results[s.number] = checkpoint(model(s.instruction, context))
        if not results:
            return None
        verdict = verify(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results.values()), n)
        if verdict is None:
            break
        if verdict.drop is not None:
            results = {k: checkpoint(d.join(verdict.drop, "det_id", "left_anti")) for k, d in results.items()}
        target = apply_retry(steps, verdict.retry_step, verdict.adjusted)
        if target is None:
            break
        queue = list(steps) if rerun_all else [s for s in steps if s.number == target]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results.values())
