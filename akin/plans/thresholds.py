"""What a threshold means for a direction, and when it decides everything beforehand."""

from __future__ import annotations

import math

from pyspark.sql import Column

from ..functions.metrics import SIMILARITY


def checked(threshold: float | None) -> float | None:
    if threshold is None:
        return None
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not math.isfinite(threshold):
        raise ValueError("threshold must be a finite number")
    return float(threshold)


def impossible(direction: str, bounds: tuple[float, float], threshold: float | None) -> bool:
    """No score within the bounds qualifies: a plan is empty without a scan."""
    if threshold is None:
        return False
    return threshold > bounds[1] if direction == SIMILARITY else threshold < bounds[0]


def needless(direction: str, bounds: tuple[float, float], threshold: float | None) -> bool:
    """Every score qualifies."""
    if threshold is None:
        return True
    return threshold <= bounds[0] if direction == SIMILARITY else threshold >= bounds[1]


def qualifies(direction: str, score, threshold: float):
    """For a number or a column."""
    return score >= threshold if direction == SIMILARITY else score <= threshold


def better_first(direction: str, score: Column) -> Column:
    return score.desc() if direction == SIMILARITY else score.asc()
