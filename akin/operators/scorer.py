"""Scorers: a metric with its configuration, or a function of one's own."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.expressions import let
from ..functions.metrics import DISTANCE, SIMILARITY, Metric, element_score, kernel_column, priced
from ..plans import thresholds as T
from ..plans.bounds import edits


@dataclass(frozen=True)
class Scorer:
    """Scores pairs on a metric's natural scale.

    ``missing``: with ``compatible``, a similarity with a missing operand is 0; distances and
    ``throw`` fail. Scorers with equal metric and configuration are equal.
    """

    name: str
    direction: str
    bounds: tuple[float, float]
    symmetric: bool
    missing: str = "compatible"
    config: tuple = ()
    metric: Metric | None = field(default=None, compare=False, repr=False)
    function: Callable | None = None

    @property
    def _missing_score(self) -> float | None:
        return 0.0 if self.direction == SIMILARITY and self.missing == "compatible" else None

    def score(self, left, right, threshold: float | None = None) -> float | None:
        """Score of two values; None if a threshold isn't met."""
        threshold = T.checked(threshold)
        for x in (left, right):
            if x is not None and not isinstance(x, (str, list, tuple)):
                raise TypeError("only strings and sequences can be compared")
        if left is None or right is None:
            if self._missing_score is None:
                raise ValueError("an operand is missing")
            found = self._missing_score
        elif self.function is not None:
            found = self._within(self.function(left, right))
        else:
            found = float(self.metric.kernel(*K.comparable(left, right), **dict(self.config)))
        return found if threshold is None or T.qualifies(self.direction, found, threshold) else None

    def _within(self, score) -> float:
        score = float(score)
        if not math.isfinite(score) or not self.bounds[0] <= score <= self.bounds[1]:
            raise ValueError(f"a custom score must lie within {self.bounds}: {score}")
        return score

    def column(self, left: Column, right: Column, threshold: float | None = None, once: bool = False) -> Column:
        """A column of scores; with a threshold, null where it isn't met. ``once``: see ``kernel_column``; it holds for scores without Python too."""
        threshold = T.checked(threshold)
        if T.impossible(self.direction, self.bounds, threshold):
            return F.lit(None).cast("double")
        needless = T.needless(self.direction, self.bounds, threshold)
        within = lambda score: F.when(T.qualifies(self.direction, score, threshold), score)
        if self.metric is not None and self.metric.native is not None:
            allowed = None if threshold is None or needless else edits(self.name, dict(self.config), threshold)
            most = {} if allowed is None else {"most": allowed.most(F.length(left), F.length(right))}
            found = self.metric.native(left, right, **most, **dict(self.config))
            if found is not None:
                absent = F.lit(self._missing_score) if self._missing_score is not None else F.raise_error(F.lit("an operand is missing")).cast("double")
                found = F.when(left.isNull() | right.isNull(), absent).otherwise(found)
                found = found if needless else let(found, within)
                return F.when(F.spark_partition_id() >= 0, found) if once else found  # no filter passes what depends on the partition
        kernel, config = (self.metric.kernel, dict(self.config)) if self.metric is not None else (lambda a, b: self._within(self.function(a, b)), {})
        found = kernel_column(kernel, config, left, right, self._missing_score, once, self.metric and self.metric.batch(config))
        return found if needless else within(found)

    def explain(self, left, right) -> dict:
        """Evidence for a Tversky score of single elements; ``first_index`` counts code points."""
        if left is None or right is None:
            raise ValueError("an operand is missing")
        found = K.explain(left, right, **self._explaining())
        found["score"] = found["similarity"] if self.direction == SIMILARITY else 1 - found["similarity"]
        return found

    def _explaining(self) -> dict:
        config = dict(self.config)
        if self.metric is None or self.metric.family != "tversky" or config.get("gram_size", 2) != 1:
            raise TypeError("only a Tversky scorer with gram_size 1 can explain its scores")
        soft = config.get("element_similarity")
        weights = config.get("element_weights")
        return {
            "alpha": config.get("alpha", 0.5), "beta": config.get("beta", 0.5), "weights": None if weights is None else priced(weights), "default": config.get("default_element_weight", 1.0),
            "score": element_score(soft[0]) if soft else None, "threshold": soft[1] if soft else 1.0,
        }


def create_scorer(metric: Metric | Callable, *, direction: str | None = None, bounds: tuple[float, float] | None = None, symmetric: bool = False, missing: str = "compatible", **config) -> Scorer:
    """A scorer of a metric with its options, or of a function with its declared properties.

    A function is called as ``f(a, b)``; it must give finite scores within its bounds.
    """
    if missing not in ("compatible", "throw"):
        raise ValueError("missing must be compatible or throw")
    if isinstance(metric, Metric):
        unknown = set(config) - set(metric.keys)
        if unknown or direction is not None or bounds is not None:
            raise TypeError(f"{metric.name} has no option {', '.join(sorted(unknown)) or 'direction or bounds'}")
        config = metric.validate(config)
        balanced = metric.symmetric(config) if callable(metric.symmetric) else metric.symmetric
        return Scorer(metric.name, metric.direction, metric.bounds, balanced, missing, tuple(sorted(config.items(), key=lambda x: x[0])), metric)
    if config:
        raise TypeError(f"unknown options: {', '.join(sorted(config))}")
    if not callable(metric) or direction not in (SIMILARITY, DISTANCE) or bounds is None:
        raise TypeError("a scorer of one's own needs a function, a direction and bounds")
    low, high = bounds
    if not math.isfinite(low) or not low < high:
        raise ValueError("bounds must ascend from a finite number")
    if direction == SIMILARITY and missing == "compatible" and not low <= 0 <= high:
        raise ValueError("a similarity that scores missing operands 0 needs 0 within its bounds")
    return Scorer(getattr(metric, "__name__", "custom"), direction, (float(low), float(high)), symmetric, missing, (), None, metric)


def is_match(scorer: Scorer, left, right, threshold: float):
    """Whether two values, or the rows' two columns, meet a threshold."""
    if isinstance(left, Column):
        return scorer.column(left, right, threshold).isNotNull()
    return scorer.score(left, right, threshold) is not None


def score_if_match(scorer: Scorer, left, right, threshold: float):
    """The score where it meets a threshold, else None (null)."""
    return scorer.column(left, right, threshold) if isinstance(left, Column) else scorer.score(left, right, threshold)
