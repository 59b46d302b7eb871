"""Metrics: what is compared, on which scale, and how a column of scores is built."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import batches as V
from . import expressions as E
from . import kernels as K

SIMILARITY, DISTANCE = "similarity", "distance"


@dataclass(frozen=True)
class Metric:
    """One operation of a family, e.g. ``levenshtein.distance``.

    ``kernel(a, b, **config)`` scores two comparable operands in Python. ``native`` may build
    the score from column expressions alone, or return None where it can't for a configuration.
    ``batch``, where there is one for the options, scores two Arrow columns of texts at once.
    """

    family: str
    kind: str
    direction: str
    bounds: tuple[float, float]
    kernel: Callable[..., float] = field(compare=False, repr=False)
    keys: tuple[str, ...] = ()
    native: Callable[..., Column | None] | None = field(default=None, compare=False, repr=False)
    symmetric: bool | Callable[[dict], bool] = field(default=True, compare=False, repr=False)
    validate: Callable[[dict], dict] = field(default=dict, compare=False, repr=False)

    @property
    def name(self) -> str:
        return f"{self.family}.{self.kind}"

    def batch(self, config: dict) -> Callable | None:
        found = V.SCORES.get(self.family, {}).get(self.kind)
        return found if set(config) <= _BATCH_OPTIONS.get(self.family, set()) else None

    def __call__(self, left, right, **config):
        """Score of two values, or a column of scores if either is a column."""
        from ..operators.scorer import create_scorer

        scorer = create_scorer(self, **config)
        if isinstance(left, Column) or isinstance(right, Column):
            as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
            return scorer.column(as_column(left), as_column(right))
        return scorer.score(left, right)


_BATCH_OPTIONS = {"hamming": {"pad"}, "jaro_winkler": {"prefix_weight"}, "dice": {"gram_size"}, "cosine": {"gram_size"}, "tversky": {"gram_size", "alpha", "beta"}}


class Family:
    """The operations of a metric as attributes."""

    def __init__(self, name: str, **kinds: Metric):
        self.name = name
        self.__dict__.update(kinds)


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{what} must be a finite number")
    return value


def _weights(config: dict) -> dict:
    raw = config.get("weights")
    if raw is None:
        return {}
    values = (raw["insertion"], raw["deletion"], raw["substitution"]) if isinstance(raw, Mapping) else tuple(raw)
    if len(values) != 3 or any(_number(v, "a weight") < 0 for v in values):
        raise ValueError("weights are three numbers of 0 or more: insertion, deletion, substitution")
    return {} if values == (1, 1, 1) else {"weights": values}


def _gram_size(config: dict, default: int = 2) -> dict:
    n = config.get("gram_size", default)
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("gram_size must be an integer of 1 or more")
    return {} if n == default else {"gram_size": n}


def _edit_family(name: str, measure: Callable, maximum: Callable, keys: tuple[str, ...] = (), native: Callable | None = None, symmetric: Any = True, validate: Callable = dict) -> Family:
    """A family whose measure is a distance; ``similarity`` is the largest possible distance less it."""

    def similarity(a, b, **c):
        return maximum(a, b, **c) - measure(a, b, **c)

    def normalized_distance(a, b, **c):
        most = maximum(a, b, **c)
        return measure(a, b, **c) / most if most else 0.0

    def normalized_similarity(a, b, **c):
        return 1.0 - normalized_distance(a, b, **c)

    def built(kind: str):
        if native is None:
            return None

        def build(left: Column, right: Column, **c) -> Column | None:
            found = native(left, right, **c)
            if found is None:
                return None
            d, most = found

            def score(d: Column) -> Column:
                share = F.when(most > 0, d / most).otherwise(0.0)
                return {"distance": d, "similarity": most - d, "normalized_distance": share, "normalized_similarity": 1.0 - share}[kind].cast("double")

            return E.let(d, lambda d: F.when(d >= 0, score(d))) if "most" in c else score(d)

        return build

    make = lambda kind, direction, bounds, kernel: Metric(name, kind, direction, bounds, kernel, keys, built(kind), symmetric, validate)
    return Family(
        name,
        distance=make("distance", DISTANCE, (0.0, math.inf), measure), similarity=make("similarity", SIMILARITY, (0.0, math.inf), similarity),
        normalized_distance=make("normalized_distance", DISTANCE, (0.0, 1.0), normalized_distance),
        normalized_similarity=make("normalized_similarity", SIMILARITY, (0.0, 1.0), normalized_similarity),
    )


def _share_family(name: str, measure: Callable, keys: tuple[str, ...] = (), symmetric: Any = True, validate: Callable = dict, native: Callable | None = None) -> Family:
    """A family whose measure is a similarity from 0 to 1; the normalised operations are the same two."""
    far = (lambda left, right, **c: None if (s := native(left, right, **c)) is None else 1.0 - s) if native else None
    near = Metric(name, "similarity", SIMILARITY, (0.0, 1.0), measure, keys, native, symmetric, validate)
    apart = Metric(name, "distance", DISTANCE, (0.0, 1.0), lambda a, b, **c: 1.0 - measure(a, b, **c), keys, far, symmetric, validate)
    return Family(name, similarity=near, distance=apart, normalized_similarity=near, normalized_distance=apart)


_longer = lambda a, b, **_: max(len(a), len(b))
_both = lambda a, b, **_: len(a) + len(b)

levenshtein = _edit_family(
    "levenshtein", lambda a, b, weights=(1, 1, 1): K.levenshtein(a, b, weights), lambda a, b, weights=(1, 1, 1): K.levenshtein_maximum(len(a), len(b), weights),
    ("weights",), lambda left, right, **c: E.levenshtein(left, right, **c) if c else None, lambda c: "weights" not in c or c["weights"][0] == c["weights"][1], _weights,
)
lcs = _edit_family("lcs", lambda a, b: max(len(a), len(b)) - K.lcs(a, b), _longer)
indel = _edit_family("indel", lambda a, b: len(a) + len(b) - 2 * K.lcs(a, b), _both)
osa = _edit_family("osa", K.osa, _longer)
damerau_levenshtein = _edit_family("damerau_levenshtein", K.damerau, _longer)
hamming = _edit_family("hamming", K.hamming, _longer, ("pad",), validate=lambda c: {} if c.get("pad", True) else {"pad": False})
prefix = _edit_family("prefix", lambda a, b: max(len(a), len(b)) - K.prefix(a, b), _longer)
postfix = _edit_family("postfix", lambda a, b: max(len(a), len(b)) - K.postfix(a, b), _longer)
jaro = _share_family("jaro", K.jaro)


def _prefix_weight(config: dict) -> dict:
    w = _number(config.get("prefix_weight", 0.1), "prefix_weight")
    if not 0 <= w <= 1:
        raise ValueError("prefix_weight must be from 0 to 1")
    return {} if w == 0.1 else {"prefix_weight": w}


jaro_winkler = _share_family("jaro_winkler", K.jaro_winkler, ("prefix_weight",), validate=_prefix_weight)
dice = _share_family("dice", lambda a, b, gram_size=2: K.dice(a, b, gram_size), ("gram_size",), validate=_gram_size)
cosine = _share_family("cosine", lambda a, b, gram_size=2: K.cosine(a, b, gram_size), ("gram_size",), validate=_gram_size)

_TVERSKY = ("gram_size", "alpha", "beta", "element_weights", "default_element_weight", "element_similarity")


def _tversky_config(config: dict) -> dict:
    out = _gram_size(config)
    alpha, beta = (_number(config.get(k, 0.5), k) for k in ("alpha", "beta"))
    if alpha < 0 or beta < 0 or (alpha == 0 and beta == 0):
        raise ValueError("alpha and beta must be 0 or more and not both 0")
    if (alpha, beta) != (0.5, 0.5):
        out |= {"alpha": alpha, "beta": beta}
    n = config.get("gram_size", 2)
    weights, default = config.get("element_weights"), config.get("default_element_weight")
    if weights is not None or default is not None:
        if n != 1:
            raise ValueError("element weights are only defined at gram_size 1")
        weights = {k: _number(w, "an element weight") for k, w in (weights or {}).items()}
        default = _number(1.0 if default is None else default, "default_element_weight")
        if default < 0 or any(w < 0 for w in weights.values()):
            raise ValueError("element weights must be 0 or more")
        kept = {k: w for k, w in weights.items() if w != default}
        if kept or default == 0:  # uniform positive weights price nothing
            out |= {"element_weights": tuple(sorted(kept.items(), key=repr)), "default_element_weight": default}
    soft = config.get("element_similarity")
    if soft is not None:
        if n != 1:
            raise ValueError("element similarity is only defined at gram_size 1")
        if set(soft) != {"scorer", "threshold"} or not 0 < soft["threshold"] <= 1:
            raise ValueError("element_similarity has a scorer and a threshold above 0, up to 1")
        scorer = soft["scorer"]
        if scorer.direction != SIMILARITY or not scorer.symmetric or not all(map(math.isfinite, scorer.bounds)):
            raise TypeError("element_similarity needs a symmetric similarity scorer with finite bounds")
        out["element_similarity"] = (scorer, soft["threshold"])
    return out


def priced(weights: tuple) -> dict:
    """Weights by element, where a character also is its code point, as in sequences that aren't texts."""
    return dict(weights) | {ord(x): w for x, w in weights if isinstance(x, str) and len(x) == 1}


def element_score(scorer) -> Callable[[str, str], float]:
    """The scorer's similarity of two elements, on 0..1."""
    low, high = scorer.bounds
    return lambda p, q: (scorer.score(p, q) - low) / (high - low)


def _tversky(a, b, gram_size=2, alpha=0.5, beta=0.5, element_weights=None, default_element_weight=1.0, element_similarity=None):
    if element_similarity is not None:
        scorer, threshold = element_similarity
        weights = None if element_weights is None else priced(element_weights)
        return K.tversky_soft(a, b, element_score(scorer), threshold, weights, default_element_weight, alpha, beta)
    if element_weights is not None:
        return K.tversky_weighted(a, b, priced(element_weights), default_element_weight, alpha, beta)
    return K.tversky(a, b, gram_size, alpha, beta)


tversky = _share_family("tversky", _tversky, _TVERSKY, lambda c: c.get("alpha", 0.5) == c.get("beta", 0.5) and "element_similarity" not in c, _tversky_config)


def _percent(name: str, kernel: Callable) -> Metric:
    return Metric("fuzz", name, SIMILARITY, (0.0, 100.0), kernel)


ratio = _percent("ratio", K.ratio)
partial_ratio = _percent("partial_ratio", K.partial_ratio)
token_sort_ratio = _percent("token_sort_ratio", K.token_sort_ratio)
token_set_ratio = _percent("token_set_ratio", K.token_set_ratio)
token_ratio = _percent("token_ratio", K.token_ratio)
partial_token_sort_ratio = _percent("partial_token_sort_ratio", K.partial_token_sort_ratio)
partial_token_set_ratio = _percent("partial_token_set_ratio", K.partial_token_set_ratio)
partial_token_ratio = _percent("partial_token_ratio", K.partial_token_ratio)
weighted_ratio = _percent("weighted_ratio", K.weighted_ratio)

FAMILIES = (levenshtein, indel, lcs, osa, damerau_levenshtein, hamming, jaro, jaro_winkler, prefix, postfix, dice, cosine, tversky)
FUZZ = (ratio, partial_ratio, token_sort_ratio, token_set_ratio, token_ratio, partial_token_sort_ratio, partial_token_set_ratio, partial_token_ratio, weighted_ratio)


#: Text bytes that are scored together.
SLICE_BYTES = 1 << 20


def kernel_column(kernel: Callable, config: dict, left: Column, right: Column, missing: float | None, once: bool = False, batch: Callable | None = None) -> Column:
    """Scores by an Arrow UDF; equal pairs of a batch are scored once. ``missing``: score where a side is null, None to fail.

    ``once`` keeps a later filter on the score from being pushed below it, which would score
    every pair a second time; such a column can't be an argument of an aggregate. ``batch``
    scores columns of texts; what it leaves out, and other operands, go through ``kernel``.
    """

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            if missing is None and (a.null_count or b.null_count):
                raise ValueError("a distance needs both operands; one is missing")
            if batch is not None and _is_text(a) and _is_text(b):
                yield _scored_together(batch, kernel, config, a, b, missing)
            else:
                yield pa.array(_scored_singly(kernel, config, a, b, missing), pa.float64())

    return (run.asNondeterministic() if once else run)(left, right)


def _is_text(column: pa.Array) -> bool:
    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def _scored_singly(kernel: Callable, config: dict, a: pa.Array, b: pa.Array, missing: float | None) -> list[float]:
    seen: dict = {}
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(missing)
            continue
        key = (x, y) if isinstance(x, str) and isinstance(y, str) else None
        score = seen.get(key) if key is not None else None
        if score is None:
            score = float(kernel(*K.comparable(x, y), **config))
            if key is not None:
                seen[key] = score
        out.append(score)
    return out


def _scored_together(batch: Callable, kernel: Callable, config: dict, a: pa.Array, b: pa.Array, missing: float | None) -> pa.Array:
    x, y = (c.dictionary_encode() for c in (a, b))
    i, j = (c.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y))
    pair, first, back = np.unique(i * (len(y.dictionary) + 1) + j, return_index=True, return_inverse=True)
    some = 4 * len(pair) <= 3 * len(a)  # many pairs are equal
    if some:
        p, q = a.take(pa.array(first)), b.take(pa.array(first))
    else:
        p, q = a, b
    ends = np.cumsum(pc.add(pc.binary_length(p).fill_null(0), pc.binary_length(q).fill_null(0)).to_numpy(zero_copy_only=False))
    out, at = np.zeros(len(p)), 0
    while at < len(p):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")) - at)
        u, v = p.slice(at, n), q.slice(at, n)
        scores, rest = batch(u, v, **config)
        if rest.any():
            kept = pa.array(np.flatnonzero(rest))
            scores[rest] = _scored_singly(kernel, config, u.take(kept).fill_null(""), v.take(kept).fill_null(""), None)
        out[at : at + n] = scores
        at += n
    if some:
        out = out[back.reshape(-1)]
    if a.null_count or b.null_count:
        out = np.where(pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False), out, missing)
    return pa.array(out, pa.float64())
