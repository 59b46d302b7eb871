"""Cheap column predicates that no qualifying pair fails; they run before any Python.

Each bound follows from lengths alone (kept as columns by prepared sides). A small slack
covers floating point, so pairs on the edge go on to be scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLACK = 1e-9


def length_bound(name: str, config: dict, threshold: float, n: Column, m: Column) -> Column | None:
    """A predicate on the operands' lengths for ``metric score qualifies``, or None if there is none."""
    low, high, total = F.least(n, m), F.greatest(n, m), n + m
    if name in ("indel.normalized_similarity", "fuzz.ratio"):
        t = threshold / 100 if name == "fuzz.ratio" else threshold
        return 2.0 * low >= (t - _SLACK) * total
    if name in ("levenshtein.distance", "osa.distance", "damerau_levenshtein.distance", "hamming.distance", "lcs.distance") and not config:
        return high - low <= threshold + _SLACK
    if name == "indel.distance":
        return high - low <= threshold + _SLACK
    if name in tuple(f"{f}.normalized_similarity" for f in ("levenshtein", "osa", "damerau_levenshtein", "lcs", "hamming", "prefix", "postfix")) and not config:
        return low >= (threshold - _SLACK) * high
    if name in tuple(f"{f}.normalized_distance" for f in ("levenshtein", "osa", "damerau_levenshtein", "lcs", "hamming", "prefix", "postfix")) and not config:
        return low >= (1 - threshold - _SLACK) * high
    if name in ("lcs.similarity", "prefix.similarity", "postfix.similarity"):
        return low >= threshold - _SLACK
    if name.startswith("indel.") and name.endswith("normalized_distance"):
        return 2.0 * low >= (1 - threshold - _SLACK) * total
    family, _, kind = name.rpartition(".")
    if family in ("jaro", "jaro_winkler") and not config.keys() - {"prefix_weight"}:
        # All characters of the shorter text agree at best; then its whole weighted beginning may.
        most = F.when(high == 0, 1.0).otherwise((2.0 + low / F.greatest(high, F.lit(1))) / 3)
        if family == "jaro_winkler":
            most = most + F.lit(min(1.0, 4 * config.get("prefix_weight", 0.1))) * (1.0 - most)
        return most >= (threshold if kind.endswith("similarity") else 1 - threshold) - _SLACK
    return None


#: Families of edit distances by how many ``n``-grams of a text one edit changes at most, besides ``n``; None where edits are insertions and deletions.
_MORE_GRAMS = {"levenshtein": 0, "hamming": 0, "osa": 1, "damerau_levenshtein": 1, "indel": None, "ratio": None, "lcs": None}


@dataclass(frozen=True)
class Edits:
    """How many edits a qualifying pair of two lengths may be apart."""

    most: Callable[[Column, Column], Column]
    longest: Callable[[Column], Column]  #: the most for one length, whatever the other
    more: int | None

    def shared(self, n: int, a: Column, b: Column) -> Column:
        """Fewest shared ``n``-grams of a qualifying pair."""
        left, right = (F.greatest(x - (n - 1), F.lit(0)) for x in (a, b))
        if self.more is None:
            return F.ceil((left + right - F.lit(2 * n - 1) * self.most(a, b)) / 2)
        return F.greatest(left, right) - F.lit(n + self.more) * self.most(a, b)

    def opening(self, n: int, a: Column) -> Column:
        """So many of a text's grams, in an order that all texts share, hold one of every qualifying partner's."""
        return F.lit(n + (self.more or 0)) * self.longest(a) + 1


def edits(name: str, config: dict, threshold: float) -> Edits | None:
    """The edits that a threshold allows, or None if the metric doesn't count edits."""
    family, _, kind = name.rpartition(".")
    family, kind = ("ratio", "normalized_similarity") if name == "fuzz.ratio" else (family, kind)
    if family not in _MORE_GRAMS or config:
        return None
    more = _MORE_GRAMS[family]
    if kind == "distance":
        if threshold < 0:
            return None
        if family == "lcs":  # the longer length less the common subsequence
            return Edits(lambda a, b: F.lit(2 * int(threshold + _SLACK)) - F.abs(a - b), lambda a: F.lit(2 * int(threshold + _SLACK)), more)
        k = F.lit(int(threshold + _SLACK))
        return Edits(lambda a, b: k, lambda a: k, more)
    if kind not in ("normalized_similarity", "normalized_distance"):
        return None
    share = 1 - threshold / 100 if name == "fuzz.ratio" else threshold if kind == "normalized_distance" else 1 - threshold
    if not 0 <= share < 1:
        return None
    if family == "lcs":
        apart = lambda a, b: F.floor(a + b - 2 * (1 - share) * F.greatest(a, b) + _SLACK)
        return Edits(apart, lambda a: F.floor(2 * share * a / (1 - share) + _SLACK), more)
    if more is None:  # the other side has at most (1 + share) / (1 - share) times the length
        return Edits(lambda a, b: F.floor((share + _SLACK) * (a + b)), lambda a: F.floor((share + _SLACK) * 2 * a / (1 - share) + _SLACK), more)
    return Edits(lambda a, b: F.floor((share + _SLACK) * F.greatest(a, b)), lambda a: F.floor((share + _SLACK) * a / (1 - share) + _SLACK), more)
