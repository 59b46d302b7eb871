"""Inverted gram indexes as DataFrames: postings are joined on the gram.

Building explodes each text's grams and counts them. Without a threshold a search is an
equi-join on the gram, a sum by pair, and the metric's formula over the sums. With one, the
long postings of frequent grams are not read: of two texts that qualify, the rarest gram that
they share comes early enough in both (in the order of the index, rare grams first) that what
each text has from there on can still reach the threshold. Only postings for which this holds
are joined, and the pairs found are scored as a whole. For a frequent gram few texts keep a posting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import expressions as E
from ..functions.metrics import SIMILARITY
from .scorer import Scorer

INDEXED = ("dice.similarity", "cosine.similarity", "tversky.similarity")


def grams_of(text: Column, n: int, is_array: bool) -> Column:
    if not is_array:
        return E.grams(text, n)
    elements = F.transform(text, lambda x: x.cast("string"))
    if n == 1:
        return F.coalesce(elements, F.array().cast("array<string>"))
    count = F.size(elements) - F.lit(n - 1)
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(elements, i, F.lit(n)), "\u0001"))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class GramIndex:
    """``postings (id, gram, n, w)``, ``totals (id, text, grams, norm, mass)`` of a table ``(id, text)``, and how ``often`` each gram occurs."""

    postings: DataFrame
    totals: DataFrame
    size: int
    weights: tuple | None = None
    default: float = 1.0

    @classmethod
    def build(cls, rows: DataFrame, gram_size: int, weights: tuple | None = None, default: float = 1.0) -> GramIndex:
        """``rows``: ``id`` and ``text`` (string or array)."""
        is_array = isinstance(rows.schema["text"].dataType, ArrayType)
        grams = grams_of(F.col("text"), gram_size, is_array)
        price = F.lit(1.0)
        if weights is not None:
            table = F.create_map(*(F.lit(x) for pair in weights for x in (str(pair[0]), float(pair[1])))) if weights else None
            price = F.lit(float(default)) if table is None else F.coalesce(F.try_element_at(table, F.col("gram")), F.lit(float(default)))
        postings = rows.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n")).withColumn("w", price)
        sums = postings.groupBy("id").agg(F.sum("n").alias("grams"), F.sum(F.col("n") * F.col("n")).alias("norm"), F.sum(F.col("n") * F.col("w")).alias("mass"))
        totals = rows.select("id", "text").join(sums, "id", "left").na.fill({"grams": 0, "norm": 0, "mass": 0.0})
        return cls(postings, totals, gram_size, weights, default)

    @property
    def often(self) -> DataFrame:
        return self.postings.groupBy("gram").agg(F.sum("n").alias("often"))

    def cached(self) -> GramIndex:
        return GramIndex(self.postings.cache(), self.totals.cache(), self.size, self.weights, self.default)

    def opening(self, often: DataFrame, least: Callable[[str], Column], amount: Column) -> DataFrame:
        """``(id, gram)`` of the postings from which on a text has enough (of ``amount`` a posting) to reach ``least`` of its total."""
        each = self.postings.join(often, "gram", "left").withColumn("amount", amount.cast("double"))
        onwards = Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(0)).desc(), F.col("gram").desc()).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("amount").over(Window.partitionBy("id"))
        kept = each.withColumn("rest", F.sum("amount").over(onwards)).withColumn("total", total)
        return kept.where((F.col("amount") > 0) & (F.col("rest") >= least(F.col("total")) * (1 - 1e-9) - 1e-9)).select("id", "gram")


def supports(scorer: Scorer) -> bool:
    return scorer.name in INDEXED and "element_similarity" not in dict(scorer.config)


def for_scorer(rows: DataFrame, scorer: Scorer) -> GramIndex:
    config = dict(scorer.config)
    return GramIndex.build(rows, config.get("gram_size", 2), config.get("element_weights"), config.get("default_element_weight", 1.0))


def _least_shared(scorer: Scorer, threshold: float) -> tuple[Callable, Callable, Column] | None:
    """What each side must share of its total for the threshold, as functions of the total, and what a posting adds to it."""
    config, family = dict(scorer.config), scorer.name.split(".")[0]
    if family == "cosine":  # the part of the square sum from the first shared gram on
        part = lambda total: total * threshold**2
        return part, part, F.col("n") * F.col("n")
    alpha, beta = (0.5, 0.5) if family == "dice" else (config.get("alpha", 0.5), config.get("beta", 0.5))
    need = [threshold * x / (1 - threshold + threshold * x) if x else 0.0 for x in (alpha, beta)]
    return *(lambda total, share=share: total * share for share in need), F.col("n") * F.col("w")


def _alike(queries: GramIndex, choices: GramIndex, scorer: Scorer, threshold: float) -> DataFrame:
    """``(q, c, score)`` of the pairs that share a gram with weight and meet a threshold above 0."""
    first, second, amount = _least_shared(scorer, threshold)
    often = choices.often
    left = queries.opening(often, first, amount).select(F.col("id").alias("q"), "gram")
    right = choices.opening(often, second, amount).select(F.col("id").alias("c"), "gram")
    pairs = left.join(right, "gram").select("q", "c").distinct()
    pairs = pairs.join(queries.totals.select(F.col("id").alias("q"), F.col("text").alias("x")), "q").join(choices.totals.select(F.col("id").alias("c"), F.col("text").alias("y")), "c")
    return pairs.withColumn("score", scorer.column(F.col("x"), F.col("y"), threshold, once=True)).where("score is not null").select("q", "c", "score")


def scores(queries: GramIndex, choices: GramIndex, scorer: Scorer, threshold: float | None = None) -> DataFrame:
    """``(q, c, score)`` of every pair that shares a gram, and of equal texts without a gram; with a threshold above 0 of those that meet it."""
    if scorer.direction != SIMILARITY or not supports(scorer):
        raise TypeError(f"{scorer.name} has no gram index")
    if threshold is not None and threshold > 0:
        found = _alike(queries, choices, scorer, threshold)
        return found.unionByName(_bare(queries, choices)).where(F.col("score") >= threshold)
    config = dict(scorer.config)
    left = queries.postings.select(F.col("id").alias("q"), "gram", F.col("n").alias("qn"))
    right = choices.postings.select(F.col("id").alias("c"), "gram", F.col("n").alias("cn"), "w")
    least = F.least("qn", "cn")
    summed = left.join(right, "gram").groupBy("q", "c").agg(F.sum(least).alias("shared"), F.sum(F.col("qn") * F.col("cn")).alias("dot"), F.sum(least * F.col("w")).alias("shared_mass"))
    a = queries.totals.select(F.col("id").alias("q"), F.col("grams").alias("qg"), F.col("norm").alias("qs"), F.col("mass").alias("qm"))
    b = choices.totals.select(F.col("id").alias("c"), F.col("grams").alias("cg"), F.col("norm").alias("cs"), F.col("mass").alias("cm"))
    pairs = summed.join(a, "q").join(b, "c")
    family = scorer.name.split(".")[0]
    if family == "dice":
        score = 2.0 * F.col("shared") / (F.col("qg") + F.col("cg"))
    elif family == "cosine":
        score = F.least(F.lit(1.0), F.col("dot") / F.sqrt((F.col("qs") * F.col("cs")).cast("double")))
    else:
        alpha, beta = config.get("alpha", 0.5), config.get("beta", 0.5)
        weighted = "element_weights" in config
        shared, first, second = ("shared_mass", "qm", "cm") if weighted else ("shared", "qg", "cg")
        own, x, y = F.col(shared).cast("double"), F.col(first), F.col(second)
        below = own + F.lit(alpha) * (x - own) + F.lit(beta) * (y - own)
        score = F.when(below > 0, own / below).otherwise(0.0)
    found = pairs.where(F.col("shared_mass") > 0).select("q", "c", score.alias("score"))
    return found.unionByName(_bare(queries, choices))


def _bare(queries: GramIndex, choices: GramIndex) -> DataFrame:
    """Texts without priced grams share nothing: they are alike only if they are equal."""
    bare = F.col("mass") == 0
    bag = lambda t: t if not isinstance(queries.totals.schema["text"].dataType, ArrayType) else F.array_sort(t)
    x = queries.totals.where(bare).select(F.col("id").alias("q"), bag(F.col("text")).alias("text"))
    y = choices.totals.where(bare).select(F.col("id").alias("c"), bag(F.col("text")).alias("text"))
    return x.join(y, "text").select("q", "c", F.lit(1.0).alias("score"))
