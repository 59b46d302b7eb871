"""Batches of scores: all pairs of two tables, or pairs that stand side by side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import SIMILARITY
from ..plans import thresholds as T
from .scorer import Scorer

#: Storage by name: Spark type, smallest and largest value. Unsigned kinds take the next wider signed type.
KINDS = {
    "f64": ("double", None, None), "f32": ("float", None, None), "i32": ("int", -(2**31), 2**31 - 1), "i16": ("smallint", -(2**15), 2**15 - 1), "i8": ("tinyint", -128, 127),
    "u32": ("bigint", 0, 2**32 - 1), "u16": ("int", 0, 2**16 - 1), "u8": ("smallint", 0, 255), "u8c": ("smallint", 0, 255),
}


#: Pairs of a block that are made together, and about as many as a task makes, unless that takes too many tasks.
BLOCK_PAIRS, MOST_TASKS = 1 << 18, 10_000


def rejected(scorer: Scorer, threshold: float) -> float:
    """What a pair that misses the threshold is stored as."""
    worst = scorer.bounds[0] if scorer.direction == SIMILARITY else scorer.bounds[1]
    if scorer.function is not None or T.impossible(scorer.direction, scorer.bounds, threshold):
        return worst
    if scorer.direction == SIMILARITY:
        return 0.0
    if scorer.bounds[1] == 1.0:
        return 1.0
    fractional = any(float(w) != int(w) for w in dict(scorer.config).get("weights", ()))
    return threshold + 1 if fractional else math.trunc(threshold) + 1.0


def stored(score: Column, kind: str = "f64", multiplier: float = 1.0) -> Column:
    """The score times ``multiplier`` as ``kind``: halves are rounded away from zero, out of range fails (u8c saturates)."""
    if kind not in KINDS:
        raise ValueError(f"into must be one of {', '.join(KINDS)}")
    if isinstance(multiplier, bool) or not isinstance(multiplier, (int, float)) or not math.isfinite(multiplier):
        raise ValueError("score_multiplier must be a finite number")
    spark_type, low, high = KINDS[kind]
    value = score * F.lit(float(multiplier))
    if low is None:
        return value.cast(spark_type)
    value = F.signum(value) * F.floor(F.abs(value) + 0.5)
    if kind == "u8c":
        return F.greatest(F.lit(low), F.least(F.lit(high), value)).cast(spark_type)
    fails = F.raise_error(F.concat(F.lit(f"a score is out of the range of {kind}: "), value.cast("string"))).cast(spark_type)
    return F.when((value >= low) & (value <= high), value.cast(spark_type)).otherwise(fails)


def _scored(pairs: DataFrame, scorer: Scorer, left: str, right: str, threshold, into: str, multiplier: float) -> DataFrame:
    threshold = T.checked(threshold)
    score = scorer.column(F.col(left), F.col(right), threshold)
    if threshold is not None and not T.needless(scorer.direction, scorer.bounds, threshold):
        score = F.coalesce(score, F.lit(rejected(scorer, threshold)))
    return pairs.withColumn("score", stored(score, into, multiplier))


def score_pairs(pairs: DataFrame, scorer: Scorer, left: str = "left", right: str = "right", threshold: float | None = None, into: str = "f64", score_multiplier: float = 1.0, normalize=None) -> DataFrame:
    """The rows with a ``score`` of their two columns."""
    if normalize is not None:
        pairs = pairs.withColumn(left, normalize(F.col(left))).withColumn(right, normalize(F.col(right)))
    return _scored(pairs, scorer, left, right, threshold, into, score_multiplier)


def zip_pairs(left: DataFrame, right: DataFrame, index: str = "i") -> DataFrame:
    """Pairs by position: both tables need the same positions, each once, else an error."""
    joined = left.join(right, index, "full")
    sides = [c for c in joined.columns if c != index]
    here = F.col(sides[0]).isNull() | F.col(sides[-1]).isNull()
    return joined.withColumn(sides[0], F.when(here, F.raise_error(F.lit("both sides must have the same length")).cast(joined.schema[sides[0]].dataType)).otherwise(F.col(sides[0])))


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[tuple[Column, Column]]) -> DataFrame:
    """All pairs of rows whose two columns of each of ``block`` are equal and not null, with both sides' columns, which differ by name.

    Blocks are counted first (a job), and dealt over as many tasks as their pairs need, however few files the
    sides have. A block of more than ``BLOCK_PAIRS`` pairs is cut: each part has a share of its larger side's
    rows and all of the smaller one's.
    """
    mark = "_" * (1 + max(map(len, left.columns + right.columns)))  # longer than any column's name
    keys = [f"{mark}{i}" for i in range(len(block))]
    n, m, cuts, cut = (mark + x for x in ("n", "m", "cuts", "cut"))
    sides = [side.select("*", *(on[i].alias(k) for k, on in zip(keys, block, strict=True))) for i, side in enumerate((left, right))]
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(x)) for side, x in zip(sides, (n, m), strict=True)]
    sizes = counts[0].join(counts[1], keys).withColumn(cuts, F.least(F.ceil(F.col(n) * F.col(m) / BLOCK_PAIRS), F.greatest(n, m).cast("long")))
    total, most = sizes.agg(F.sum(F.col(n) * F.col(m)), F.max(cuts)).first()
    tasks = min(math.ceil((total or 0) / BLOCK_PAIRS), MOST_TASKS)
    if tasks > 1 and most > 1:
        larger = F.col(n) >= F.col(m)
        own, every = F.array(F.pmod(F.xxhash64(*left.columns), F.col(cuts))), F.sequence(F.lit(0).cast("long"), F.col(cuts) - 1)
        of_right = F.array(F.pmod(F.xxhash64(*right.columns), F.col(cuts)))
        at = F.when(larger, own).otherwise(every), F.when(larger, every).otherwise(of_right)
        sides = [side.join(sizes, keys).withColumn(cut, F.explode(x)).drop(n, m, cuts) for side, x in zip(sides, at, strict=True)]
        keys = [*keys, cut]
    if tasks > 1:
        sides = [side.repartition(tasks, *keys) for side in sides]
    return sides[0].join(sides[1], keys).select(*left.columns, *right.columns)


def score_matrix(queries: DataFrame, choices: DataFrame, scorer: Scorer, text: str = "text", position: str = "i", threshold: float | None = None, into: str = "f64", score_multiplier: float = 1.0, normalize=None) -> DataFrame:
    """``(row, col, score)`` of all pairs, which is what a matrix is.

    Distinct texts are scored once. If both sides are the same DataFrame and the scorer is
    symmetric, one half is scored and mirrored.
    """
    own = (lambda df: df.withColumn(text, normalize(F.col(text)))) if normalize is not None else (lambda df: df)
    q, c = own(queries).select(F.col(position).alias("row"), F.col(text).alias("q")), own(choices).select(F.col(position).alias("col"), F.col(text).alias("c"))
    left, right = q.select("q").distinct(), c.select("c").distinct()
    mirrored = queries is choices and scorer.symmetric
    pairs = left.crossJoin(right)
    pairs = pairs.where((F.col("q") <= F.col("c")) | F.col("q").isNull() | F.col("c").isNull()) if mirrored else pairs
    scored = _scored(pairs, scorer, "q", "c", threshold, into, score_multiplier)
    if mirrored:
        scored = scored.unionByName(scored.where("q < c").select(F.col("c").alias("q"), F.col("q").alias("c"), "score"))
    scored = scored.select(F.col("q").alias("x"), F.col("c").alias("y"), "score")
    return q.join(scored, q["q"].eqNullSafe(scored["x"])).join(c, scored["y"].eqNullSafe(c["c"])).select("row", "col", "score")


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """``(row, scores)``: each row's scores in order of columns."""
    cells = F.array_sort(F.collect_list(F.struct("col", "score")))
    return matrix.groupBy("row").agg(F.transform(cells, lambda x: x["score"]).alias("scores"))
