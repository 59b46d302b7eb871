"""Collections as DataFrames ``(key, ord, text)``.

A list's keys are its positions, a mapping's are its own; ``ord`` keeps the source order,
which decides ties.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_values(spark: SparkSession, items: Iterable | Mapping, kind: str = "string") -> DataFrame:
    """A collection of texts (or, with ``kind='array<string>'``, of sequences). A bare string is refused."""
    if isinstance(items, (str, bytes)):
        raise TypeError("a collection is a list or mapping of texts, not one text")
    pairs = items.items() if isinstance(items, Mapping) else enumerate(items)
    rows = [(key, i, text) for i, (key, text) in enumerate(pairs)]
    key = "string" if isinstance(items, Mapping) else "long"
    return spark.createDataFrame([(str(k) if key == "string" else k, i, t) for k, i, t in rows], f"key {key}, ord long, text {kind}")


def from_table(df: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(order or key).alias("ord"), F.col(text).alias("text"))


def read_collection(spark: SparkSession, path: str, key: str, text: str, order: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """A collection from any source Spark reads; only the columns named are read."""
    return from_table(spark.read.format(format).options(**options).load(path), key, text, order)


def write_index(postings: DataFrame, table: str, buckets: int = 200) -> None:
    """Postings as a table bucketed by gram, so that later joins on the gram needn't shuffle them."""
    postings.write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(table)
