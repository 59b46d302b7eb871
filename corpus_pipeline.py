"""A cleaning pipeline over ``documents``: five stages, each by one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import akin
from akin.llm import bpe, decontam, langid, linededup, neardup
from akin.llm.graphs import sized
from akin.llm.queries import fold, table, tokenizer
from akin.llm.text import checkpointed


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those named by ``(id, mark)``, mark being the text's hash; the names are broadcast only if they are few."""
    own = [f"{name}_" * (1 + max(map(len, docs.columns)) // 3) for name in ("id", "mark")]  # longer than any column's name
    gone = sized(checkpointed(docs.sparkSession, gone.distinct().toDF(*own)))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[own[0]]) & F.xxhash64(docs["text"]).eqNullSafe(gone[own[1]]), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects. The model learns from two thirds of the labelled ones."""
    akin.prepare(spark)
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    into = "language" + "_" * max(map(len, docs.columns))
    return langid.predict(docs, model, into=into).where(~F.col(f"{into}.rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes common line blocks from later documents; a document that this empties goes."""
    akin.prepare(spark)
    into = "removed" + "_" * max(map(len, docs.columns))
    found = linededup.remove_common_blocks(docs, into=into)
    found = found.where((F.col(into) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(into) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the smallest id, then the smallest hash; and one row of equal ids and texts."""
    akin.prepare(spark)
    kept = _without(docs, neardup.later_copies(docs))
    mark = "mark_" * (1 + max(map(len, docs.columns)) // 4)
    named = kept.withColumn(mark, F.xxhash64("text"))
    if not docs.groupBy("doc_id", F.xxhash64("text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = named.dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a full benchmark window, or windows of two short items or more."""
    akin.prepare(spark)
    named = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")).alias("key"), "text")
    found = decontam.scan(named, table(spark, sf_dir, "benchmark"), id_col="key")
    return _without(docs, found.where((F.col("whole_items") > 0) | (F.size("items") >= 2)).select("key.id", "key.mark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; counts and digests of ids and bytes."""
    akin.prepare(spark)
    ranks, pattern = tokenizer()
    return bpe.digest(docs, ranks, pattern)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: No stage but decontamination can be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(spark, docs)
    return docs
