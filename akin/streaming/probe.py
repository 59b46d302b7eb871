"""A stream of queries meets a collection that stays.

Threshold probes are stateless stream-to-static joins in append mode. Ranked results need a
sort for each query, which streams don't allow, so each micro-batch is searched on its own;
batches are written by their id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scorer import Scorer
from ..operators.search import Matcher
from ..plans import thresholds as T


def probe(stream: DataFrame, choices: DataFrame, scorer: Scorer, threshold: float, text: str = "query", block: list[tuple[str, str]] | None = None) -> DataFrame:
    """Stream rows with each choice ``(key, text)`` that meets the threshold, as ``key``, ``score``.

    ``block``: pairs of columns (stream, choices) that must be equal, to join by rather than
    comparing each query with every choice.
    """
    side = choices.select(*(F.col(c).alias(f"choice_{c}") for c in choices.columns))
    if block:
        on = [stream[a] == side[f"choice_{b}"] for a, b in block]
        joined = stream.join(side, on)
    else:
        joined = stream.crossJoin(side)
    score = scorer.column(F.col(text), F.col("choice_text"), threshold, once=True)
    found = joined.withColumn("score", score).where("score is not null")
    return found.select(*stream.columns, F.col("choice_key").alias("key"), "score")


def first_seen(stream: DataFrame, text: str, time: str, within: str) -> DataFrame:
    """Drops repeats of a text that come within a time of the first."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([text])


def search_stream(stream: DataFrame, matcher: Matcher, sink: Callable[[DataFrame, int], None], query_key: str = "q", query_text: str = "query", threshold: float | None = None, limit: int | None = 5, checkpoint: str | None = None):
    """Starts a query that gives ``sink(found, batch_id)`` each micro-batch's ranked results."""
    T.checked(threshold)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(matcher.search(batch, threshold, limit, query_key, query_text), batch_id)

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
