"""Soft Tversky over token arrays: evidence columns, and search by token candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.metrics import kernel_column
from ..plans import thresholds as T
from .editops import _column
from .scorer import Scorer
from .search import Matcher, _questions, similarity_join, text_id

_SIDE = "array<struct<element:string,index:int,weight:double,unmatched_mass:double>>"
EVIDENCE = (
    "struct<score:double,similarity:double,"
    "totals:struct<first_mass:double,second_mass:double,shared_mass:double,first_unmatched_mass:double,second_unmatched_mass:double>,"
    "matches:array<struct<first:string,second:string,first_index:int,second_index:int,exact:boolean,similarity:double,first_weight:double,second_weight:double,"
    f"shared_mass:double,first_unmatched_mass:double,second_unmatched_mass:double>>,unmatched_first:{_SIDE},unmatched_second:{_SIDE}>"
)


def explain_column(scorer: Scorer, left: Column, right: Column) -> Column:
    """Evidence for each row's score; null where a side is missing."""
    options = scorer._explaining()
    far = scorer.direction == "distance"

    def explain(a, b):
        found = K.explain(a, b, **options)
        return found | {"score": 1 - found["similarity"] if far else found["similarity"]}

    return _column(explain, EVIDENCE, left, right)


@dataclass(frozen=True)
class SoftIndexedMatcher(Matcher):
    """Candidates share a token, or have tokens alike enough; only they are scored.

    Alike tokens come from a similarity join of the distinct tokens of both sides. Pairs
    without a candidate score 0, so with a threshold above 0 nothing is lost; without one, or
    where a side has no priced token, all pairs are scored.
    """

    def search_iter(self, query, threshold: float | None = None, query_key: str = "q", query_text: str = "query") -> DataFrame:
        threshold = T.checked(threshold)
        questions = _questions(query, self.choices.sparkSession, self.normalize, query_key, query_text)
        if threshold is None or threshold <= 0:
            return similarity_join(questions, self.choices, self.scorer, threshold)
        config = dict(self.scorer.config)
        inner, least = config["element_similarity"]
        low, high = inner.bounds
        # Distinct texts are scored, and joined back with their rows.
        named = questions.where("query is not null").withColumn("qid", text_id(F.col("query"), True))
        held = self.choices.where("text is not null").withColumn("tid", text_id(F.col("text"), True))
        asked, texts = named.select("qid", "query").dropDuplicates(["qid"]), held.select("tid", "text").dropDuplicates(["tid"])
        ours = asked.select("qid", F.explode("query").alias("token")).distinct()
        theirs = texts.select("tid", F.explode("text").alias("token")).distinct()
        words = lambda side, name: side.select("token").distinct().where(F.length("token") > 1).select(F.xxhash64("token").alias(name), "token")
        a, b = words(ours, "q"), words(theirs, "key")
        alike = similarity_join(a.select("q", F.col("token").alias("query")), b.select("key", F.col("key").alias("ord"), F.col("token").alias("item"), F.col("token").alias("text")), inner, low + least * (high - low) - 1e-9)
        near = alike.join(a, "q").withColumnRenamed("token", "x").join(b, "key").select("x", F.col("token").alias("y"))
        near = near.unionByName(ours.select(F.col("token").alias("x"), F.col("token").alias("y")).distinct())
        found = ours.join(near, ours["token"] == near["x"]).select("qid", "y").join(theirs, F.col("y") == theirs["token"]).select("qid", "tid").distinct()
        weights, default = config.get("element_weights"), config.get("default_element_weight", 1.0)
        priced = lambda c: F.lit(True) if weights is None else F.exists(c, lambda x: ~x.isin([w for w, v in weights if v == 0]) if default else x.isin([w for w, v in weights if v > 0]))
        bare_q, bare_c = asked.where((F.size("query") == 0) | ~priced("query")).select("qid"), texts.where((F.size("text") == 0) | ~priced("text")).select("tid")
        found = found.unionByName(bare_q.crossJoin(bare_c)).distinct()
        pairs = found.join(asked, "qid").join(texts, "tid")
        score = kernel_column(self.scorer.metric.kernel, config, F.col("query"), F.col("text"), 0.0, once=True)
        scored = pairs.select("qid", "tid", score.alias("score")).where(F.col("score") >= threshold)
        return named.select("q", "qid").join(scored, "qid").join(held.select("key", "ord", "tid"), "tid").select("q", "key", "ord", "score")
