"""Searches: each query's best choices, or all that meet a threshold.

Choices are a DataFrame with a key, a source order and a text; queries are one text or a
DataFrame with an id and a text. Ties go to the smaller order. A missing choice is skipped
(or fails), keys are never renumbered. A missing query scores 0 with every present choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import expressions as E
from ..functions.metrics import SIMILARITY
from ..plans import thresholds as T
from ..plans.bounds import Edits, edits, length_bound
from . import index as X
from .scorer import Scorer

Normalize = Callable[[Column], Column] | None
GRAM_FILTER = 3
TOKEN_RATIOS = ("fuzz.token_set_ratio", "fuzz.token_sort_ratio", "fuzz.token_ratio")


def prepared(choices: DataFrame, key: str = "key", text: str | Column = "text", order: str | None = None, normalize: Normalize = None, missing_items: str = "skip") -> DataFrame:
    """``(key, ord, item, text)`` of a collection; ``ord`` is the key if no order is named."""
    if missing_items not in ("skip", "throw"):
        raise ValueError("missing_items must be skip or throw")
    raw = F.col(text) if isinstance(text, str) else text
    own = raw if normalize is None else normalize(raw)
    rows = choices.select(F.col(key).alias("key"), F.col(order or key).alias("ord"), raw.alias("item"), own.alias("text"))
    if missing_items == "skip":
        return rows.where(F.col("item").isNotNull())
    return rows.withColumn("text", F.when(F.col("item").isNull(), F.raise_error(F.lit("a choice is missing")).cast(rows.schema["text"].dataType)).otherwise(F.col("text")))


@dataclass(frozen=True)
class PreparedChoices:
    """Choices prepared by one scorer and normaliser, for that scorer and normaliser only."""

    rows: DataFrame
    scorer: Scorer
    normalize: Normalize = None

    def checked(self, scorer: Scorer, normalize: Normalize, given: dict) -> DataFrame:
        if scorer != self.scorer:
            raise ValueError("the choices were prepared by another scorer")
        if normalize is not self.normalize:
            raise ValueError("the choices were prepared with another normalizer")
        if given:
            raise TypeError(f"prepared choices take no {', '.join(sorted(given))}")
        return self.rows


def prepare_choices(choices: DataFrame, scorer: Scorer, key: str = "key", text: str | Column = "text", order: str | None = None, normalize: Normalize = None, missing_items: str = "skip") -> PreparedChoices:
    """Choices to be given to several matchers of the same scorer; cached on first use."""
    return PreparedChoices(prepared(choices, key, text, order, normalize, missing_items).cache(), scorer, normalize)


def _rows(choices, scorer: Scorer, normalize: Normalize, options: dict, cache: bool) -> DataFrame:
    if isinstance(choices, PreparedChoices):
        return choices.checked(scorer, normalize, options)
    rows = prepared(choices, normalize=normalize, **options)
    return rows.cache() if cache else rows


def _questions(query, spark, normalize: Normalize, query_key: str, query_text: str) -> DataFrame:
    """``(q, query)``; one text is one row with id 0."""
    if isinstance(query, DataFrame):
        text = F.col(query_text)
        rows = query.select(F.col(query_key).alias("q"), text.alias("raw"))
    else:
        kind = "array<string>" if isinstance(query, (list, tuple)) else "string"
        value = F.array(*(F.lit(x) for x in query)) if isinstance(query, (list, tuple)) else F.lit(query)
        rows = spark.range(1).select(F.col("id").alias("q"), value.cast(kind).alias("raw"))
    own = F.col("raw") if normalize is None else normalize(F.col("raw"))
    return rows.select("q", own.alias("query"))


def _length(c: str, schema) -> Column:
    return F.size(c) if isinstance(schema[c].dataType, ArrayType) else F.length(c)


def text_id(text: Column, is_array: bool) -> Column:
    """16 bytes that stand for a text in joins, so that no shuffled posting carries the text itself."""
    return F.unhex(F.md5(F.to_json(text) if is_array else text))


def similarity_join(questions: DataFrame, choices: DataFrame, scorer: Scorer, threshold: float | None = None) -> DataFrame:
    """``(q, key, ord, score)`` of all pairs of ``(q, query)`` and :func:`prepared` choices that meet a threshold.

    Equal texts are scored once. Candidates come from, in this order: a gram index for the
    bag metrics (threshold above 0), rare shared grams for edit distances and ratio, shared
    tokens and the derived texts' grams for token ratios, the lengths.
    """
    threshold = T.checked(threshold)
    is_array = isinstance(choices.schema["text"].dataType, ArrayType)
    named = questions.where("query is not null").withColumn("qid", text_id(F.col("query"), is_array))
    held = choices.where("text is not null").withColumn("tid", text_id(F.col("text"), is_array))
    asked, texts = named.select("qid", "query").dropDuplicates(["qid"]), held.select("tid", "text").dropDuplicates(["tid"])
    if T.impossible(scorer.direction, scorer.bounds, threshold):
        scored = asked.crossJoin(texts).where(F.lit(False)).select("qid", "tid", F.lit(0.0).alias("score"))
    elif threshold is not None and threshold > 0 and X.supports(scorer):
        left, right = X.for_scorer(asked.toDF("id", "text"), scorer), X.for_scorer(texts.toDF("id", "text"), scorer)
        scored = X.scores(left, right, scorer, threshold).select(F.col("q").alias("qid"), F.col("c").alias("tid"), "score")
    else:
        pairs = _candidates(asked, texts, scorer, threshold, is_array)
        pairs = asked.crossJoin(texts) if pairs is None else pairs.join(asked, "qid").join(texts, "tid")
        scored = pairs.withColumn("score", scorer.column(F.col("query"), F.col("text"), threshold, once=True)).where("score is not null").select("qid", "tid", "score")
    found = named.select("q", "qid").join(scored, "qid").join(held.select("key", "ord", "tid"), "tid").select("q", "key", "ord", "score")
    absent = questions.where("query is null").select("q")
    if scorer.direction == SIMILARITY and scorer.missing == "compatible":
        if threshold is None or threshold <= 0:
            found = found.unionByName(absent.crossJoin(choices.where("item is not null").select("key", "ord")).withColumn("score", F.lit(0.0)))
        return found
    fails = F.raise_error(F.lit("the query is missing")).cast("double")
    return found.unionByName(absent.crossJoin(F.broadcast(choices.select("key", "ord").limit(1))).withColumn("score", fails))  # one choice is enough to fail


def _candidates(asked: DataFrame, texts: DataFrame, scorer: Scorer, threshold: float | None, is_array: bool) -> DataFrame | None:
    """``(qid, tid)`` of pairs among which are all that qualify; None if any pair may."""
    if threshold is None or T.needless(scorer.direction, scorer.bounds, threshold):
        return None
    config = dict(scorer.config)
    if not is_array and scorer.name in TOKEN_RATIOS and threshold > 0:
        return _token_candidates(asked, texts, scorer.name, threshold)
    bound = lambda a, b: length_bound(scorer.name, config, threshold, a, b)
    allowed = None if is_array else edits(scorer.name, config, threshold)
    if allowed is not None:
        return _gram_candidates(asked, texts, allowed, bound)
    sizes = (asked.select("qid", _length("query", asked.schema).alias("a")), texts.select("tid", _length("text", texts.schema).alias("b")))
    return None if bound(F.col("a"), F.col("b")) is None else _by_length(*sizes, bound(F.col("a"), F.col("b")))


def _by_length(left: DataFrame, right: DataFrame, fits: Column) -> DataFrame:
    """Pairs of texts whose lengths fit: the lengths that occur, of which there are few, are paired first."""
    lengths = left.select("a").distinct().join(F.broadcast(right.select("b").distinct()), fits)
    return left.join(lengths, "a").join(right, "b").select("qid", "tid")


def _gram_candidates(asked: DataFrame, texts: DataFrame, allowed: Edits, bound: Callable) -> DataFrame:
    """Pairs that share one of their rarest grams, and those of lengths too short for that to be sure.

    A text's occurrences of grams are put in an order that all texts share, the rarest first; of
    two qualifying texts the beginnings (of a length that the edits allow) hold a common one.
    """
    n, a, b = GRAM_FILTER, F.col("a"), F.col("b")
    fits, least = bound(a, b), allowed.shared(n, a, b)
    fits = F.lit(True) if fits is None else fits
    left, right = asked.select("qid", F.length("query").alias("a"), "query"), texts.select("tid", F.length("text").alias("b"), "text")
    counted = []
    for side, key, size, text in ((left, "qid", "a", "query"), (right, "tid", "b", "text")):
        grams = side.select(key, size, F.explode(X.grams_of(F.col(text), n, False)).alias("gram"))
        counted.append(grams.groupBy(key, size, "gram").agg(F.count(F.lit(1)).alias("times")))
    often = counted[0].select("gram", "times").unionByName(counted[1].select("gram", "times")).groupBy("gram").agg(F.sum("times").alias("often"))
    openings = []
    for side, key, size in ((counted[0], "qid", "a"), (counted[1], "tid", "b")):
        each = side.join(often, "gram").select(key, size, "gram", "often", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
        rare = F.row_number().over(Window.partitionBy(key).orderBy("often", "gram", "nth"))
        openings.append(each.withColumn("at", rare).where(F.col("at") <= allowed.opening(n, F.col(size))).select(key, size, "gram", "nth"))
    by_grams = openings[0].join(openings[1], ["gram", "nth"]).where(fits & (least > 0)).select("qid", "tid").distinct()
    return by_grams.unionByName(_by_length(left.select("qid", "a"), right.select("tid", "b"), fits & (least <= 0)))


def _token_candidates(asked: DataFrame, texts: DataFrame, name: str, threshold: float) -> DataFrame:
    """Candidates of token ratios: texts that share a token, and those whose sorted tokens are alike without."""
    allowed, found = edits("fuzz.ratio", {}, threshold), []
    bound = lambda a, b: length_bound("fuzz.ratio", {}, threshold, a, b)
    sets = lambda side, key, text: side.select(key, F.array_distinct(E.tokens(F.col(text))).alias("t"))
    if name != "fuzz.token_sort_ratio":
        left, right = sets(asked, "qid", "query"), sets(texts, "tid", "text")
        found.append(left.select("qid", F.explode("t").alias("token")).join(right.select("tid", F.explode("t").alias("token")), "token").select("qid", "tid"))
        joined = lambda side, key, to: side.select(key, F.array_join(F.array_sort("t"), " ").alias(to))
        found.append(_gram_candidates(joined(left, "qid", "query"), joined(right, "tid", "text"), allowed, bound))
    if name != "fuzz.token_set_ratio":
        found.append(_gram_candidates(asked.select("qid", E.token_sort(F.col("query")).alias("query")), texts.select("tid", E.token_sort(F.col("text")).alias("text")), allowed, bound))
    return reduce(DataFrame.unionByName, found).distinct()


def _ranked(found: DataFrame, scorer: Scorer, limit: int | None) -> DataFrame:
    w = Window.partitionBy("q").orderBy(T.better_first(scorer.direction, F.col("score")), "ord")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _limit(limit) -> int | None:
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("limit must be None or an integer of 0 or more")
    return limit


@dataclass(frozen=True)
class Matcher:
    """A collection prepared once for many searches. Later changes of the source aren't seen if it is cached."""

    choices: DataFrame
    scorer: Scorer
    normalize: Normalize = None

    @property
    def size(self) -> int:
        return self.choices.count()

    def search(self, query, threshold: float | None = None, limit: int | None = 5, query_key: str = "q", query_text: str = "query") -> DataFrame:
        """``(q, key, ord, score, rank)``, best first."""
        return _ranked(self.search_iter(query, threshold, query_key, query_text), self.scorer, _limit(limit))

    def best(self, query, threshold: float | None = None, query_key: str = "q", query_text: str = "query") -> DataFrame:
        """Each query's first best choice: an aggregate, so no rank is sorted."""
        found = self.search_iter(query, threshold, query_key, query_text)
        sign = -1 if self.scorer.direction == SIMILARITY else 1
        best = F.min_by(F.struct("key", "ord", "score"), F.struct((sign * F.col("score")).alias("s"), "ord"))
        return found.groupBy("q").agg(best.alias("m")).select("q", "m.key", "m.ord", "m.score")

    def search_iter(self, query, threshold: float | None = None, query_key: str = "q", query_text: str = "query") -> DataFrame:
        """Every qualifying choice, unranked; read it lazily with ``toLocalIterator``."""
        questions = _questions(query, self.choices.sparkSession, self.normalize, query_key, query_text)
        return similarity_join(questions, self.choices, self.scorer, threshold)


@dataclass(frozen=True)
class IndexedMatcher(Matcher):
    """The same results for bag metrics through an inverted index built once."""

    postings: X.GramIndex | None = None

    def search_iter(self, query, threshold: float | None = None, query_key: str = "q", query_text: str = "query") -> DataFrame:
        threshold = T.checked(threshold)
        questions = _questions(query, self.choices.sparkSession, self.normalize, query_key, query_text)
        if threshold is None or threshold <= 0:  # choices that share nothing belong to the result
            touched = self._touched(questions)
            every = questions.select("q").crossJoin(self.choices.select("key", "ord"))
            rest = every.join(touched.select("q", "key"), ["q", "key"], "left_anti").withColumn("score", F.lit(0.0))
            return touched.unionByName(rest)
        return self._touched(questions, threshold)

    def search(self, query, threshold: float | None = None, limit: int | None = 5, query_key: str = "q", query_text: str = "query") -> DataFrame:
        limit, threshold = _limit(limit), T.checked(threshold)
        if limit is None or (threshold is not None and threshold > 0):
            return super().search(query, threshold, limit, query_key, query_text)
        # Of choices that share nothing only the first few can be needed: twice the limit holds enough.
        questions = _questions(query, self.choices.sparkSession, self.normalize, query_key, query_text)
        touched = self._touched(questions)
        first = self.choices.orderBy("ord").limit(2 * limit).select("key", "ord")
        best = _ranked(touched, self.scorer, 2 * limit).drop("rank")
        fill = questions.select("q").crossJoin(F.broadcast(first)).join(touched.select("q", "key"), ["q", "key"], "left_anti").withColumn("score", F.lit(0.0))
        return _ranked(best.unionByName(fill), self.scorer, limit)

    def _touched(self, questions: DataFrame, threshold: float | None = None) -> DataFrame:
        asked = X.for_scorer(questions.where("query is not null").select(F.col("q").alias("id"), F.col("query").alias("text")), self.scorer)
        scored = X.scores(asked, self.postings, self.scorer, threshold)
        return scored.join(self.choices.select(F.col("key").alias("c"), F.col("key"), "ord"), "c").select("q", "key", "ord", "score")


def create_matcher(choices: DataFrame | PreparedChoices, scorer: Scorer, normalize: Normalize = None, cache: bool = False, **options) -> Matcher:
    """``options``: key, text, order, missing_items of :func:`prepared`."""
    return Matcher(_rows(choices, scorer, normalize, options, cache), scorer, normalize)


def create_indexed_matcher(choices: DataFrame | PreparedChoices, scorer: Scorer, normalize: Normalize = None, cache: bool = False, **options) -> Matcher:
    """Needs a similarity of dice, cosine or tversky; soft Tversky goes by token candidates."""
    rows = _rows(choices, scorer, normalize, options, cache)
    if scorer.name == "tversky.similarity" and "element_similarity" in dict(scorer.config):
        from .soft import SoftIndexedMatcher

        return SoftIndexedMatcher(rows, scorer, normalize)
    if not X.supports(scorer):
        raise TypeError(f"{scorer.name} cannot be indexed")
    built = X.for_scorer(rows.select(F.col("key").alias("id"), "text"), scorer)
    return IndexedMatcher(rows, scorer, normalize, built.cached() if cache else built)


def search(query, choices: DataFrame, scorer: Scorer, threshold: float | None = None, limit: int | None = 5, **options) -> DataFrame:
    asked = {k: options.pop(k) for k in ("query_key", "query_text") if k in options}
    return create_matcher(choices, scorer, **options).search(query, threshold, limit, **asked)


def best_match(query, choices: DataFrame, scorer: Scorer, threshold: float | None = None, **options) -> DataFrame:
    asked = {k: options.pop(k) for k in ("query_key", "query_text") if k in options}
    return create_matcher(choices, scorer, **options).best(query, threshold, **asked)


def search_iter(query, choices: DataFrame, scorer: Scorer, threshold: float | None = None, **options) -> DataFrame:
    asked = {k: options.pop(k) for k in ("query_key", "query_text") if k in options}
    return create_matcher(choices, scorer, **options).search_iter(query, threshold, **asked)


def matched(questions: DataFrame, choices: DataFrame, scorer: Scorer, threshold: float, keep: bool = True, query_key: str = "q", query_text: str = "query", **options) -> DataFrame:
    """The questions that have (or, with ``keep=False``, have not) a qualifying choice."""
    found = search_iter(questions, choices, scorer, threshold, query_key=query_key, query_text=query_text, **options).select(F.col("q").alias(query_key)).distinct()
    return questions.join(found, query_key, "left_semi" if keep else "left_anti")


def contained(questions: DataFrame, choices: DataFrame) -> DataFrame:
    """``(q, key)`` of pairs where one side's token set holds the other's: their token set ratio is 100.

    Equal sets are judged once. A set can only be held by one that has its rarest token, so an
    equi-join on that token gives the candidates, which are then compared as a whole.
    """
    sides = []
    for rows, name, text in ((questions, "q", "query"), (choices, "key", "text")):
        parts = rows.select(name, F.array_sort(F.array_distinct(E.tokens(F.col(text)))).alias("t")).where(F.size("t") > 0)
        sides.append(parts.withColumn("s", F.unhex(F.md5(F.array_join("t", " ")))))
    sets = [side.select("s", "t").dropDuplicates(["s"]) for side in sides]
    each = [side.select("s", F.explode("t").alias("token")) for side in sets]
    often = each[0].unionByName(each[1]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = [side.join(often, "token").groupBy("s").agg(F.min_by("token", F.struct("n", "token")).alias("token")) for side in each]
    inner = rarest[0].select(F.col("s").alias("x"), "token").join(each[1].select(F.col("s").alias("y"), "token"), "token").select("x", "y", F.lit(True).alias("first"))
    outer = each[0].select(F.col("s").alias("x"), "token").join(rarest[1].select(F.col("s").alias("y"), "token"), "token").select("x", "y", F.lit(False).alias("first"))
    pairs = inner.unionByName(outer).join(sets[0].select(F.col("s").alias("x"), F.col("t").alias("left")), "x").join(sets[1].select(F.col("s").alias("y"), F.col("t").alias("right")), "y")
    held = F.when(F.col("first"), F.size(F.array_except("left", "right"))).otherwise(F.size(F.array_except("right", "left"))) == 0
    pairs = pairs.where(held).select("x", "y").distinct()
    return sides[0].select("q", F.col("s").alias("x")).join(pairs, "x").join(sides[1].select("key", F.col("s").alias("y")), "y").select("q", "key")
