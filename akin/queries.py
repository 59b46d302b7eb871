"""Registered queries of the similarity engine, and SQL that gives the same rows.

Pair metrics run over all pairs of the distinct part names (scoring distinct texts and
joining back is how the engine treats repeated texts); searches run over whole tables.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .functions import expressions as E
from .functions import metrics as M
from .operators import batch as B
from .operators import editops as O
from .operators import index as X
from .operators import search as S
from .operators.alignment import partial_ratio_alignment
from .operators.scorer import create_scorer, is_match, score_if_match
from .operators.soft import explain_column


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct()


def pairs(spark, sf_dir):
    n = names(spark, sf_dir)
    return n.select(F.col("p_name").alias("a")).crossJoin(n.select(F.col("p_name").alias("b")))


def ab():
    return F.col("a"), F.col("b")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
P = "(SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x, (SELECT DISTINCT p_name FROM part) y)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL texts that SQL lacks as functions; ``a`` and ``b`` are expressions of short ASCII texts.


def lcs_sql(a: str, b: str) -> str:
    """Bit-parallel longest common subsequence over the characters' masks."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_transform(string_split({b}, ''), lambda x: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, (i + 1)::INT, 1) = x THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    step = f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce(list_prepend({full}, {mask}), {step})) END"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE (1 - (length({a}) + length({b}) - 2 * ({lcs_sql(a, b)}))::DOUBLE / (length({a}) + length({b}))) * 100 END"


def sorted_sql(a: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({a}, '\\s+'), lambda t: t <> '')), ' ')"


def set_sql(a: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({a}, '\\s+'), lambda t: t <> '')))"


def token_set_sql(rows: str) -> str:
    """``(a, b, score)`` of token set ratio."""
    text = lambda x: f"array_to_string({x}, ' ')"
    return f"""
SELECT a, b, CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 WHEN len(both_) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 100.0
  ELSE greatest(100 - 100 * (length(ta) + length(tb) - 2 * ({lcs_sql('ta', 'tb')}))::DOUBLE / (2 * length(ts) + 2 * (length(ts) > 0)::INT + length(ta) + length(tb)),
    CASE WHEN length(ts) > 0 THEN 100 - 100 * (1 + length(ta))::DOUBLE / (2 * length(ts) + 1 + length(ta)) ELSE 0 END,
    CASE WHEN length(ts) > 0 THEN 100 - 100 * (1 + length(tb))::DOUBLE / (2 * length(ts) + 1 + length(tb)) ELSE 0 END) END AS score
FROM (SELECT *, {text('da')} AS ta, {text('db')} AS tb, {text('both_')} AS ts FROM (
  SELECT *, list_sort(list_filter(sa, lambda t: list_contains(sb, t))) AS both_, list_sort(list_filter(sa, lambda t: NOT list_contains(sb, t))) AS da, list_sort(list_filter(sb, lambda t: NOT list_contains(sa, t))) AS db
  FROM (SELECT a, b, {set_sql('a')} AS sa, {set_sql('b')} AS sb FROM {rows})))"""


def partial_sql(rows: str) -> str:
    """``(a, b, score)``: best ratio of the shorter text with a window of the longer (of either, if equally long)."""
    return f"""
SELECT a, b, max(CASE WHEN length(n) = 0 AND length(h) = 0 THEN 100.0 WHEN length(n) = 0 THEN 0.0 ELSE {ratio_sql('n', 'w')} END) AS score FROM (
  SELECT a, b, n, h, substr(h, greatest(1, s)::INT, (least(length(h), s + length(n) - 1) - greatest(1, s) + 1)::INT) AS w FROM (
    SELECT a, b, n, h, unnest(range(2 - greatest(1, length(n)), length(h) + 2)) AS s FROM (
      SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS n, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS h FROM {rows}
      UNION ALL SELECT a, b, b, a FROM {rows} WHERE length(a) = length(b)))) WHERE length(w) > 0 OR length(n) = 0 GROUP BY a, b"""


def scale_sql(distance: str, most: str, rows: str = P) -> str:
    return f"""SELECT a, b, d::DOUBLE AS distance, (m - d)::DOUBLE AS similarity, CASE WHEN m > 0 THEN d::DOUBLE / m ELSE 0.0 END AS normalized_distance,
 1.0 - CASE WHEN m > 0 THEN d::DOUBLE / m ELSE 0.0 END AS normalized_similarity FROM (SELECT a, b, {distance} AS d, {most} AS m FROM {rows})"""


LONGER, BOTH = "greatest(length(a), length(b))", "(length(a) + length(b))"
_BIT = "(length(a) - 1)"
_FULL = "((1::BIGINT << length(a)) - 1)"
OSA = f"""CASE WHEN length(a) = 0 OR length(b) = 0 THEN length(a) + length(b) ELSE list_extract(list_reduce(
 list_prepend([{_FULL}, 0::BIGINT, 0::BIGINT, 0::BIGINT, length(a)],
  list_transform(string_split(b, ''), lambda x: [coalesce(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, (i + 1)::INT, 1) = x THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), 0)::BIGINT])),
 lambda s, m: list_transform([(xor((m[1] & s[1]) + s[1], s[1]) | m[1] | s[2] | ((((~s[3]) & {_FULL} & m[1]) << 1) & s[4])) & {_FULL}],
  lambda d: list_transform([s[2] | ({_FULL} & ~(d | s[1]))],
   lambda hp: list_transform([d & s[1]],
    lambda hn: [((hn << 1) | ~(d | ((hp << 1) | 1))) & {_FULL}, ((hp << 1) | 1) & d & {_FULL}, d, m[1], s[5] + ((hp >> {_BIT}) & 1) - ((hn >> {_BIT}) & 1)])[1])[1])[1]), 5) END"""
PREFIX = "list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i::INT) = left(b, i::INT)))"
POSTFIX = "list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: right(a, i::INT) = right(b, i::INT)))"
APART = "list_sum(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: (substr(a, i::INT, 1) <> substr(b, i::INT, 1))::INT))"


def _four(family, **config):
    def run(spark, sf_dir):
        kinds = ("distance", "similarity", "normalized_distance", "normalized_similarity")
        return pairs(spark, sf_dir).select("a", "b", *(getattr(family, k)(*ab(), **config).alias(k) for k in kinds))

    return run


query("m_levenshtein", scale_sql("levenshtein(a, b)", LONGER))(_four(M.levenshtein))
query("m_levenshtein_uniform_weights", scale_sql("3 * levenshtein(a, b)", f"3 * {LONGER}"))(_four(M.levenshtein, weights=(3, 3, 3)))
query("m_levenshtein_indel_weights", scale_sql(f"length(a) + length(b) - 2 * ({lcs_sql('a', 'b')})", BOTH))(_four(M.levenshtein, weights=(1, 1, 2)))
_STEP = "lambda r, c: list_reduce(list_prepend([r[1] + 1.0], list_transform(range(1, length(a) + 1), lambda i: [i::DOUBLE])), lambda l, e: list_append(l, least(l[-1] + 2.0, r[e[1]::INT + 1] + 1.0, r[e[1]::INT] + CASE WHEN unicode(substr(a, e[1]::INT, 1)) = c[1] THEN 0.0 ELSE 1.5 END)))"
WEIGHTED_LEVENSHTEIN = f"list_reduce(list_prepend(list_transform(range(0, length(a) + 1), lambda i: i * 2.0::DOUBLE), list_transform(string_split(b, ''), lambda x: [unicode(x)::DOUBLE])), {_STEP})[-1]"
_WEIGHTED_MOST = "least(2.0 * length(a) + length(b), 1.5 * least(length(a), length(b)) + CASE WHEN length(a) >= length(b) THEN 2.0 * (length(a) - length(b)) ELSE length(b) - length(a) END)"
query("m_levenshtein_weights", scale_sql(WEIGHTED_LEVENSHTEIN, _WEIGHTED_MOST))(_four(M.levenshtein, weights={"insertion": 1, "deletion": 2, "substitution": 1.5}))
query("m_indel", scale_sql(f"length(a) + length(b) - 2 * ({lcs_sql('a', 'b')})", BOTH))(_four(M.indel))
query("m_lcs", scale_sql(f"{LONGER} - ({lcs_sql('a', 'b')})", LONGER))(_four(M.lcs))
query("m_osa", scale_sql(OSA, LONGER))(_four(M.osa))
query("m_damerau", scale_sql("damerau_levenshtein(a, b)", LONGER))(_four(M.damerau_levenshtein))
query("m_hamming", scale_sql(APART, LONGER))(_four(M.hamming))
query("m_prefix", scale_sql(f"{LONGER} - {PREFIX}", LONGER))(_four(M.prefix))
query("m_postfix", scale_sql(f"{LONGER} - {POSTFIX}", LONGER))(_four(M.postfix))


@query("m_hamming_equal_length", f"SELECT a, b, hamming(a, b)::DOUBLE AS distance FROM {P} WHERE length(a) = length(b)")
def m_hamming_equal_length(spark, sf_dir):
    same = pairs(spark, sf_dir).where(F.length("a") == F.length("b"))
    return same.select("a", "b", M.hamming.distance(*ab(), pad=False).alias("distance"))


def _two(metric, **config):
    def run(spark, sf_dir):
        found = pairs(spark, sf_dir).withColumn("s", metric.similarity(*ab(), **config)).withColumn("d", metric.distance(*ab(), **config))
        return found.select("a", "b", F.round("s", 9).alias("similarity"), F.round("d", 9).alias("distance"))

    return run


def _two_sql(score: str, rows: str = P) -> str:
    return f"SELECT a, b, round({score}, 9) AS similarity, round(1 - {score}, 9) AS distance FROM {rows}"


query("m_jaro", _two_sql("jaro_similarity(a, b)"))(_two(M.jaro))
query("m_jaro_winkler", _two_sql("jaro_winkler_similarity(a, b)"))(_two(M.jaro_winkler))
query("m_jaro_winkler_weight", _two_sql(f"CASE WHEN j > 0.7 THEN least(j + least(4, {PREFIX}) * 0.2 * (1 - j), 1) ELSE j END", f"(SELECT a, b, jaro_similarity(a, b) AS j FROM {P})"))(_two(M.jaro_winkler, prefix_weight=0.2))


def gram_sql(n: int, score: str) -> str:
    """All pairs of names with their shared grams ``s``, dot product ``p``, gram counts ``x``, ``y`` and square sums ``xx``, ``yy``."""
    return f"""WITH t AS (SELECT DISTINCT p_name AS t FROM part),
g AS (SELECT t, substr(t, i::INT, {n}) AS g, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) - {n} + 2)) AS i FROM t) GROUP BY ALL),
z AS (SELECT t.t, coalesce(sum(n), 0) AS n, coalesce(sum(n * n), 0) AS nn FROM t LEFT JOIN g ON t.t = g.t GROUP BY t.t),
j AS (SELECT x.t AS a, y.t AS b, sum(least(x.n, y.n)) AS s, sum(x.n * y.n) AS p FROM g x JOIN g y ON x.g = y.g GROUP BY ALL),
v AS (SELECT x.t AS a, y.t AS b, x.n AS x, y.n AS y, x.nn AS xx, y.nn AS yy, coalesce(s, 0) AS s, coalesce(p, 0) AS p FROM z x CROSS JOIN z y LEFT JOIN j ON j.a = x.t AND j.b = y.t)
SELECT a, b, round(v_, 9) AS similarity, round(1 - v_, 9) AS distance FROM (SELECT a, b, CASE WHEN x = 0 OR y = 0 THEN (x = 0 AND y = 0 AND a = b)::INT ELSE {score} END AS v_ FROM v)"""


_TVERSKY = "s::DOUBLE / (s + {0} * (x - s) + {1} * (y - s))"
for _n in (1, 2, 3):
    query(f"m_dice_{_n}", gram_sql(_n, "2.0 * s / (x + y)"))(_two(M.dice, gram_size=_n))
    query(f"m_cosine_{_n}", gram_sql(_n, "least(1.0, p / sqrt((xx * yy)::DOUBLE))"))(_two(M.cosine, gram_size=_n))
    for _k, (_alpha, _beta) in enumerate(((0.5, 0.5), (1, 1), (0.2, 0.7))):
        query(f"m_tversky_{_n}_{_k}", gram_sql(_n, _TVERSKY.format(_alpha, _beta)))(_two(M.tversky, gram_size=_n, alpha=_alpha, beta=_beta))

WEIGHTS = {"red": 5.0, "blue": 0.5, "green": 0.0}
_PRICE = "CASE g WHEN 'red' THEN 5.0 WHEN 'blue' THEN 0.5 WHEN 'green' THEN 0.0 ELSE 1.0 END"
WEIGHTED = {"gram_size": 1, "alpha": 1.0, "beta": 0.25, "element_weights": WEIGHTS, "default_element_weight": 1.0}


@query(
    "m_tversky_weighted",
    f"""WITH t AS (SELECT DISTINCT p_name AS t FROM part),
g AS (SELECT t, g, count(*) AS n, {_PRICE}::DOUBLE AS w FROM (SELECT t, unnest(string_split(t, ' ')) AS g FROM t) GROUP BY ALL),
z AS (SELECT t, sum(n * w) AS m, list_sort(string_split(t, ' ')) AS bag FROM g GROUP BY t),
j AS (SELECT x.t AS a, y.t AS b, sum(least(x.n, y.n) * x.w) AS s FROM g x JOIN g y ON x.g = y.g GROUP BY ALL),
v AS (SELECT x.t AS a, y.t AS b, x.m AS x, y.m AS y, x.bag = y.bag AS same, coalesce(s, 0) AS s FROM z x CROSS JOIN z y LEFT JOIN j ON j.a = x.t AND j.b = y.t)
SELECT a, b, round(CASE WHEN x = 0 AND y = 0 THEN same::INT WHEN s = 0 THEN 0 ELSE s / (s + 1.0 * (x - s) + 0.25 * (y - s)) END, 9) AS similarity FROM v""",
)
def m_tversky_weighted(spark, sf_dir):
    score = M.tversky.similarity(F.split("a", " "), F.split("b", " "), **WEIGHTED)
    return pairs(spark, sf_dir).select("a", "b", F.round(score, 9).alias("similarity"))


def soft_scorer(**more):
    inner = create_scorer(M.indel.normalized_similarity)
    return create_scorer(M.tversky.similarity, gram_size=1, element_similarity={"scorer": inner, "threshold": 0.5}, **more)


@query("m_tversky_soft")
def m_tversky_soft(spark, sf_dir):
    scored = pairs(spark, sf_dir).withColumn("s", soft_scorer().column(F.split("a", " "), F.split("b", " ")))
    return scored.select("a", "b", F.round("s", 9).alias("similarity"))


@query("m_explain")
def m_explain(spark, sf_dir):
    scorer = soft_scorer(element_weights=WEIGHTS)
    found = pairs(spark, sf_dir).select("a", "b", explain_column(scorer, F.split("a", " "), F.split("b", " ")).alias("e"))
    return found.select("a", "b", F.round("e.score", 9).alias("score"), F.size("e.matches").alias("n_matches"), F.size("e.unmatched_first").alias("n_first"), F.size("e.unmatched_second").alias("n_second"))


# Scorers from 0 to 100


def _percent(metric):
    return lambda spark, sf_dir: pairs(spark, sf_dir).select("a", "b", F.round(metric(*ab()), 9).alias("score"))


def _round_sql(sql: str) -> str:
    return f"SELECT a, b, round(score, 9) AS score FROM ({sql})"


_SORTED = f"(SELECT a AS a0, b AS b0, {sorted_sql('a')} AS a, {sorted_sql('b')} AS b FROM {P})"
_SORT_SCORES = f"(SELECT a0 AS a, b0 AS b, {ratio_sql('a', 'b')} AS score FROM {_SORTED})"
_SET_SCORES = f"({token_set_sql(P)})"
_TOKEN_SCORES = f"(SELECT s.a, s.b, greatest(s.score, t.score) AS score FROM {_SORT_SCORES} s JOIN {_SET_SCORES} t ON s.a = t.a AND s.b = t.b)"
_SHARED = f"len(list_intersect({set_sql('a')}, {set_sql('b')})) > 0"
_DIFFS = f"(SELECT a AS a0, b AS b0, {_SHARED} AS shared, array_to_string({set_sql('a')}, ' ') AS a, array_to_string({set_sql('b')}, ' ') AS b FROM {P})"


def _partial_of(rows: str) -> str:
    """Partial ratio of derived texts ``a``, ``b`` for the pairs ``a0``, ``b0``."""
    return f"(SELECT r.a0 AS a, r.b0 AS b, p.score FROM {rows} r JOIN ({partial_sql(f'(SELECT DISTINCT a, b FROM {rows})')}) p ON r.a = p.a AND r.b = p.b)"


_PARTIAL_SORT, _PARTIAL_SET = _partial_of(_SORTED), _partial_of(_DIFFS)
_PARTIAL_TOKEN = f"(SELECT s.a, s.b, CASE WHEN {_SHARED.replace('(a,', '(s.a,').replace('(b,', '(s.b,')} THEN 100.0 ELSE greatest(s.score, t.score) END AS score FROM {_PARTIAL_SORT} s JOIN {_PARTIAL_SET} t ON s.a = t.a AND s.b = t.b)"
query("f_ratio", _round_sql(f"SELECT a, b, {ratio_sql('a', 'b')} AS score FROM {P}"))(_percent(M.ratio))
query("f_token_sort_ratio", _round_sql(f"SELECT * FROM {_SORT_SCORES}"))(_percent(M.token_sort_ratio))
query("f_token_set_ratio", _round_sql(token_set_sql(P)))(_percent(M.token_set_ratio))
query("f_token_ratio", _round_sql(f"SELECT * FROM {_TOKEN_SCORES}"))(_percent(M.token_ratio))
query("f_partial_ratio", _round_sql(partial_sql(P)))(_percent(M.partial_ratio))
query("f_partial_token_sort_ratio", _round_sql(f"SELECT * FROM {_PARTIAL_SORT}"))(_percent(M.partial_token_sort_ratio))
query("f_partial_token_set_ratio", _round_sql(f"SELECT a, b, CASE WHEN {_SHARED} THEN 100.0 ELSE score END AS score FROM {_PARTIAL_SET}"))(_percent(M.partial_token_set_ratio))
query("f_partial_token_ratio", _round_sql(f"SELECT * FROM {_PARTIAL_TOKEN}"))(_percent(M.partial_token_ratio))
query("f_weighted_ratio", _round_sql(f"""
SELECT r.a, r.b, CASE WHEN q < 1.5 AND NOT spaced THEN r.score WHEN q < 1.5 THEN greatest(r.score, t.score * 0.95)
  ELSE greatest(r.score, p.score * CASE WHEN q <= 8 THEN 0.9 ELSE 0.6 END, k.score * 0.95 * CASE WHEN q <= 8 THEN 0.9 ELSE 0.6 END) END AS score
FROM (SELECT a, b, {ratio_sql('a', 'b')} AS score, greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) AS q, contains(a, ' ') OR contains(b, ' ') AS spaced FROM {P}) r
JOIN {_TOKEN_SCORES} t ON r.a = t.a AND r.b = t.b JOIN ({partial_sql(P)}) p ON r.a = p.a AND r.b = p.b JOIN {_PARTIAL_TOKEN} k ON r.a = k.a AND r.b = k.b"""))(_percent(M.weighted_ratio))  # fmt: skip


def alignment_sql(rows: str) -> str:
    """``(a, b, score, ...)``: the first best window, in the order of beginnings, inner windows and ends; for equally long texts of the second only if better."""
    windows = f"""SELECT a, b, n, h, turn, unnest(list_concat(list_concat(
   list_transform(range(1, length(n)), lambda i: [0, i]), list_transform(range(0, length(h) - length(n)), lambda i: [i, i + length(n)])), list_transform(range(length(h) - length(n), length(h)), lambda i: [i, length(h)]))) AS w,
   generate_subscripts(list_concat(list_concat(range(1, length(n)), range(0, length(h) - length(n))), range(length(h) - length(n), length(h))), 1) AS place FROM (
   SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS n, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS h, 0 AS turn FROM {rows} UNION ALL SELECT a, b, b, a, 1 FROM {rows} WHERE length(a) = length(b))"""
    scored = f"""SELECT *, CASE WHEN contains(n, CASE WHEN w[2] < length(h) OR w[1] = 0 AND w[2] < length(n) THEN substr(h, w[2]::INT, 1) ELSE substr(h, (w[1] + 1)::INT, 1) END)
   THEN round(200.0 * ({lcs_sql('n', 't')}) / (length(n) + length(t)), 9) ELSE 0 END AS score FROM (SELECT *, substr(h, (w[1] + 1)::INT, (w[2] - w[1])::INT) AS t FROM ({windows}))"""
    best = f"SELECT * FROM ({scored}) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, turn, place) = 1"
    return f"""SELECT a, b, score, (CASE WHEN whole THEN 0 ELSE f END)::INT AS src_start, (CASE WHEN whole THEN length(a) ELSE e END)::INT AS src_end,
  (CASE WHEN whole THEN f ELSE 0 END)::INT AS dest_start, (CASE WHEN whole THEN e ELSE length(b) END)::INT AS dest_end
 FROM (SELECT a, b, score, turn = 0 AND length(a) <= length(b) AS whole, CASE WHEN score > 0 THEN w[1] ELSE 0 END AS f, CASE WHEN score > 0 THEN w[2] ELSE length(n) END AS e FROM ({best}))"""


@query("f_partial_ratio_alignment", alignment_sql(P))
def f_partial_ratio_alignment(spark, sf_dir):
    found = pairs(spark, sf_dir).select("a", "b", partial_ratio_alignment(*ab()).alias("f"))
    return found.select("a", "b", F.round("f.score", 9).alias("score"), *(f"f.{c}" for c in ("src_start", "src_end", "dest_start", "dest_end")))


# Neighbouring documents' beginnings: texts beyond ASCII, empty and missing ones, of other lengths


def neighbours(spark, sf_dir, size: int):
    docs = table(spark, sf_dir, "documents")
    here, there = docs.select("doc_id", F.substring("text", 1, size).alias("a")), docs.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 3, size).alias("b"))
    return here.join(there, "doc_id", "left")


def _neighbours_sql(size: int) -> str:
    return f"(SELECT d.doc_id, substr(d.text, 1, {size}) AS a, substr(e.text, 3, {size}) AS b FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1)"


def _of_texts(name: str, size: int, sql: str, metric, missing: str = "0"):
    @query(name, f"SELECT doc_id, round(CASE WHEN a IS NULL OR b IS NULL THEN {missing} ELSE {sql} END, 9)::DOUBLE AS score FROM {_neighbours_sql(size)}")
    def run(spark, sf_dir):
        found = neighbours(spark, sf_dir, size)
        either = F.col("a").isNotNull() & F.col("b").isNotNull()
        score = metric(*ab()) if metric.direction == "similarity" else F.when(either, metric(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
        return found.select("doc_id", F.round(score, 9).alias("score"))

    return run


_UNIT = WEIGHTED_LEVENSHTEIN.replace("+ 2.0", "+ 1.0").replace("ELSE 1.5", "ELSE 1.0").replace("i * 2.0", "i * 1.0")
_UNIT = f"CASE WHEN length(b) = 0 THEN length(a) ELSE {_UNIT} END"
_of_texts("m_levenshtein_texts", 40, _UNIT, M.levenshtein.distance, "NULL")
_of_texts("m_lcs_texts", 100, lcs_sql("a", "b"), M.lcs.similarity)
_of_texts("m_prefix_texts", 100, PREFIX, M.prefix.similarity)
_of_texts("f_ratio_texts", 100, ratio_sql("a", "b"), M.ratio)


# Texts

_DUCK_WHITE = "[\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query("n_normalize", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[^\\p{L}\\p{N}]', ' ', 'g')))) AS digest FROM documents")
def n_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(E.normalize_text(F.col("text"))).alias("digest"))


@query("n_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '{_DUCK_WHITE}+'), lambda x: x <> '') AS t FROM documents)")
def n_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(E.tokens(F.col("text"))).cast("long").alias("n"), F.md5(E.token_sort(F.col("text"))).alias("digest"))


# Edit scripts


def _script(name: str, family: str, n_ops: str):
    sql = f"SELECT a, b, ({n_ops})::BIGINT AS n_ops, b AS applied, a AS returned, b AS from_opcodes, true AS round_trip FROM {P}"

    @query(name, sql)
    def run(spark, sf_dir):
        found = pairs(spark, sf_dir).withColumn("s", O.editops_column(*ab(), family)).withColumn("o", O.to_opcodes(F.col("s")))
        back = O.equal_scripts(O.to_editops(F.col("o")), F.col("s"))
        return found.select(
            "a", "b", F.size("s.ops").cast("long").alias("n_ops"), O.apply_script(F.col("s"), *ab()).alias("applied"), O.apply_script(O.inverse(F.col("s")), F.col("b"), F.col("a")).alias("returned"),
            O.apply_script(F.col("o"), *ab()).alias("from_opcodes"), back.alias("round_trip"),
        )

    return run


_script("e_levenshtein", "levenshtein", "levenshtein(a, b)")
_script("e_lcs", "lcs", f"length(a) + length(b) - 2 * ({lcs_sql('a', 'b')})")
_script("e_indel", "indel", f"length(a) + length(b) - 2 * ({lcs_sql('a', 'b')})")
_script("e_hamming", "hamming", APART)


@query("e_matching_blocks", f"SELECT a, b, ({lcs_sql('a', 'b')})::BIGINT AS matched, length(a) AS src_end, length(b) AS dest_end FROM {P}")
def e_matching_blocks(spark, sf_dir):
    found = pairs(spark, sf_dir).withColumn("m", O.matching_blocks(O.opcodes_column(*ab(), "lcs")))
    last = F.element_at("m", -1)
    return found.select("a", "b", F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("matched"), last["src_start"].cast("long").alias("src_end"), last["dest_start"].cast("long").alias("dest_end"))


@query("e_remove_subsequence", f"SELECT a, b, greatest(levenshtein(a, b) - 1, 0) AS n_ops FROM {P}")
def e_remove_subsequence(spark, sf_dir):
    found = pairs(spark, sf_dir).withColumn("s", O.editops_column(*ab()))
    first = F.struct(F.slice("s.ops", 1, 1).alias("ops"), F.col("s.src_len"), F.col("s.dest_len"))
    return found.select("a", "b", F.size(O.remove_subsequence(F.col("s"), first)["ops"]).cast("long").alias("n_ops"))


@query("e_validate", f"SELECT a, b, true AS valid, true AS valid_opcodes FROM {P}")
def e_validate(spark, sf_dir):
    found = pairs(spark, sf_dir).withColumn("s", O.editops_column(*ab())).withColumn("o", O.opcodes_column(*ab()))
    return found.select("a", "b", O.equal_scripts(O.validated_editops(F.col("s")), F.col("s")).alias("valid"), O.equal_scripts(O.validated_opcodes(F.col("o")), F.col("o")).alias("valid_opcodes"))


_LCS = lcs_sql("a", "b")


@query("e_explode", f"SELECT a, b, tag, n::BIGINT AS n FROM (SELECT a, b, unnest(['delete', 'insert']) AS tag, unnest([length(a) - ({_LCS}), length(b) - ({_LCS})]) AS n FROM {P}) WHERE n > 0")
def e_explode(spark, sf_dir):
    found = pairs(spark, sf_dir).select("a", "b", F.explode(O.editops_column(*ab(), "lcs")["ops"]).alias("op"))
    return found.groupBy("a", "b", "op.tag").agg(F.count(F.lit(1)).alias("n"))


# Searches: every customer's name, less its last character, among the suppliers' names; typos among part names

TYPOS = "(SELECT min(p_partkey) AS q, substr(p_name, 2) AS query FROM part GROUP BY p_name)"
_LEV_NS = "CASE WHEN greatest(length(query), length(p_name)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(query, p_name)::DOUBLE / greatest(length(query), length(p_name)) END"


def typos(spark, sf_dir):
    return numbered(spark, sf_dir).select("q", F.substring("p_name", 2, 1000).alias("query"))


def numbered(spark, sf_dir):
    """Each part name with its smallest key."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("q"))


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))


def _scored_sql(score: str, where: str = "true") -> str:
    return f"(SELECT q, p_partkey AS key, round(score, 9) AS score FROM (SELECT q, p_partkey, {score} AS score FROM {TYPOS} t, part) WHERE {where})"


def _ranked_sql(scored: str, k: int, direction: str = "DESC") -> str:
    return f"SELECT q, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score {direction}, key) AS rank FROM {scored}) WHERE rank <= {k}"


def _shown(found, *more):
    return found.select("q", "key", F.round("score", 9).alias("score"), *(F.col(c).cast("long").alias(c) for c in more))


LEV = lambda: create_scorer(M.levenshtein.normalized_similarity)


@query("s_search_top_k", _ranked_sql(_scored_sql(_LEV_NS), 5))
def s_search_top_k(spark, sf_dir):
    return _shown(S.search(typos(spark, sf_dir), parts(spark, sf_dir), LEV()), "rank")


@query("s_search_distance", _ranked_sql(_scored_sql("levenshtein(query, p_name)::DOUBLE", "score <= 3"), 3, "ASC"))
def s_search_distance(spark, sf_dir):
    return _shown(S.search(typos(spark, sf_dir), parts(spark, sf_dir), create_scorer(M.levenshtein.distance), threshold=3, limit=3), "rank")


@query("s_best_match", f"SELECT q, key, score FROM ({_ranked_sql(_scored_sql(_LEV_NS), 1)})")
def s_best_match(spark, sf_dir):
    return _shown(S.best_match(typos(spark, sf_dir), parts(spark, sf_dir), LEV()))


@query("s_search_iter", f"SELECT * FROM {_scored_sql(_LEV_NS, 'score >= 0.7')}")
def s_search_iter(spark, sf_dir):
    return _shown(S.search_iter(typos(spark, sf_dir), parts(spark, sf_dir), LEV(), threshold=0.7))


@query("s_matcher", _ranked_sql(_scored_sql(ratio_sql("query", "p_name"), "score >= 60"), 5))
def s_matcher(spark, sf_dir):
    matcher = S.create_matcher(parts(spark, sf_dir), create_scorer(M.ratio))
    return _shown(matcher.search(typos(spark, sf_dir), threshold=60), "rank")


@query("s_semi", f"SELECT DISTINCT q FROM {_scored_sql(_LEV_NS, 'score >= 0.8')}")
def s_semi(spark, sf_dir):
    return S.matched(typos(spark, sf_dir), parts(spark, sf_dir), LEV(), 0.8).select("q")


@query("s_anti", f"SELECT q FROM {TYPOS} WHERE q NOT IN (SELECT q FROM {_scored_sql(_LEV_NS, 'score >= 0.9')})")
def s_anti(spark, sf_dir):
    return S.matched(typos(spark, sf_dir), parts(spark, sf_dir), LEV(), 0.9, keep=False).select("q")


_MISSING = "CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_name END"


@query("s_missing_items", f"SELECT q, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM (SELECT q, p_partkey AS key, round({_LEV_NS}, 9) AS score FROM {TYPOS} t, (SELECT p_partkey, p_name FROM part WHERE p_type <> 'ECONOMY'))) WHERE rank <= 5")
def s_missing_items(spark, sf_dir):
    text = F.when(F.col("p_type") != "ECONOMY", F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.alias("text"))
    return _shown(S.search(typos(spark, sf_dir), rows, LEV()), "rank")


@query("s_missing_query", "SELECT q, p_partkey AS key, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY q ORDER BY p_partkey) AS rank FROM (SELECT unnest([1, 2])::BIGINT AS q), part QUALIFY rank <= 5")
def s_missing_query(spark, sf_dir):
    asked = spark.range(1, 3).select(F.col("id").alias("q"), F.lit(None).cast("string").alias("query"))
    return _shown(S.search(asked, parts(spark, sf_dir), LEV()), "rank")


@query("s_impossible_threshold", f"SELECT q, key, score FROM {_scored_sql(_LEV_NS, 'score > 1')}")
def s_impossible_threshold(spark, sf_dir):
    return _shown(S.search_iter(typos(spark, sf_dir), parts(spark, sf_dir), LEV(), threshold=1.5))


@query("s_normalized", _ranked_sql(_scored_sql(_LEV_NS), 2))
def s_normalized(spark, sf_dir):
    asked = typos(spark, sf_dir).withColumn("query", F.concat(F.lit("  "), F.upper("query"), F.lit("!")))
    return _shown(S.search(asked, parts(spark, sf_dir), LEV(), limit=2, normalize=E.normalize_text), "rank")


@query("s_is_match", f"SELECT a, b, levenshtein(a, b) <= 6 AS is_match, CASE WHEN levenshtein(a, b) <= 6 THEN levenshtein(a, b)::DOUBLE END AS score FROM {P}")
def s_is_match(spark, sf_dir):
    scorer = create_scorer(M.levenshtein.distance)
    return pairs(spark, sf_dir).select("a", "b", is_match(scorer, *ab(), 6).alias("is_match"), score_if_match(scorer, *ab(), 6).alias("score"))


# Indexes


def _index_sql(n: int, score: str, threshold: float, k: int, zero: bool = False) -> str:
    scored = f"""(WITH c AS (SELECT p_partkey, p_name FROM part), t AS (SELECT q AS id, query AS t FROM {TYPOS}), d AS (SELECT DISTINCT p_name AS t FROM part),
gq AS (SELECT id, substr(t, i::INT, {n}) AS g, count(*) AS n FROM (SELECT id, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM t) GROUP BY ALL),
gc AS (SELECT t, substr(t, i::INT, {n}) AS g, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) - {n} + 2)) AS i FROM d) GROUP BY ALL),
zq AS (SELECT id, sum(n) AS x, sum(n * n) AS xx FROM gq GROUP BY id), zc AS (SELECT t, sum(n) AS y, sum(n * n) AS yy FROM gc GROUP BY t),
j AS (SELECT gq.id AS q, gc.t AS p_name, sum(least(gq.n, gc.n)) AS s, sum(gq.n * gc.n) AS p FROM gq JOIN gc ON gq.g = gc.g GROUP BY ALL),
f AS (SELECT q, j.p_name, {score} AS score FROM j JOIN zq ON zq.id = j.q JOIN zc ON zc.t = j.p_name)
SELECT t.id AS q, c.p_partkey AS key, round(coalesce(f.score, 0), 9) AS score FROM t CROSS JOIN c LEFT JOIN f ON f.q = t.id AND f.p_name = c.p_name {'' if zero else f'WHERE f.score >= {threshold}'})"""
    return _ranked_sql(scored, k)


def _indexed(metric, threshold, limit, **config):
    def run(spark, sf_dir):
        matcher = S.create_indexed_matcher(parts(spark, sf_dir), create_scorer(metric.similarity, **config))
        return _shown(matcher.search(typos(spark, sf_dir), threshold=threshold, limit=limit), "rank")

    return run


query("x_dice", _index_sql(2, "2.0 * s / (x + y)", 0.5, 5))(_indexed(M.dice, 0.5, 5))
query("x_cosine", _index_sql(3, "least(1.0, p / sqrt((xx * yy)::DOUBLE))", 0.4, 5))(_indexed(M.cosine, 0.4, 5, gram_size=3))
query("x_tversky", _index_sql(2, "s::DOUBLE / (s + 1.0 * (x - s) + 0.25 * (y - s))", 0.4, 5))(_indexed(M.tversky, 0.4, 5, alpha=1, beta=0.25))
query("x_zero_fill", _index_sql(3, "2.0 * s / (x + y)", 0, 40, zero=True))(_indexed(M.dice, None, 40, gram_size=3))


@query("x_gramless", "SELECT q, p_partkey AS key, 1.0::DOUBLE AS score FROM (SELECT 1::BIGINT AS q, substr(p_name, 1, 1) AS query FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)) t JOIN part ON substr(p_name, 1, 1) = query")
def x_gramless(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.substring("p_name", 1, 1).alias("text"))
    asked = rows.groupBy().agg(F.min_by("text", "key").alias("query")).select(F.lit(1).cast("long").alias("q"), "query")
    return _shown(S.create_indexed_matcher(rows, create_scorer(M.dice.similarity)).search_iter(asked, threshold=0.5))


@query(
    "x_weighted",
    f"""WITH d AS (SELECT DISTINCT p_name AS t FROM part), g AS (SELECT t, g, count(*) AS n, {_PRICE}::DOUBLE AS w FROM (SELECT t, unnest(string_split(t, ' ')) AS g FROM d) GROUP BY ALL),
z AS (SELECT t, sum(n * w) AS m FROM g GROUP BY t), j AS (SELECT x.t AS a, y.t AS b, sum(least(x.n, y.n) * x.w) AS s FROM g x JOIN g y ON x.g = y.g GROUP BY ALL HAVING s > 0),
v AS (SELECT a, b, s / (s + 1.0 * (x.m - s) + 0.25 * (y.m - s)) AS score FROM j JOIN z x ON x.t = a JOIN z y ON y.t = b),
i AS (SELECT min(p_partkey) AS q, p_name AS t FROM part GROUP BY p_name)
SELECT q, p_partkey AS key, round(score, 9) AS score FROM i JOIN v ON v.a = i.t JOIN part ON p_name = v.b WHERE score >= 0.6""",
)
def x_weighted(spark, sf_dir):
    asked = numbered(spark, sf_dir).select("q", F.split("p_name", " ").alias("query"))
    rows = parts(spark, sf_dir).withColumn("text", F.split("text", " "))
    return _shown(S.create_indexed_matcher(rows, create_scorer(M.tversky.similarity, **WEIGHTED)).search_iter(asked, threshold=0.6))


@query("x_soft")
def x_soft(spark, sf_dir):
    asked = typos(spark, sf_dir).withColumn("query", F.split("query", " "))
    rows = parts(spark, sf_dir).withColumn("text", F.split("text", " "))
    return _shown(S.create_indexed_matcher(rows, soft_scorer()).search(asked, threshold=0.3), "rank")


@query("x_indel_candidates", f"SELECT * FROM {_scored_sql('(' + ratio_sql('query', 'p_name') + ') / 100', 'score >= 0.8')}")
def x_indel_candidates(spark, sf_dir):
    return _shown(S.search_iter(typos(spark, sf_dir), parts(spark, sf_dir), create_scorer(M.indel.normalized_similarity), threshold=0.8))


@query("x_containment", f"""SELECT q, p_partkey AS key FROM (SELECT q, {set_sql('query')} AS s FROM {TYPOS}) t, (SELECT p_partkey, {set_sql('p_name')} AS c FROM part)
WHERE len(s) > 0 AND len(c) > 0 AND (list_has_all(s, c) OR list_has_all(c, s))""")
def x_containment(spark, sf_dir):
    return S.contained(typos(spark, sf_dir), parts(spark, sf_dir))


@query("x_build", "SELECT g AS gram, sum(n)::BIGINT AS n, count(*) AS texts FROM (SELECT p_partkey, substr(p_name, i::INT, 2) AS g, count(*) AS n FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part) GROUP BY ALL) GROUP BY g")
def x_build(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return X.GramIndex.build(rows, 2).postings.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


# Batches


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("text"))


_NATIONS = "nation x, nation y"


@query("b_matrix", f"SELECT x.n_nationkey AS row, y.n_nationkey AS col, levenshtein(x.n_name, y.n_name)::DOUBLE AS score FROM {_NATIONS}")
def b_matrix(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return B.score_matrix(n, n, create_scorer(M.levenshtein.distance))


@query("b_matrix_rejected", f"SELECT x.n_nationkey AS row, y.n_nationkey AS col, CASE WHEN levenshtein(x.n_name, y.n_name) <= 5.5 THEN levenshtein(x.n_name, y.n_name) ELSE 6 END::DOUBLE AS score FROM {_NATIONS}")
def b_matrix_rejected(spark, sf_dir):
    return B.score_matrix(_nations(spark, sf_dir), _nations(spark, sf_dir), create_scorer(M.levenshtein.distance), threshold=5.5)


_NS = "(1 - levenshtein(x.n_name, y.n_name)::DOUBLE / greatest(length(x.n_name), length(y.n_name)))"


@query("b_matrix_u8", f"SELECT x.n_nationkey AS row, y.n_nationkey AS col, (CASE WHEN {_NS} >= 0.3 THEN floor({_NS} * 100 + 0.5) ELSE 0 END)::SMALLINT AS score FROM {_NATIONS}")
def b_matrix_u8(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return B.score_matrix(n, n, LEV(), threshold=0.3, into="u8", score_multiplier=100.0)


@query("b_matrix_u8c", f"SELECT x.n_nationkey AS row, y.n_nationkey AS col, least(255, levenshtein(x.n_name, y.n_name) * 60)::SMALLINT AS score FROM {_NATIONS}")
def b_matrix_u8c(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return B.score_matrix(n, n, create_scorer(M.levenshtein.distance), into="u8c", score_multiplier=60.0)


def _turns(spark, sf_dir):
    w = S.Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("left"), F.lead("text").over(w).alias("right")).where("right is not null")


@query(
    "b_pairs",
    """WITH c AS (SELECT conv_id, turn, text AS l, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations QUALIFY r IS NOT NULL),
g AS (SELECT conv_id, turn, side, g, count(*) AS n FROM (SELECT conv_id, turn, 'l' AS side, unnest(list_transform(range(1, length(l)), lambda i: substr(l, i::INT, 2))) AS g FROM c
 UNION ALL SELECT conv_id, turn, 'r', unnest(list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2))) FROM c) GROUP BY ALL),
s AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS s FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.g = y.g AND x.side = 'l' AND y.side = 'r' GROUP BY ALL)
SELECT c.conv_id, c.turn, round(2.0 * coalesce(s, 0) / (length(l) + length(r) - 2), 9) AS score FROM c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn""",
)
def b_pairs(spark, sf_dir):
    scored = B.score_pairs(_turns(spark, sf_dir), create_scorer(M.dice.similarity))
    return scored.select("conv_id", "turn", F.round("score", 9).alias("score"))


# Records, one's own scorers, streams


@query(
    "r_records",
    "SELECT c_custkey, s_suppkey, (levenshtein(c_name, s_name))::DOUBLE AS apart FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE levenshtein(c_name, s_name) <= 9 AND right(c_name, 2) = right(s_name, 2)",
)
def r_records(spark, sf_dir):
    """Blocked by nation and by the names' ends, then one scorer and threshold a field."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    block = [(F.col("c_nationkey"), F.col("s_nationkey")), (F.right("c_name", F.lit(2)), F.right("s_name", F.lit(2)))]
    apart = create_scorer(M.levenshtein.distance).column(F.col("c_name"), F.col("s_name"), 9, once=True)
    return B.blocked_pairs(c, s, block).withColumn("apart", apart).where("apart is not null").select("c_custkey", "s_suppkey", "apart")


def _length_share(a, b) -> float:
    return min(len(a), len(b)) / max(len(a), len(b), 1)


@query("u_custom_scorer", f"SELECT a, b, round(least(length(a), length(b))::DOUBLE / greatest(length(a), length(b), 1), 9) AS score FROM {P}")
def u_custom_scorer(spark, sf_dir):
    scorer = create_scorer(_length_share, direction="similarity", bounds=(0, 1), symmetric=True)
    return pairs(spark, sf_dir).select("a", "b", F.round(scorer.column(*ab()), 9).alias("score"))


@query("t_stream_probe", "SELECT p_partkey, n_nationkey AS key, levenshtein(lower(p_name), lower(n_name))::DOUBLE AS score FROM part, nation WHERE levenshtein(lower(p_name), lower(n_name)) <= 7")
def t_stream_probe(spark, sf_dir):
    """A stream of part names against the nations' names, run to its end through a file sink."""
    from .streaming.probe import probe

    schema = table(spark, sf_dir, "part").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(f"{sf_dir}/") if not _is_folder(spark, sf_dir) else spark.readStream.schema(schema).parquet(f"{sf_dir}/part.parquet")
    choices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("text"))
    found = probe(stream.select("p_partkey", F.lower("p_name").alias("query")), choices, create_scorer(M.levenshtein.distance), 7)
    base = f"{_shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = found.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("p_partkey long, key int, score double").parquet(f"{base}/rows").select("p_partkey", "key", "score")


def _is_folder(spark, sf_dir: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/part.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _shared_folder(spark) -> str:
    """The cluster's shared folder; a private one only where none is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        folder = tempfile.mkdtemp(prefix="akin-stream-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")
