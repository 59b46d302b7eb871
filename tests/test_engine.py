"""Column forms, searches, indexes, batches and streams on Spark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from akin.functions import expressions as E
from akin.functions import kernels as K
from akin.functions import metrics as M
from akin.operators import batch as B
from akin.operators import editops as O
from akin.operators import search as S
from akin.operators.scorer import create_scorer, is_match, score_if_match
from akin.operators.soft import explain_column
from akin.sources.collections import from_values, read_collection
from akin.streaming.probe import first_seen, probe, search_stream

# Example texts whose scores are published.
TEAMS = ["new york mets", "new york jets", "the mets from new york", "atlanta braves", "new york mets", "", None, "a"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcé😀 d", k=rng.randint(0, 9)))
    rows = [(word(), word()) for _ in range(150)] + [("", ""), ("", "a"), ("a", "a"), ("😀a", "😀b"), (None, "a"), ("a", None), (None, None)]
    return spark.createDataFrame(rows, "a string, b string")


@pytest.mark.parametrize("metric", [*(getattr(f, k) for f in M.FAMILIES for k in ("similarity", "distance", "normalized_similarity", "normalized_distance")), *M.FUZZ], ids=lambda m: m.name)
def test_columns_equal_values(pairs, metric):
    scorer = create_scorer(metric)
    rows = pairs if metric.direction == "similarity" else pairs.where("a is not null and b is not null")
    for r in rows.withColumn("s", scorer.column(F.col("a"), F.col("b"))).collect():
        assert math.isclose(r.s, scorer.score(r.a, r.b), abs_tol=1e-12), (r.a, r.b)


def test_missing_distance_fails(pairs):
    with pytest.raises(Exception, match="missing"):
        pairs.select(M.levenshtein.distance(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="missing"):
        pairs.select(M.osa.distance(F.col("a"), F.col("b"))).collect()


def test_matches(pairs):
    scorer = create_scorer(M.ratio)
    full = pairs.where("a is not null and b is not null")
    for r in full.select("a", "b", is_match(scorer, F.col("a"), F.col("b"), 50).alias("m"), score_if_match(scorer, F.col("a"), F.col("b"), 50).alias("s")).collect():
        assert r.m == is_match(scorer, r.a, r.b, 50) and (r.s is None) == (not r.m)


@pytest.mark.parametrize("text", ["  New YORK Mets!!!  ", "Straße—Zürich", "İstanbul", "ΟΔΟΣ ΟΔΟΣ", "a---b", "  ", "_", "snake_case_name", "a b\u0085c"])
def test_normalize(spark, text):
    want = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text).strip(" ").replace("İ", "i").replace("Σ", "σ").lower()
    got = spark.range(1).select(E.normalize_text(F.lit(text)).alias("n"), E.tokens(F.lit(text)).alias("t")).first()
    assert got.n == want and got.t == text.split()


def brute(query, threshold, limit, scorer):
    if query is None:
        found = [(0.0, i, i) for i, t in enumerate(TEAMS) if t is not None]
    else:
        found = [(scorer.score(query, t), i, i) for i, t in enumerate(TEAMS) if t is not None]
    sign = -1 if scorer.direction == "similarity" else 1
    kept = [x for x in found if threshold is None or (x[0] >= threshold if sign < 0 else x[0] <= threshold)]
    return sorted(kept, key=lambda x: (sign * x[0], x[1]))[:limit]


@pytest.mark.parametrize(("threshold", "limit"), [(None, 1), (None, None), (0, 3), (0.5, 1), (0.5, None), (0.9, 3)])
@pytest.mark.parametrize(
    "scorer",
    [
        create_scorer(M.dice.similarity), create_scorer(M.cosine.similarity, gram_size=3), create_scorer(M.tversky.similarity, alpha=1, beta=0.2),
        create_scorer(M.indel.normalized_similarity), create_scorer(M.levenshtein.normalized_similarity), create_scorer(M.jaro.similarity),
    ],
    ids=lambda s: s.name,
)
def test_searches_equal_brute_force(spark, scorer, threshold, limit):
    items = from_values(spark, TEAMS)
    queries = [(0, "new york mets"), (1, "braves"), (2, "a"), (3, ""), (4, "zzzz")]
    asked = spark.createDataFrame(queries, "q long, query string")
    matchers = [S.create_matcher(items, scorer, order="ord")]
    if S.X.supports(scorer):
        matchers.append(S.create_indexed_matcher(items, scorer, order="ord"))
    for matcher in matchers:
        got = {}
        for r in matcher.search(asked, threshold, limit).collect():
            got.setdefault(r.q, []).append((r["rank"], r.score, r.key))
        for q, text in queries:
            want = brute(text, threshold, limit, scorer)
            mine = sorted(got.get(q, []))
            assert [k for _, _, k in mine] == [k for *_, k in want], (q, threshold)
            assert all(math.isclose(s, w, abs_tol=1e-12) for (_, s, _), (w, *_) in zip(mine, want))
        if limit == 1:
            best = {r.q: r.key for r in matcher.best(asked, threshold).collect()}
            assert best == {q: w[0][2] for q, text in queries if (w := brute(text, threshold, 1, scorer))}


def test_search_details(spark):
    items = from_values(spark, TEAMS)
    ratio = create_scorer(M.ratio)
    got = [(r.key, round(r.score, 1)) for r in S.search("new york", items, ratio, threshold=60, limit=4, order="ord").orderBy("rank").collect()]
    assert got[:3] == [(0, 76.2), (1, 76.2), (4, 76.2)]
    assert [r.key for r in S.search(None, items, ratio, order="ord").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert S.search(None, items, ratio, threshold=10).count() == 0 and S.search("x", items, ratio, limit=0).count() == 0
    assert S.search_iter("x", items, ratio, threshold=101).count() == 0
    with pytest.raises(Exception, match="missing"):
        S.search("x", items, ratio, missing_items="throw").collect()
    with pytest.raises(Exception, match="missing"):
        S.search(None, items, create_scorer(M.levenshtein.distance)).collect()
    with pytest.raises(TypeError):
        S.create_indexed_matcher(items, ratio)
    with pytest.raises(ValueError):
        S.search("x", items, ratio, limit=-1)
    named = from_values(spark, {"x": "NEW YORK METS!!!", "y": "new_york_jets"})
    assert S.best_match("New YORK Mets", named, ratio, normalize=E.normalize_text).first().key == "x"
    with pytest.raises(TypeError):
        from_values(spark, "text")


THRESHOLDS = [
    (M.indel.normalized_similarity, 0.55), (M.indel.normalized_distance, 0.3), (M.indel.distance, 5), (M.ratio, 80), (M.ratio, 20), (M.levenshtein.distance, 2), (M.levenshtein.distance, 0),
    (M.levenshtein.normalized_similarity, 0.7), (M.levenshtein.normalized_distance, 0.45), (M.osa.distance, 2), (M.osa.normalized_similarity, 0.75), (M.damerau_levenshtein.distance, 3),
    (M.damerau_levenshtein.normalized_similarity, 0.6), (M.hamming.distance, 3), (M.hamming.normalized_similarity, 0.6), (M.lcs.distance, 3), (M.lcs.normalized_similarity, 0.6), (M.lcs.similarity, 8),
    (M.prefix.normalized_similarity, 0.4), (M.postfix.similarity, 3), (M.jaro.similarity, 0.8), (M.jaro.distance, 0.25), (M.jaro_winkler.similarity, 0.88), (M.jaro_winkler.distance, 0.1),
    (M.token_set_ratio, 70), (M.token_sort_ratio, 75), (M.token_ratio, 75), (M.dice.similarity, 0.6), (M.levenshtein.distance, 1.9),
]


@pytest.mark.parametrize(("metric", "threshold"), THRESHOLDS, ids=lambda x: getattr(x, "name", str(x)))
def test_thresholds_lose_nothing_and_need_no_cross_product(spark, metric, threshold):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 22))) for _ in range(90)]
    for t in texts[:40]:  # swaps, changes, gaps and other orders of the parts
        i = rng.randrange(max(1, len(t) - 2))
        texts.append(rng.choice([t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :], t[:i] + "é" + t[i + 1 :], t[:i] + t[i + 3 :], " ".join(t.split()[::-1]), t + "xyz"]))
    asked = spark.createDataFrame(list(enumerate(texts[:50])), "q long, query string")
    scorer = create_scorer(metric)
    found = S.search_iter(asked, from_values(spark, texts), scorer, threshold=threshold)
    got = {(r.q, r.key): r.score for r in found.collect()}
    want = {(q, k): s for q, a in enumerate(texts[:50]) for k, b in enumerate(texts) if (s := scorer.score(a, b, threshold)) is not None}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and want
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


BAGS = [
    (M.dice, {}, 0.6), (M.dice, {"gram_size": 1}, 0.9), (M.cosine, {"gram_size": 3}, 0.35), (M.cosine, {}, 1.0), (M.tversky, {"alpha": 1, "beta": 0.1}, 0.5), (M.tversky, {"alpha": 0, "beta": 2}, 0.7),
    (M.tversky, {"gram_size": 1, "alpha": 0.3, "beta": 0.3, "element_weights": {"a": 3.0, "b": 0.0}, "default_element_weight": 0.5}, 0.6),
]


@pytest.mark.parametrize(("family", "options", "threshold"), BAGS, ids=lambda x: getattr(x, "name", str(x)))
def test_rare_grams_lose_nothing(spark, family, options, threshold):
    rng = random.Random(21)
    texts = ["".join(rng.choices("aaabbc d", k=rng.randint(0, 15))) for _ in range(80)]
    texts += [t[1:] for t in texts[:25]] + [t + "z" for t in texts[:25]] + [texts[3], texts[4], "", "é"]
    if options.get("element_weights"):
        texts = [list(t) for t in texts]
    kind = "array<string>" if options.get("element_weights") else "string"
    scorer = create_scorer(family.similarity, **options)
    rows = spark.createDataFrame(list(enumerate(texts)), f"key long, text {kind}")
    asked = spark.createDataFrame(list(enumerate(texts[:45])), f"q long, query {kind}")
    want = {(q, k): s for q, a in enumerate(texts[:45]) for k, b in enumerate(texts) if (s := scorer.score(a, b, threshold)) is not None}
    for matcher in (S.create_indexed_matcher(rows, scorer), S.create_matcher(rows, scorer)):
        got = {(r.q, r.key): r.score for r in matcher.search_iter(asked, threshold).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and want
    index = S.create_indexed_matcher(rows, scorer).postings
    if family is M.dice and not options:  # most postings of the most frequent gram are left out
        held = index.opening(index.often, *S.X._least_shared(scorer, threshold)[1:]).where("gram = 'aa'").count()
        assert held < index.postings.where("gram = 'aa'").count() / 2


def test_blocked_records(spark, tmp_path, monkeypatch):
    """One small file a side, and one block that holds most rows: many tasks share it, no pair is lost, and its distance is worked out once."""
    from akin import queries

    rng = random.Random(31)
    name = lambda: "".join(rng.choices("abc", k=rng.randint(0, 13))) + rng.choice(["xy", "xy", "xy", "é", "", "ab"])
    c = [(i, rng.choice([None, name(), "copyxy"]), rng.choice([1, 1, 1, 2, None])) for i in range(300)]
    s = [(i, rng.choice([None, name(), "copyxy"]), rng.choice([1, 1, 1, 2, 3, None])) for i in range(80)]
    spark.createDataFrame(c, "c_custkey long, c_name string, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    want = sorted((i, j, float(d)) for i, x, k in c for j, y, n in s if None not in (x, y, k) and k == n and x[-2:] == y[-2:] and (d := K.levenshtein(x, y, (1, 1, 1))) <= 9)
    for most in (1 << 18, 40):
        monkeypatch.setattr(B, "BLOCK_PAIRS", most, raising=False)
        found = queries.r_records(spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == want and want
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("levenshtein(") == 1
    held = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) > 16 and max(held) < len(want) / 8


@pytest.mark.parametrize("most", [3, 10_000])
def test_blocked_pairs_cut_either_side(spark, monkeypatch, most):
    monkeypatch.setattr(B, "BLOCK_PAIRS", most)
    left = spark.createDataFrame([(i, k) for i, k in enumerate("aaaaaaaaabbbc")] + [(13, None)], "i long, k string")
    right = spark.createDataFrame([(j, k) for j, k in enumerate("aabbbbbbbbbbd")] + [(13, None)], "j long, n string")
    want = sorted((i, j) for i, k in left.collect() for j, n in right.collect() if k is not None and k == n)
    assert sorted((r.i, r.j) for r in B.blocked_pairs(left, right, [(F.col("k"), F.col("n"))]).collect()) == want
    assert B.blocked_pairs(left, right.where("n = 'd'"), [(F.col("k"), F.col("n"))]).collect() == []


def test_contained_token_sets_of_any_size(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, rng.randint(0, 40))) for _ in range(40)]
    texts += [" ".join(rng.sample(t.split(), len(t.split()) * 2 // 3)) for t in texts[:25]] + [texts[0], None, "  ", " ".join(words), "w1 w1", "w1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    asked = spark.createDataFrame(list(enumerate(texts[20:])), "q long, query string")
    got = sorted(map(tuple, S.contained(asked, rows).collect()))
    sets = [set((t or "").split()) for t in texts]
    want = sorted((q, k) for q, x in enumerate(sets[20:]) for k, y in enumerate(sets) if x and y and (x <= y or y <= x))
    assert got == want and any(len(sets[20 + q]) > 12 and len(sets[k]) > 12 and sets[20 + q] != sets[k] for q, k in got)


def test_soft_index_equals_scan(spark):
    soft = {"scorer": create_scorer(M.indel.normalized_similarity), "threshold": 0.6}
    rng = random.Random(4)
    words = ["swisscom", "swisscomm", "ag", "gmbh", "gmhb", "bank", "banks", "the", "a"]
    texts = [rng.choices(words, k=rng.randint(0, 4)) for _ in range(60)]
    items = from_values(spark, texts, "array<string>")
    asked = spark.createDataFrame(list(enumerate(texts[:20])), "q long, query array<string>")
    for more in ({}, {"element_weights": {"the": 0.0, "bank": 3.0}, "alpha": 1.0, "beta": 0.3}):
        scorer = create_scorer(M.tversky.similarity, gram_size=1, element_similarity=soft, **more)
        got = {(r.q, r.key): round(r.score, 12) for r in S.create_indexed_matcher(items, scorer).search_iter(asked, threshold=0.4).collect()}
        want = {(q, k): round(s, 12) for q, a in enumerate(texts[:20]) for k, b in enumerate(texts) if (s := scorer.score(a, b, 0.4)) is not None}
        assert got == want
        evidence = asked.select("query", explain_column(scorer, F.col("query"), F.array(F.lit("swisscom"), F.lit("bank"))).alias("e")).collect()
        for r in evidence:
            assert math.isclose(r.e.score, scorer.explain(r["query"], ["swisscom", "bank"])["score"])


def test_prepared_choices(spark):
    import akin

    ratio, items = create_scorer(M.ratio), from_values(spark, TEAMS)
    ready = akin.prepare_choices(items, ratio, order="ord", normalize=E.normalize_text)
    assert akin.create_matcher(ready, ratio, E.normalize_text).best("NEW york jets").first().key == 1
    for scorer, normalize in ((create_scorer(M.partial_ratio), E.normalize_text), (ratio, None)):
        with pytest.raises(ValueError, match="another"):
            akin.create_matcher(ready, scorer, normalize)
    with pytest.raises(TypeError, match="order"):
        akin.create_matcher(ready, ratio, E.normalize_text, order="ord")
    assert akin.ratio is M.ratio and "levenshtein" in dir(akin)
    ready.rows.unpersist()


def test_containment(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, "x"), (4, "")], "key long, text string")
    asked = spark.createDataFrame([(1, "b  a a"), (2, "x y")], "q long, query string")
    assert sorted(map(tuple, S.contained(asked, items).collect())) == [(1, 1), (1, 2), (2, 3)]


def test_batches(spark):
    q = spark.createDataFrame([(0, "kitten"), (1, "abc"), (2, None)], "i int, text string")
    c = spark.createDataFrame([(0, "sitting"), (1, "axc"), (2, "kitten")], "i int, text string")
    ns = create_scorer(M.levenshtein.normalized_similarity)
    got = {(r.row, r.col): r.score for r in B.score_matrix(q, c, ns, threshold=0.6, into="u8", score_multiplier=100).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 100, (1, 0): 0, (1, 1): 67, (1, 2): 0, (2, 0): 0, (2, 1): 0, (2, 2): 0}
    both = c.select("i", "text")
    mirrored = {(r.row, r.col): r.score for r in B.score_matrix(both, both, ns).collect()}
    assert len(mirrored) == 9 and mirrored == {(r.row, r.col): r.score for r in B.score_matrix(both, c.select("i", "text"), ns).collect()}
    rows = {r.row: list(r.scores) for r in B.matrix_rows(B.score_matrix(both, both, create_scorer(M.levenshtein.distance))).collect()}
    assert rows[0] == [0, 7, 3]
    distance = create_scorer(M.levenshtein.distance)
    assert [B.rejected(distance, t) for t in (1, 1.9, -0.5)] == [2, 2, math.inf] and B.rejected(ns, 0.5) == 0 and B.rejected(create_scorer(M.jaro.distance), 0.2) == 1
    assert B.rejected(create_scorer(M.levenshtein.distance, weights=(0.5, 1, 1)), 1.5) == 2.5
    left = spark.createDataFrame([(0, "abcdefgh"), (1, "a")], "i int, left string")
    right = spark.createDataFrame([(0, "abcdefgx"), (1, "b")], "i int, right string")
    got = [r.score for r in B.score_pairs(B.zip_pairs(left, right), create_scorer(M.ratio), into="i8").orderBy("i").collect()]
    assert got == [88, 0]  # a half is rounded away from zero
    with pytest.raises(Exception, match="same length"):
        B.score_pairs(B.zip_pairs(left, right.where("i = 0")), create_scorer(M.ratio)).collect()
    with pytest.raises(Exception, match="range"):
        B.score_pairs(B.zip_pairs(left, right), create_scorer(M.ratio), into="i8", score_multiplier=9).collect()
    assert [r.score for r in B.score_pairs(B.zip_pairs(left, right), create_scorer(M.ratio), into="u8c", score_multiplier=9).orderBy("i").collect()] == [255, 0]
    with pytest.raises(ValueError):
        B.stored(F.lit(1.0), "i64")


def test_script_columns(pairs):
    full = pairs.where("a is not null and b is not null").withColumn("s", O.editops_column(F.col("a"), F.col("b")))
    got = full.select(
        "a", "b", "s", O.to_opcodes(F.col("s")).alias("o"), O.inverse(F.col("s")).alias("i"), O.inverse_opcodes(O.opcodes_column(F.col("a"), F.col("b"))).alias("oi"),
        O.apply_script(F.col("s"), F.col("a"), F.col("b")).alias("applied"), O.matching_blocks(F.col("s")).alias("m"),
    ).collect()
    for r in got:
        s = O.editops(r.a, r.b)
        assert [tuple(o) for o in r.s.ops] == list(map(tuple, s.ops)) and r.applied == r.b
        assert [tuple(o) for o in r.o.ops] == list(map(tuple, s.to_opcodes().ops)) and [tuple(o) for o in r.i.ops] == list(map(tuple, s.inverse().ops))
        assert [tuple(o) for o in r.oi.ops] == list(map(tuple, s.to_opcodes().inverse().ops)) and [tuple(b) for b in r.m] == list(map(tuple, s.to_matching_blocks()))


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "new york metz"), (2, "nothing like it"), (1, "new york metz")], "q long, query string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q long, query string").parquet(f"{tmp_path}/in")
    items = from_values(spark, TEAMS)
    probe(stream, items.select("key", "text"), create_scorer(M.ratio), 90).writeStream.format("memory").queryName("probed").outputMode("append").start().processAllAvailable()

    assert {r.key for r in spark.table("probed").collect()} >= {0, 4}
    found = []
    matcher = S.create_matcher(items, create_scorer(M.ratio), order="ord")
    run = search_stream(stream.dropDuplicates(["q"]), matcher, lambda df, i: found.extend(df.collect()), threshold=60, limit=1, checkpoint=f"{tmp_path}/state")
    run.processAllAvailable()
    run.stop()
    assert [(r.q, r.key) for r in found] == [(1, 0)]
    timed = stream.withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    run = first_seen(timed, "query", "t", "1 hour").writeStream.format("memory").queryName("firsts").start()
    run.processAllAvailable()
    assert spark.table("firsts").count() == 2
    for q in spark.streams.active:
        q.stop()


def test_sources(spark, tmp_path):
    spark.createDataFrame([(7, "seven", 1.0)], "id long, name string, other double").write.parquet(f"{tmp_path}/t")
    got = read_collection(spark, f"{tmp_path}/t", "id", "name")
    assert got.collect() == [(7, 7, "seven")]
    assert "other" not in got._jdf.queryExecution().executedPlan().toString()


def test_kernel_prunes_before_python(spark):
    """Length bounds are evaluated below the Python node."""
    items = from_values(spark, TEAMS)
    plan = S.search_iter("new york", items, create_scorer(M.osa.distance), threshold=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("length")
    assert K.osa("new york", "new yrok") == 1
