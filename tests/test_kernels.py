"""Kernels against plain dynamic programming, published example values and properties."""

import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from akin.functions import batches as V
from akin.functions import kernels as K
from akin.functions import metrics as M
from akin.operators.scorer import create_scorer

texts = st.text(alphabet="abcé😀 ", max_size=18)


def table(a, b, cost):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            rows[i][j] = cost(rows, i, j)
    return rows[-1][-1]


def naive_levenshtein(a, b, w=(1, 1, 1)):
    def cost(d, i, j):
        if not i or not j:
            return i * w[1] + j * w[0]
        return min(d[i - 1][j] + w[1], d[i][j - 1] + w[0], d[i - 1][j - 1] + (a[i - 1] != b[j - 1]) * w[2])

    return table(a, b, cost)


def naive_lcs(a, b):
    return table(a, b, lambda d, i, j: 0 if not i or not j else d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1]))


def naive_osa(a, b):
    def cost(d, i, j):
        if not i or not j:
            return i + j
        best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d[i - 2][j - 2] + 1)
        return best

    return table(a, b, cost)


@settings(max_examples=400, deadline=None)
@given(texts, texts)
def test_distances(a, b):
    assert K.levenshtein(a, b) == naive_levenshtein(a, b)
    assert K.lcs(a, b) == naive_lcs(a, b)
    assert K.osa(a, b) == naive_osa(a, b)
    assert K.damerau(a, b) <= K.osa(a, b) <= K.levenshtein(a, b)
    for w in ((1, 1, 2), (2, 2, 2), (1, 2, 1.5), (0, 0, 1), (3, 1, 9)):
        assert math.isclose(K.levenshtein(a, b, w), naive_levenshtein(a, b, w))
        assert K.levenshtein(a, b, w) <= K.levenshtein_maximum(len(a), len(b), w) + 1e-9


@pytest.mark.parametrize("n", [64, 65, 130, 700])
def test_long(n):
    rng = random.Random(n)
    a, b = ("".join(rng.choices("abcd", k=n + d)) for d in (0, 7))
    assert K.levenshtein(a, b) == naive_levenshtein(a, b) and K.lcs(a, b) == naive_lcs(a, b) and K.osa(a, b) == naive_osa(a, b)


@pytest.mark.parametrize(
    ("metric", "a", "b", "config", "value"),
    [
        (M.ratio, "this is a test", "this is a test!", {}, 96.55172413793103),
        (M.levenshtein.distance, "lewenstein", "levenshtein", {}, 2),
        (M.levenshtein.normalized_similarity, "abc", "axc", {}, 2 / 3),
        (M.levenshtein.distance, "kitten", "sitting", {"weights": (1, 1, 2)}, 5),
        (M.levenshtein.distance, "ÁÄ", "ABCD", {"weights": (1, 7, 5)}, 12),
        (M.levenshtein.distance, "ABCD", "ÁÄ", {"weights": (1, 7, 5)}, 24),
        (M.dice.similarity, "night", "nacht", {}, 0.25),
        (M.cosine.similarity, "night", "nacht", {}, 0.25),
        (M.dice.similarity, "banana", "bananas", {}, 10 / 11),
        (M.tversky.similarity, "banana", "bananas", {"alpha": 1, "beta": 1}, 5 / 6),
        (M.tversky.similarity, "bana", "banana", {"alpha": 1, "beta": 0}, 1),
        (M.tversky.similarity, "banana", "bana", {"alpha": 1, "beta": 0}, 0.6),
        (M.partial_ratio, "ax b", "a b a c b", {}, 600 / 7),
        (M.partial_ratio, "physics 2 vid", "study physics physics 2 video", {}, 100),
        (M.weighted_ratio, "new york mets", "the wonderful new york mets", {}, 90),
        (M.weighted_ratio, "South Korea", "North Korea", {}, 900 / 11),
        (M.token_set_ratio, "data engineer", "data engineer cloud platform", {}, 100),
        (M.token_sort_ratio, "data engineer", "data engineer cloud platform", {}, 2600 / 41),
        (M.jaro.similarity, "000000001", "0000010", {}, 0.8783068783),
        (M.jaro_winkler.similarity, "000000001", "0000010", {}, 0.9269841270),
        (M.hamming.distance, "South Korea", "North Korea", {}, 2),
        (M.hamming.distance, "aaaa", "aaaaa", {}, 1),
        (M.osa.distance, "CA", "ABC", {}, 3),
        (M.damerau_levenshtein.distance, "CA", "ABC", {}, 2),
        (M.levenshtein.distance, "a😀b", "ab", {}, 1),
        (M.levenshtein.distance, "a", [97], {}, 0),
    ],
)
def test_examples(metric, a, b, config, value):
    assert math.isclose(create_scorer(metric, **config).score(a, b), value, abs_tol=1e-9)


def test_soft_and_weighted():
    soft = {"gram_size": 1, "element_similarity": {"scorer": create_scorer(M.indel.normalized_similarity), "threshold": 0.8}}
    assert M.tversky.similarity(["swisscom", "ag"], ["swisscomm", "ag"], **soft) == 0.9705882352941176
    assert M.tversky.similarity(["swisscom", "ag"], ["swisscomm", "ag"], gram_size=1) == 0.5
    scorer = create_scorer(M.tversky.similarity, gram_size=1, alpha=1, beta=0.1, element_weights={"swisscom": 5, "ag": 0.1})
    found = scorer.explain(["swisscom", "ag"], ["swisscom"])
    assert math.isclose(found["score"], 0.9803921568627452) and len(found["matches"]) == 1
    assert found["unmatched_first"] == [{"element": "ag", "index": 1, "weight": 0.1, "unmatched_mass": 0.1}]
    assert create_scorer(M.tversky.similarity, gram_size=1, element_weights={"a": 2}, default_element_weight=2) == create_scorer(M.tversky.similarity, gram_size=1)


def test_transport_is_best():
    from collections import Counter
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        profit = {(i, j): rng.random() for i in range(n) for j in range(m) if rng.random() < 0.8}
        moved = K.transport([(i, j, 1.0, p) for (i, j), p in profit.items()], Counter(range(n)), Counter(range(m)))
        rows = list(range(n)) + [None] * m
        best = max(sum(profit.get((i, j), 0) for j, i in enumerate(order) if i is not None) for order in set(permutations(rows, m)))
        assert math.isclose(sum(p * u for *_, u, _, p in moved), best, abs_tol=1e-9)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_scores_within_bounds(a, b):
    for metric in [*M.FUZZ, *(getattr(f, k) for f in M.FAMILIES for k in ("distance", "similarity", "normalized_distance", "normalized_similarity"))]:
        score = create_scorer(metric).score(a, b)
        assert metric.bounds[0] <= score <= metric.bounds[1], metric.name
        if metric.kind not in ("partial_ratio",):
            assert math.isclose(score, create_scorer(metric).score(b, a), abs_tol=1e-9), metric.name


def test_empties_and_white():
    for metric in M.FUZZ:
        assert metric("", "") == (0 if metric.kind in ("token_set_ratio", "partial_token_set_ratio", "weighted_ratio") else 100), metric.name
    assert M.token_set_ratio("  ", "  ") == 0 and M.weighted_ratio("  ", "  ") == 100
    assert K.tokens("a b\u0085c\u001cd") == ["a", "b", "c", "d"] and K.tokens("a﻿b") == ["a﻿b"]
    assert M.dice.similarity("a", "a") == 1 and M.dice.similarity("a", "ab") == 0 and M.dice.similarity("", "") == 1
    nan = float("nan")
    assert M.levenshtein.distance([nan], [nan]) == 1 and M.dice.similarity([nan], [nan], gram_size=1) == 0


def test_alignment():
    assert K.partial_alignment("certain", "a certain string") == (100, 0, 7, 2, 9)
    assert K.partial_alignment("a certain string", "certain") == (100, 2, 9, 0, 7)


def test_rejections():
    with pytest.raises(ValueError, match="same length"):
        M.hamming.distance("ab", "abc", pad=False)
    for bad in ({"gram_size": 0}, {"gram_size": True}, {"alpha": 0, "beta": 0}, {"element_weights": {"a": 1}}):
        with pytest.raises(ValueError):
            create_scorer(M.tversky.similarity, **bad)
    with pytest.raises(TypeError):
        create_scorer(M.ratio, unknown=1)
    with pytest.raises(ValueError):
        create_scorer(M.levenshtein.distance).score(None, "a")
    assert create_scorer(M.ratio).score(None, None) == 0
    with pytest.raises(TypeError):
        create_scorer(M.ratio).score(1, "a")
    with pytest.raises(ValueError):
        create_scorer(M.ratio).score("a", "b", threshold=math.inf)
    own = create_scorer(lambda a, b: 2.0, direction="similarity", bounds=(0, 1))
    with pytest.raises(ValueError, match="within"):
        own.score("a", "b")
    with pytest.raises(ValueError):
        create_scorer(lambda a, b: 2.0, direction="similarity", bounds=(1, 2))


OPERATIONS = [(family, kind) for family, kinds in V.SCORES.items() for kind in kinds]


@pytest.mark.parametrize(("family", "kind"), OPERATIONS)
@pytest.mark.parametrize(("alphabet", "most"), [("ab", 9), ("aé😀漢字 ", 70), ("abcdefgh", 150), (" abc\x7f", 300)])
def test_batches_equal_kernels(family, kind, alphabet, most):
    """Many pairs at once: words of 64 bits and more, empty texts, characters beyond ASCII; pairs too long are left out."""
    rng = random.Random(most)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(0, most)))
    left = [word() for _ in range(150)]
    right = ["".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else word() for a in left]
    metric = getattr(M, kind) if family == "fuzz" else getattr(next(f for f in M.FAMILIES if f.name == family), kind)
    got, rest = V.SCORES[family][kind](pa.array(left), pa.array(right))
    for a, b, score, out in zip(left, right, got, rest, strict=True):
        assert out or math.isclose(score, metric.kernel(a, b), abs_tol=1e-12), (a, b)
    assert not rest.all() and (most <= V.MOST) <= (not rest.any())


@pytest.mark.parametrize("size", [1, 3, 7])
def test_batches_of_grams_with_options(size):
    rng = random.Random(size)
    left, right = (["".join(rng.choices("abcé ", k=rng.randint(0, 12))) for _ in range(200)] for _ in range(2))
    got, _ = V.SCORES["tversky"]["distance"](pa.array(left), pa.array(right), gram_size=size, alpha=0.2, beta=3)
    assert all(math.isclose(g, 1 - K.tversky(a, b, size, 0.2, 3), abs_tol=1e-12) for g, a, b in zip(got, left, right, strict=True))
    got, _ = V.SCORES["jaro_winkler"]["similarity"](pa.array(left), pa.array(right), prefix_weight=0.2)
    assert all(math.isclose(g, K.jaro_winkler(a, b, 0.2), abs_tol=1e-12) for g, a, b in zip(got, left, right, strict=True))


def test_batches_score_slices_nulls_and_equal_pairs():
    texts = pa.array(["skip", "night", None, "night", "", "x" * 400, "nacht"] * 30)
    other = pa.array(["skip", "nacht", "a", "nacht", "", "x" * 399 + "y", None] * 30)
    got = M._scored_together(V.SCORES["lcs"]["similarity"], M.lcs.similarity.kernel, {}, texts.slice(1), other.slice(1), 0.0).to_pylist()
    assert got[:6] == [3.0, 0.0, 3.0, 0.0, 399.0, 0.0] and len(got) == 209


def test_batches_of_a_long_text_among_short_ones(monkeypatch):
    rng = random.Random(5)
    left = ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)]
    right = ["".join(rng.choices("abc", k=3000 if i % 60 == 7 else rng.randint(0, 9))) for i in range(300)]
    monkeypatch.setattr(V, "CELLS", 9000)
    for family, kind, kernel in (("fuzz", "partial_ratio", K.partial_ratio), ("levenshtein", "distance", K.levenshtein), ("hamming", "distance", K.hamming), ("lcs", "similarity", K.lcs)):
        got, rest = V.SCORES[family][kind](pa.array(left), pa.array(right))
        assert not rest.any() and all(math.isclose(g, kernel(a, b), abs_tol=1e-12) for g, a, b in zip(got, left, right, strict=True))


def test_evidence_adds_up():
    """Explained masses against the definition, and pairs that use each element once."""
    rng = random.Random(12)
    scorer = create_scorer(M.tversky.similarity, gram_size=1, alpha=0.7, beta=0.3, element_weights={"red": 3.0, "blue": 0.5}, element_similarity={"scorer": create_scorer(M.indel.normalized_similarity), "threshold": 0.5})
    for _ in range(120):
        a, b = (rng.choices(["red", "reed", "blue", "blues", "green", "x"], k=rng.randint(0, 5)) for _ in range(2))
        found, price = scorer.explain(a, b), {"red": 3.0, "blue": 0.5}
        assert math.isclose(found["score"], scorer.score(a, b), abs_tol=1e-12)
        assert len({m["first_index"] for m in found["matches"]}) == len({m["second_index"] for m in found["matches"]}) == len(found["matches"])
        for side, own, unmatched in ((a, "first", "unmatched_first"), (b, "second", "unmatched_second")):
            assert math.isclose(found["totals"][f"{own}_mass"], sum(price.get(x, 1.0) for x in side))
            left = sum(m[f"{own}_unmatched_mass"] for m in found["matches"]) + sum(u["unmatched_mass"] for u in found[unmatched])
            assert math.isclose(left, found["totals"][f"{own}_unmatched_mass"], abs_tol=1e-9)
        for m in found["matches"]:
            assert m["first"] == a[m["first_index"]] and m["second"] == b[m["second_index"]] and m["exact"] == (m["first"] == m["second"])
            assert math.isclose(m["shared_mass"], min(m["first_weight"], m["second_weight"]) * m["similarity"])


def test_alignment_of_values():
    from akin.operators.alignment import partial_ratio_alignment

    assert partial_ratio_alignment("certain", "a certain string") == (100.0, 0, 7, 2, 9)
    assert partial_ratio_alignment("a certain string", "certain") == (100.0, 2, 9, 0, 7)
    assert partial_ratio_alignment(None, "x") is None and partial_ratio_alignment("", "") == (100.0, 0, 0, 0, 0)
    with pytest.raises(TypeError):
        partial_ratio_alignment(3, "x")
