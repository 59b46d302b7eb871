"""Operators 6 to 9 against brute force."""

import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from akin.llm import decontam, graphs, linededup, neardup, substring
from akin.llm.text import DROP_SHUFFLES

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 1 << 14, "group_bytes": 1 << 14}])
@pytest.mark.parametrize("k", [3, 50])
def test_substring(documents, corpus, k, sizes):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in corpus}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    got = {r.doc_id: r for r in substring.remove_repeats(documents, k, **sizes).collect()}
    assert len(got) == len(corpus)
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
        assert got[i].kept == " ".join(x for x, g in zip(w, gone) if not g)
        assert [g for s in got[i].spans for g in range(s.start, s.end)] == [j for j, g in enumerate(gone) if g]


def test_substring_odd_rows(spark, nothing):
    assert substring.remove_repeats(nothing).count() == 0
    rows = [(1, "a b c d e", 9), (1, "v w a b c", 8), (2, "a b c", 7), (None, "a b \t c", 6), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 9, r.kept, r.n_words, r.n_removed) for r in substring.remove_repeats(df, 3).collect())
    assert got == [(1, "a b c d e", 5, 0), (1, "v w a b c", 5, 0), (2, "", 3, 3), (9, "", 0, 0), (9, "a b c", 3, 0)]


ITEMS = [(1, None), (2, ""), (3, "one two"), (5, "Größe Été"), (4, "one two")]


@pytest.fixture(scope="module")
def items(spark, corpus):
    long = [(10 + k, " ".join(ALNUM.findall(corpus[i][1])[5:40])) for k, i in enumerate((3, 8, 30, 8))]
    return ITEMS + long


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_decontamination(spark, documents, corpus, items, most):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(8, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(documents, bench, max_entries=most).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    found |= own
                    hit |= set(range(j, j + n))
        assert (got[i].n_words, sorted(got[i]["items"])) == (len(w), sorted(found))
        assert {g for s in got[i].hits for g in range(s.start, s.end)} == hit


def test_decontamination_odd(spark, documents, nothing, corpus):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.hits for r in decontam.scan(documents, none).collect())
    assert decontam.scan(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_decontamination_by_a_join_judges_rows_by_themselves(spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("x", text), ("y", "seven eight"), ("y", None), ("z", "not here at all")], "item_id string, text string")
    rows = [(1, text + " more", 5), (1, "nothing of it", 5), (1, text + " more", 5), (None, "all of " + text, 5), (2, None, 5), (3, "SEVEN eight.", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    shown = lambda found: sorted((str(r.doc_id), r.n_words, [tuple(h) for h in r.hits], sorted(r["items"]), r.whole_items) for r in found.collect())
    got = shown(decontam.scan(df, bench, max_entries=3))
    assert got == shown(decontam.scan(df, bench)) and len(got) == 6 and got[0] == ("1", 3, [], [], 0)


def test_winnowing_guarantee(rng):
    for _ in range(200):
        v = np.array([rng.randrange(6) for _ in range(40)], np.uint64)
        kept = set(decontam.winnow(v, 5).tolist())
        for j in range(len(v) - 4):
            low = v[j : j + 5].min()
            assert any(j <= p < j + 5 and v[p] == low for p in kept)


def cells(t):
    w = ALNUM.findall(lower(t))
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None


def expected_classes(corpus):
    over = {i: i for i, _ in corpus}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    bags = {i: cells(t) for i, t in corpus}
    for i, t in corpus:
        for j, u in corpus:
            if j >= i or t is None or u is None:
                continue
            a, b = bags[i], bags[j]
            if (a is None and b is None and t == u) or (a and b and (a & b).total() >= 0.8 * (a | b).total()):
                x, y = top(i), top(j)
                over[max(x, y)] = min(x, y)
    return {i: top(i) for i in over}


def test_near_duplicates(documents, corpus):
    got = {r.doc_id: r.class_id for r in neardup.classes(documents).collect()}
    assert got == expected_classes(corpus)


def test_near_duplicates_leave_few_shuffle_files(spark, documents, monkeypatch):
    """Shuffles go as soon as what they lead to is written, not when the driver's JVM collects its garbage."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())

    def shuffles():
        return {n.split("_")[1] for f in folders for _, _, names in os.walk(f.getPath()) for n in names if n.startswith("shuffle_")}

    frames, settled = [], neardup.settled  # frames that are held keep their shuffles from the garbage
    monkeypatch.setattr(neardup, "settled", lambda spark, df: frames.append(df) or settled(spark, df))
    before, kept, end = shuffles(), spark.conf.get(DROP_SHUFFLES), time.time() + 20
    neardup.classes(documents)
    assert len(frames) > 10
    while len(shuffles() - before) > 10 and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert len(shuffles() - before) <= 10 and spark.conf.get(DROP_SHUFFLES) == kept


def test_near_duplicates_chain(spark, rng):
    """A chain whose ends are far apart, in buckets of one band each, still is one class."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(words)
        for _ in range(2):
            words[rng.randrange(400)] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df, bands=60, rows=2).collect()}
    assert got == expected_classes(rows) and set(got.values()) == {0}


def test_near_duplicates_odd(spark, nothing):
    assert neardup.classes(nothing).count() == 0
    df = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "a b c"), (3, None), (None, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(df).collect())) == [(1, 1), (2, 1), (3, 3)]


SHARED = [(7, "a b c d e f g"), (7, "p q r s t u v"), (3, "A b c d e, f g"), (4, "p q r s t u v!"), (9, None), (9, "nothing else"), (10, None), (None, "p q r s t u v"), (None, "alone here")]


def test_rows_that_share_an_id_are_one_whatever_their_order(spark, rng):
    for turn in range(3):
        rows = SHARED[::-1] if turn == 0 else rng.sample(SHARED, len(SHARED))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, neardup.classes(df).collect())) == [(3, 3), (4, 3), (7, 3), (9, 9), (10, 10)]


def test_later_copies_are_judged_by_their_texts(spark):
    df = spark.createDataFrame(SHARED, "doc_id long, text string")
    marks = {r.m: r.text for r in df.selectExpr("xxhash64(text) as m", "text").collect()}
    got = sorted(((r.id, marks[r.mark]) for r in neardup.later_copies(df).collect()), key=str)
    assert got == [(7, "a b c d e f g"), (7, "p q r s t u v"), (None, "p q r s t u v")]


def test_texts_of_several_components_in_a_bucket(spark, rng):
    """A template with parts of their own: many share buckets, few are alike, some only with a member that isn't the bucket's first."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = list(base)
        at = rng.randrange(150)
        own[at : at + 40] = [f"g{i % 30 if i < 90 else i}x{j}" for j in range(40)]
        for _ in range(rng.randrange(3)):
            own[rng.randrange(200)] = f"e{i}{rng.random()}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df, bands=80, rows=1).collect()}
    assert got == expected_classes(rows) and 20 < len(set(got.values())) < 150


def test_blocks_of_rare_cells_join_all_components(spark, rng, monkeypatch):
    rows = [(d, frozenset(rng.sample(range(60), rng.randint(1, 25)))) for d in range(120)]
    rows += [(200 + d, frozenset(rng.sample(sorted(own), max(1, len(own) - 2))) | {70 + d}) for d, own in rows[:60]]
    rows += [(400 + d, frozenset(range(1000 * d, 1000 * d + 9)) | {1, 2}) for d in range(1, 40)]
    pack = lambda own: bytearray(b"".join(c.to_bytes(6, "little") for c in sorted(own)))
    profiles = spark.createDataFrame([(d, pack(own)) for d, own in rows], "d long, cells binary")
    rest = profiles.selectExpr("7L as key", "pmod(d, 3) as salt", "600L as n", "d", "d % 137 as root")
    met = {r.d for r in neardup._meeting(rest, profiles, 0.6).collect()}
    alike = {(a, b) for a, x in rows for b, y in rows if a < b and a % 137 != b % 137 and len(x & y) >= 0.6 * len(x | y)}
    assert alike and {d for pair in alike for d in pair} <= met and not any(d > 400 for d in met)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    got = {(r.a, r.b) for r in neardup._across(rest, profiles, 0.6).collect()}
    joined = lambda pairs: {frozenset(x) for x in _groups({(a % 137, b % 137) for a, b in pairs})}
    assert joined(got) == joined(alike) and got <= alike | {(b, a) for a, b in alike}


def _groups(edges):
    over = {}
    for a, b in edges:
        x, y = over.get(a, {a}), over.get(b, {b})
        for n in x | y:
            over[n] = x | y
        for n in x | y:
            over[n] = over[a]
    return over.values()


def test_darts_agree_as_often_as_alike(rng):
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    other = base[:240] + [f"v{rng.randrange(3000)}" for _ in range(60)]
    texts = [" ".join(base).encode(), " ".join(other).encode()]
    doc, cell, first, _ = neardup.cells_of(texts)
    k = 2000
    s = neardup.darts(doc, cell, np.diff(first), k)
    a, b = set(cell[: first[1]].tolist()), set(cell[first[1] :].tolist())
    true = len(a & b) / len(a | b)
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_components_both_ways(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = dict(map(tuple, graphs.components(spark, df).collect()))
    many = dict(map(tuple, graphs.components(spark, df, task_edges=0).collect()))
    assert few == many and few[1040] == 1000


BLANK = " \t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000"


def aligned(a, b):
    """Patience diff as the books have it: common ends, lines that are unique on both sides, their longest increasing run, and again between."""

    def between(i, k, j, m):
        if i < k and j < m and a[i] == b[j]:
            return [(i, j), *between(i + 1, k, j + 1, m)]
        if i < k and j < m and a[k - 1] == b[m - 1]:
            return [*between(i, k - 1, j, m - 1), (k - 1, m - 1)]
        x, y = a[i:k], b[j:m]
        unique = [(i + x.index(v), j + at) for at, v in enumerate(y) if x.count(v) == 1 and y.count(v) == 1]
        if not unique:
            return []
        run = []  # of each pair: the length of the longest run up to it; the pair before it is the latest with one less
        for at, (p, _) in enumerate(unique):
            run.append(1 + max((run[e] for e in range(at) if unique[e][0] < p), default=0))
        at = max(e for e in range(len(run)) if run[e] == max(run))
        chain = [unique[at]]
        while run[at] > 1:
            at = max(e for e in range(at) if run[e] == run[at] - 1)
            chain.insert(0, unique[at])
        out, at = [], (i - 1, j - 1)
        for p, q in [*chain, (k, m)]:
            out += [*between(at[0] + 1, p, at[1] + 1, q), (p, q)]
            at = p, q
        return out[:-1]

    return between(0, len(a), 0, len(b))


def all_pairs(rows, least=25):
    """What line dedup leaves of the texts if every pair of them is aligned."""
    lines = [[(x.strip(BLANK), k) for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for _, t in rows]
    gone = [set() for _ in rows]
    for (i, _), first in zip(rows, lines):
        for n, (j, _) in enumerate(rows):
            if i is None or j is None or i >= j or not {x for x, _ in first} & {x for x, _ in lines[n]}:
                continue
            y, block = lines[n], []
            pairs = aligned([x for x, _ in first], [x for x, _ in y])
            for at, (p, q) in enumerate(pairs):
                block = [*block, q] if at and pairs[at - 1] == (p - 1, q - 1) else [q]
                if at + 1 == len(pairs) or pairs[at + 1] != (p + 1, q + 1):
                    if sum(len(y[x][0]) for x in block) >= least:
                        gone[n] |= {y[x][1] for x in block}
    return [(i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in own), len(own)) for (i, t), own in zip(rows, gone)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def left(df, **how):
    return by_id((r.doc_id, r.text, r.removed_lines) for r in linededup.remove_common_blocks(df, **how).collect())


def test_line_dedup(documents, corpus):
    got = {r.doc_id: r for r in linededup.remove_common_blocks(documents).collect()}
    want = all_pairs(corpus)
    assert {i: (r.text, r.removed_lines, r.source) for i, r in got.items()} == {i: (t, n, f"src{i % 3}") for i, t, n in want}
    assert sum(n for _, _, n in want) > 50


@pytest.mark.parametrize("rare", [2, linededup.RARE])
def test_line_dedup_of_frequent_lines(spark, rng, rare):
    frequent = [f"frequent line {k} of some length" for k in range(5)] + ["short one", "short two", "menu", "home"]
    rows = []
    for i in range(60):
        own = rng.sample(frequent, rng.randint(2, 7)) + [f"only here {i} {k} and nowhere else" for k in range(rng.randint(0, 2))]
        own += own[:1] * rng.randint(0, 1)
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    assert left(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare) == by_id(all_pairs(rows))


def test_line_dedup_of_adjacent_short_lines_that_many_share(spark):
    """Two short lines that only together are long enough, each of which other documents open or close with."""
    low, mid = "fifteen letters", "letters fifteen"
    rows = [(0, f"{low}\nx0"), (1, f"x1\n{mid}")] + [(2 + i, f"head {i}\n{low}\n{mid}\ntail {i}") for i in range(13)]
    got = left(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == by_id(all_pairs(rows)) and [n for _, _, n in got] == [0, 0, 0] + [2] * 12


def test_line_dedup_ignores_white_space_at_the_ends(spark):
    line = "the same words in every file"
    rows = [(1, f"{line}\nfirst"), (2, f"\t{line}\r\nsecond\r\n"), (3, f"third\n\u00a0{line}\u2003"), (4, "\t\n \r\n" * 20), (5, "\t\n \r\n" * 20)]
    got = left(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == by_id(all_pairs(rows)) and [n for _, _, n in got] == [0, 1, 1, 0, 0]


def test_line_dedup_of_short_lines(spark):
    menu = ["home", "products", "about us", "contact", "login"]
    rows = [(1, "\n".join(["the first", *menu])), (2, "\n".join([*menu, "the next"])), (3, "home\nlogin\nalone")]
    got = left(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == by_id(all_pairs(rows)) and got[1][1] == "the next"


def test_line_dedup_odd(spark, nothing):
    assert linededup.remove_common_blocks(nothing).count() == 0
    line = "a line that is surely long enough to go"
    df = spark.createDataFrame([(1, line, 0), (1, line + "\nmore", 0), (2, "new\n" + line, 0), (None, line, 0)], "doc_id long, text string, _owner int")
    got = sorted((r.doc_id or 0, r.text) for r in linededup.remove_common_blocks(df).collect())
    assert got == [(0, line), (1, line), (1, line + "\nmore"), (2, "new")]


def test_patience_is_a_common_subsequence(rng):
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert linededup.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
