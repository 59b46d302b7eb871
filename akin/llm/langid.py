"""Language identification by interpolated Kneser-Ney character models.

Each learned language has one model of four-character grams. Spark counts the grams of all
training texts (tasks pre-count, so the shuffle carries each distinct gram once a task);
the counts become interpolated Kneser-Ney probabilities, kept in sorted hash arrays that are
shared by the languages, one array an order. A text gets the language with the least
cross-entropy per character. It is rejected where that cross-entropy lies beyond what texts of
the language show, given the text's length. The score is the odds that the languages' cross-entropies
give; how fast these odds grow with length is what makes scores most likely. Both are
calibrated on labelled rows that are kept out of the counts; beyond the limit of rejection the score falls on.

Characters: letters and marks in lower case, anything else is a space, and runs of spaces
are one. Letters outside the basic plane share the 6,400 private-use codes.

Scale: up to ``max_grams`` grams are all in the broadcast model; a text is scored where it is read and
nothing is shuffled. Of more, the most frequent are broadcast, with their probabilities under all
grams (languages share ``max_grams`` evenly, and what a small one leaves goes to the larger), and
:class:`Rest` holds all counts in Spark: a text's other grams meet them in a join. Logarithms are
multiples of :data:`GRID`, so sums are exact in any order and both ways give the same results. For calibration
about ``calibration_rows`` labelled rows are kept out, and ``LABEL_ROWS`` of each label, but a fifth of a
label's rows at most and none of labels with fewer than five rows (a limit pooled from all labels serves these).

Cases: a null text and one without a letter is ``und``, rejected, with score 0. Without any
training row all texts are ``und``. Ties go to the language that sorts first. Labels of null
are not learned from. Repeated rows count as often as they occur, and are kept out together. Texts of
any length are read whole. Further columns are kept; one that has the result's name is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import checkpointed, chunks, mix

ORDER, SPACE = 4, 0x20
CHUNK = 1 << 19
MAX_GRAMS, CALIBRATION_ROWS = 1_000_000, 4_000
#: Logarithms are rounded to multiples of this, which 32-bit floats hold exactly up to 256.
GRID = 2.0**-16
LABEL_ROWS, LABEL_GRAMS = 200, 1_000
#: Share of a label's rows that may be kept out of the counts; labels of fewer rows keep none out.
KEPT_OUT, LEAST_ROWS = 0.2, 5
RESULT = "lang_pred string, score double, rejected boolean, cross_entropy double"
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Code of each code point (a space's, if it's neither letter nor mark), and whether it's a letter."""
    if not _tables:
        code, letter = np.full(0x110000, SPACE, np.uint16), np.zeros(0x110000, bool)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))[0]
            if kind in "LM":
                low = chr(point).lower()
                own = ord(low) if len(low) == 1 else point
                code[point] = own if own < 0x10000 else 0xE000 + own % 6400
                letter[point] = kind == "L"
        _tables.append((code, letter))
    return _tables[0]


@dataclass
class Grams:
    """Packed grams of several texts in order, one for each character predicted."""

    packed: np.ndarray
    first: np.ndarray  #: index of each text's first gram; one more entry than texts
    letters: np.ndarray  #: letters of each text


def grams_of(texts: list[bytes]) -> Grams:
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("\n".join([*strings, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code_of, is_letter = _characters()
    code = code_of[points]
    border = np.r_[0, np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings)))]
    letters = np.add.reduceat(is_letter[points].view(np.int8), border[:-1], dtype=np.int64) if len(points) else np.zeros(0, np.int64)
    inside = code != SPACE
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    first = np.r_[0, np.cumsum(np.add.reduceat(keep.view(np.int8), border[:-1], dtype=np.int64))] if len(points) else np.zeros(1, np.int64)
    code = code[keep].astype(np.uint64)
    packed, n = code.copy(), len(code)
    for back in range(1, ORDER):
        before = np.full(n, SPACE, np.uint64)
        before[back:] = code[: n - back]
        for i in range(back):  # nothing reaches back over a text's start
            at = first[:-1] + i
            before[at[at < first[1:]]] = SPACE
        packed |= before << np.uint64(16 * back)
    return Grams(packed, first, letters)


def count_grams(df: DataFrame, lang: Column, text: Column) -> DataFrame:
    """``(lang, gram, n)`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for langs, texts, _ in chunks(batches, CHUNK):
            langs = np.array(langs, object)
            for name in set(langs.tolist()):
                own = grams_of([t for t, l in zip(texts, langs, strict=True) if l == name]).packed
                own.sort()
                keys, n = _counted(own, np.ones(len(own), np.int64))
                if name in held:
                    keys, n = np.r_[held[name][0], keys], np.r_[held[name][1], n]
                    order = np.argsort(keys, kind="stable")
                    keys, n = _counted(keys[order], n[order])
                held[name] = keys, n
                if len(keys) > 1 << 20:
                    yield _count_batch(name, *held.pop(name))
        for name, (keys, n) in held.items():
            for at in range(0, len(keys), 1 << 16):
                yield _count_batch(name, keys[at : at + (1 << 16)], n[at : at + (1 << 16)])

    rows = df.select(lang.cast("string").alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys with their summed counts."""
    if not len(keys):
        return keys, n
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(n, at)


def _count_batch(name: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        keys, n = grams[order], n[order].astype(np.float64)
        self.levels: list[tuple] = []
        for m in range(ORDER, 0, -1):
            discount = _discount(n)
            context, at = np.unique(keys >> np.uint64(16), return_index=True)
            total, kinds = np.add.reduceat(n, at), np.diff(np.r_[at, len(keys)])
            self.levels.append((keys, np.maximum(n - discount, 0), context, total, discount * kinds / total))
            keys, n = np.unique(keys & np.uint64((1 << 16 * (m - 1)) - 1), return_counts=True)
            n = n.astype(np.float64)
        self.floor = 1.0 / (len(self.levels[-1][0]) + 1)

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], letters: int) -> KneserNey:
        """From kept grams, counts, their contexts' totals and discounts, by order; what isn't kept goes to shorter grams."""
        made = cls.__new__(cls)
        made.levels = []
        for grams, n, totals, discount in levels:
            order = np.argsort(grams)
            keys, reduced = grams[order], np.maximum(n[order] - discount, 0)
            context, at = np.unique(keys >> np.uint64(16), return_index=True)
            total = totals[order][at].astype(np.float64)
            made.levels.append((keys, reduced, context, total, (total - np.add.reduceat(reduced, at)) / total))
        made.floor = 1.0 / (letters + 1)
        return made

    def probability(self, grams: np.ndarray, m: int = ORDER) -> np.ndarray:
        if m == 0:
            return np.full(len(grams), self.floor)
        grams = grams & np.uint64((1 << 16 * m) - 1)
        keys, reduced, contexts, total, weight = self.levels[ORDER - m]
        lower = self.probability(grams, m - 1)
        i, known = _find(contexts, grams >> np.uint64(16))
        j, seen = _find(keys, grams)
        own = np.where(seen, reduced[j], 0) / total[i]
        return np.where(known, own + weight[i] * lower, lower)

    def backoff(self, contexts: np.ndarray, m: int) -> np.ndarray:
        _, _, known, _, weight = self.levels[ORDER - m]
        i, seen = _find(known, contexts)
        return np.where(seen, weight[i], 1.0)


def _discount(n: np.ndarray) -> float:
    return _discount_of(int((n == 1).sum()), int((n == 2).sum()))


def _discount_of(one: int, two: int) -> float:
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return i, keys[i] == values


def _log(p: np.ndarray) -> np.ndarray:
    return np.round(np.log(p) / GRID) * GRID


class HashArray:
    """Sorted hashes of keys with a row of values each, and one slot for each leading bit pattern."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.bits = int(np.clip(np.ceil(np.log2(max(2, len(keys)))) + 1, 8, 20))
        self.slot = np.minimum(np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)), len(keys) - 1).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the keys, and which keys there are."""
        hashes = mix(keys)
        at = self.slot[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        seen = self.hashes[at] == hashes
        rest = np.flatnonzero(~seen)
        at[rest], seen[rest] = _find(self.hashes, hashes[rest])
        return at, seen


class Model:
    """All languages' models as shared hash arrays, with what calibrates rejection and score."""

    #: All counts in Spark, if the arrays hold only the most frequent grams.
    rest: Rest | None = None

    def __init__(self, by_lang: dict[str, KneserNey]):
        self.langs = sorted(by_lang)
        models = [by_lang[name] for name in self.langs]
        self.grams: list[HashArray] = []
        self.weights: list[HashArray] = []
        for m in range(ORDER, 0, -1):
            keys = np.unique(np.concatenate([k.levels[ORDER - m][0] for k in models]))
            self.grams.append(HashArray(keys, _log(np.stack([k.probability(keys, m) for k in models], 1))))
            contexts = np.unique(keys >> np.uint64(16))
            self.weights.append(HashArray(contexts, _log(np.stack([k.backoff(contexts, m) for k in models], 1))))
        self.floor = _log(np.array([k.floor for k in models])).astype(np.float32)
        self._uncalibrated()

    @classmethod
    def beside(cls, rest: Rest, keys: np.ndarray, values: np.ndarray) -> Model:
        """Of some grams and their logarithms; the others are in Spark."""
        made = cls.__new__(cls)
        made.langs, made.rest, made.grams = rest.langs, rest, [HashArray(keys, values)]
        made._uncalibrated()
        return made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def _uncalibrated(self) -> None:
        #: By language: mean and spread of training texts' cross-entropy, and the spread that falls with length.
        self.usual = np.tile([0.0, np.inf, 0.0], (len(self.langs), 1))
        #: The odds of two languages are ``exp(-gap * steep * n ** power)`` for a text of n characters.
        self.steep, self.power = 4.0, 0.5

    def log_probability(self, packed: np.ndarray, m: int = ORDER) -> np.ndarray:
        if m == 0:
            return np.tile(self.floor, (len(packed), 1))
        packed = packed & np.uint64((1 << 16 * m) - 1)
        at, seen = self.grams[ORDER - m].find(packed)
        out = self.grams[ORDER - m].values[at]
        rest = np.flatnonzero(~seen)
        if len(rest):
            weight, known = self.weights[ORDER - m].find(packed[rest] >> np.uint64(16))
            out[rest] = self.log_probability(packed[rest], m - 1) + np.where(known[:, None], self.weights[ORDER - m].values[weight], 0)
        return out

    def cross_entropy(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: nats a character for each language, characters, letters."""
        grams = grams_of(texts)
        n = np.diff(grams.first)
        return -self._summed(grams, self.log_probability) / np.maximum(n, 1)[:, None], n, grams.letters

    def begun(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By text: sum of the logarithms that are here, characters, letters; and text, gram and times of the others."""
        grams, others = grams_of(texts), []

        def known(packed: np.ndarray) -> np.ndarray:
            at, seen = self.grams[0].find(packed)
            others.append(~seen)
            return np.where(seen[:, None], self.grams[0].values[at], np.float32(0))

        total = self._summed(grams, known)
        at = np.flatnonzero(np.concatenate(others)) if others else np.zeros(0, np.int64)
        text, gram = np.searchsorted(grams.first, at, "right") - 1, grams.packed[at]
        order = np.lexsort((gram, text))
        text, gram = text[order], gram[order]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])][: len(text)])
        return total, np.diff(grams.first), grams.letters, (text[new], gram[new], np.diff(np.r_[new, len(text)]))

    def _summed(self, grams: Grams, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        n = np.diff(grams.first)
        total = np.zeros((len(n), len(self.langs)))
        for at in range(0, len(grams.packed), 1 << 17):
            end = min(len(grams.packed), at + (1 << 17))
            part = score(grams.packed[at:end])
            a, b = np.searchsorted(grams.first, at, "right") - 1, np.searchsorted(grams.first, end, "left")
            own = np.arange(a, b)
            own = own[n[own] > 0]
            total[own] += np.add.reduceat(part, np.maximum(grams.first[own] - at, 0), axis=0, dtype=np.float64)
        return total

    def calibrate(self, langs: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> None:
        known = n > 0
        if not known.any():
            return
        column = np.searchsorted(self.langs, langs[known].astype(str))
        e, length = entropy[np.flatnonzero(known), column], n[known]
        self.usual[:] = _usual(e, length)  # pooled, for a language without rows here
        for i in np.unique(column):
            self.usual[i] = _usual(e[column == i], length[column == i])
        if len(column) < 20 or len(self.langs) < 2:
            return
        gaps, unsure = entropy[known] - entropy[known].min(1)[:, None], 1 / (len(column) + 2)
        costs = {}
        for steep, power in product(2.0 ** np.arange(-2, 8), (0.0, 0.25, 0.5, 0.75, 1.0)):
            odds = np.exp(-gaps * (steep * length**power)[:, None])
            right = odds[np.arange(len(column)), column] / odds.sum(1)
            costs[steep, power] = -np.mean((1 - unsure) * np.log(right + 1e-30) + unsure * np.log(1 - right + 1e-30))
        self.steep, self.power = min(costs, key=lambda at: (costs[at], at))

    def predict(self, texts: list[bytes], strictness: float) -> dict[str, np.ndarray]:
        return self.judge(*self.cross_entropy(texts), strictness)

    def judge(self, entropy: np.ndarray, n: np.ndarray, letters: np.ndarray, strictness: float) -> dict[str, np.ndarray]:
        best = entropy.argmin(1)
        row = np.arange(len(n))
        least = entropy[row, best]
        length = np.maximum(n, 1)
        odds = np.exp(-(entropy - least[:, None]) * (self.steep * length**self.power)[:, None])
        mean, spread, short = self.usual[best].T
        room = 0.25 + strictness * np.sqrt(spread**2 + short**2 / length)
        beyond = np.where(np.isfinite(room), np.maximum(0.0, least - mean - room), 0.0)
        und = letters == 0
        return {
            "lang_pred": np.where(und, "und", np.array(self.langs, object)[best]),
            "score": np.where(und, 0.0, odds[row, best] / odds.sum(1) * np.exp(-beyond / np.where(np.isfinite(room), room, 1.0))),
            "rejected": und | (beyond > 0), "cross_entropy": np.where(und, np.nan, least),
        }


def _usual(e: np.ndarray, length: np.ndarray) -> tuple[float, float, float]:
    mean = np.average(e, weights=np.minimum(length, 1000))
    long = length >= 200
    spread = e[long].std() if long.sum() >= 8 else 0.1
    return mean, spread, np.sqrt(np.mean((e - mean) ** 2 * np.minimum(length, 200)))


def _shares(sizes: dict[str, int], room: int) -> dict[str, int]:
    """How many grams each language keeps: even shares, what a small one leaves goes to the larger, ``LABEL_GRAMS`` at least."""
    shares = {}
    for at, (name, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        shares[name] = min(size, max(LABEL_GRAMS, room // (len(sizes) - at)))
        room = max(0, room - shares[name])
    return shares


def _shorter(level: DataFrame, m: int) -> DataFrame:
    """``(lang, gram, n)`` of grams of m characters, from those of one more: n counts the longer grams that end so."""
    shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * m) - 1))
    return checkpointed(level.sparkSession, level.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")))


def _by_language(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few rows of a language and longs. Made from Arrow, as a list's rows would start further Python workers, which stay."""
    lang, *numbers = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table([pa.array(lang, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], ["lang", *names]))


def _frequent(level: DataFrame, room: int) -> tuple[DataFrame, dict[str, dict[int, int]]]:
    """About ``room`` rows of ``(lang, gram, n)``, each language's most frequent; and by language how many grams have a count."""
    kinds: dict[str, dict[int, int]] = {}
    for r in level.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).collect():
        kinds.setdefault(r.lang, {})[r.n] = r.grams
    cuts = []
    for name, share in _shares({name: sum(k.values()) for name, k in kinds.items()}, room).items():
        least, ties = 0, 1.0
        for n in sorted(kinds[name], reverse=True):
            if share < kinds[name][n]:
                least, ties = n, share / kinds[name][n]
                break
            share -= kinds[name][n]
        cuts.append((name, least, int(ties * (1 << 20))))
    tie = (F.col("n") == F.col("least")) & (F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < F.col("ties"))
    bounds = _by_language(level.sparkSession, cuts, "least", "ties")
    return level.join(F.broadcast(bounds), "lang").where((F.col("n") > F.col("least")) | tie), kinds


def estimated(counts: DataFrame, room: int) -> dict[str, KneserNey]:
    """Models estimated in Spark from all of ``(lang, gram, n)``, of which about ``room`` grams an order are kept.

    What isn't kept changes probabilities, so :func:`train` doesn't use these; see :class:`Rest`.
    """
    levels: dict[str, list] = {}
    letters: dict[str, int] = {}
    level = counts
    for m in range(ORDER, 0, -1):
        level = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        kept, kinds = _frequent(level, room)
        letters = {name: sum(k.values()) for name, k in kinds.items()}
        totals = level.groupBy("lang", "context").agg(F.sum("n").alias("total"))
        found = kept.join(totals, ["lang", "context"]).select("lang", "gram", "n", "total").toArrow()
        langs, grams, n, total = (found.column(c).to_numpy() for c in ("lang", "gram", "n", "total"))
        for name, k in kinds.items():
            own = langs == name
            levels.setdefault(name, []).append((grams[own].view(np.uint64), n[own], total[own], _discount_of(k.get(1, 0), k.get(2, 0))))
        if m > 1:
            level = _shorter(level, m - 1)
    return {name: KneserNey.of(own, letters[name]) for name, own in levels.items()}


class Rest:
    """Counts of all grams in Spark, by order, and logarithms of any grams from them."""

    def __init__(self, counts: DataFrame):
        spark, level = counts.sparkSession, counts
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        at = (F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang")) - 1).cast("int").alias("at")
        self.grams: dict[int, DataFrame] = {}  #: by gram ``g<order>``: its count in each language that has it
        self.contexts: dict[int, DataFrame] = {}  #: by context ``c<order>``: total and number of its grams in each language
        self.discounts: dict[int, np.ndarray] = {}
        for m in range(ORDER, 0, -1):
            own = level.select(at, "gram", "n")
            few = [F.count(F.when(F.col("n") == k, 1)).alias(name) for k, name in ((1, "one"), (2, "two"))]
            every = own.groupBy("at").agg(*few, F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).orderBy("at").collect()
            self.discounts[m] = np.array([_discount_of(r.one, r.two) for r in every])
            self.grams[m] = checkpointed(spark, own.groupBy(F.col("gram").alias(f"g{m}")).agg(F.collect_list(F.struct("at", "n")).alias(f"n{m}")))
            if m > 1:
                both = own.groupBy("at", F.shiftrightunsigned("gram", 16).alias(f"c{m}")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
                self.contexts[m] = checkpointed(spark, both.groupBy(f"c{m}").agg(F.collect_list(F.struct("at", "total", "kinds")).alias(f"t{m}")))
                level = _shorter(level, m - 1)
        #: Single characters stand in one context.
        self.total, self.kinds = (np.array([[r[name] for r in every]], np.float64) for name in ("total", "kinds"))

    def logarithms(self, grams: DataFrame) -> DataFrame:
        """``(gram, logs array<float>)``: of each ``gram`` the probability's logarithm in each language, as :class:`Model` has it."""
        wanted = grams
        for m in range(ORDER, 0, -1):
            own = F.col("gram") if m == ORDER else F.col("gram").bitwiseAND(F.lit((1 << 16 * m) - 1))
            wanted = wanted.withColumn(f"g{m}", own).withColumn(f"c{m}", F.shiftrightunsigned(own, 16))
        for m in range(ORDER, 0, -1):
            wanted = wanted.join(F.broadcast(self.grams[m]) if m == 1 else self.grams[m], f"g{m}", "left")  # 65,536 characters at most
            if m > 1:
                wanted = wanted.join(F.broadcast(self.contexts[m]) if m == 2 else self.contexts[m], f"c{m}", "left")
        discounts, one = self.discounts, (self.total, self.kinds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = (batch.num_rows, len(discounts[1]))
                p = np.tile(1.0 / (one[1] + 1), (size[0], 1))
                logs = _log(p)
                for m in range(1, ORDER + 1):
                    (n,) = _dense(batch.column(f"n{m}"), size, "n")
                    total, kinds = one if m == 1 else _dense(batch.column(f"t{m}"), size, "total", "kinds")
                    known, total = total > 0, np.maximum(total, 1)
                    weight = np.where(known, discounts[m] * kinds / total, 1.0)
                    p = np.where(known, np.where(n > 0, np.maximum(n - discounts[m], 0), 0) / total + weight * p, p)
                    logs = np.where((n > 0).any(1)[:, None], _log(p), logs + _log(weight))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size[0] + 1, dtype=np.int32) * size[1]), pa.array(logs.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("gram"), lists], ["gram", "logs"])

        return wanted.select("gram", *(f"n{m}" for m in range(1, ORDER + 1)), *(f"t{m}" for m in range(2, ORDER + 1))).mapInArrow(run, "gram long, logs array<float>")

    def measured(self, df: DataFrame, model: Model, text_col: str, into: str) -> DataFrame:
        """Adds ``(e, n, letters)``: by text nats a character for each language, characters, letters; null for a null text.

        Equal texts are one, by their MD5. Only what the model doesn't hold is shuffled: a text's other
        grams, a row for each with how often it occurs.
        """
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, texts, _ in chunks(batches, CHUNK):
                total, n, letters, (text, gram, times) = shared.value.begun(texts)
                keys = pa.array(keys, pa.binary())
                none = lambda kind: pa.nulls(len(keys), kind)
                own = [keys, none(pa.int64()), none(pa.int64()), pa.array(list(total), pa.list_(pa.float64())), pa.array(n), pa.array(letters)]
                yield pa.RecordBatch.from_arrays(own, names)
                for at in range(0, len(text), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    size = len(text[part])
                    own = [keys.take(pa.array(text[part])), pa.array(gram[part].view(np.int64)), pa.array(times[part]), pa.nulls(size, pa.list_(pa.float64())), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(own, names)

        names = ["key", "gram", "times", "e", "n", "letters"]
        key = F.unhex(F.md5(F.col(text_col).cast("binary")))
        rows = df.select(key.alias("key"), F.col(text_col).alias("text")).where("text is not null")
        rows = checkpointed(spark, rows.mapInArrow(run, "key binary, gram long, times long, e array<double>, n long, letters long"))
        begun = rows.where("gram is null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("e", "n", "letters")), F.count(F.lit(1)).alias("copies"))
        others = rows.where("gram is not null").groupBy("key", "gram").agg(F.sum("times").alias("times"))
        logs = self.logarithms(others.select("gram").distinct())
        sums = [F.sum(F.col("logs")[i].cast("double") * F.col("times")) for i in range(len(self.langs))]
        others = others.join(logs, "gram").groupBy("key").agg(F.array(*sums).alias("others"))
        nothing = F.array_repeat(F.lit(0.0), len(self.langs))
        e = F.zip_with("e", F.coalesce("others", nothing), lambda a, b: -(a + b / F.col("copies")) / F.greatest("n", F.lit(1)))
        own = "key_" * (1 + max(map(len, [*df.columns, into])) // 3)  # longer than any column's name
        found = checkpointed(spark, begun.join(others, "key", "left").select(F.col("key").alias(own), F.struct(e.alias("e"), "n", "letters").alias(f"{own}of")))
        columns = [f"`{c}`" if c != into else F.col(f"{own}of").alias(into) for c in dict.fromkeys([*df.columns, into])]
        return df.withColumn(own, key).join(found, own, "left").select(*columns)


def _dense(lists: pa.ListArray, size: tuple[int, int], *names: str) -> Iterator[np.ndarray]:
    """Matrices of rows and languages, from lists of structs that name the language; zero for what isn't listed."""
    row = np.repeat(np.arange(size[0]), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    for name in names:
        out = np.zeros(size)
        out[row, flat.field("at").to_numpy()] = flat.field(name).to_numpy()
        yield out


def train(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", max_grams: int = MAX_GRAMS, calibration_rows: int = CALIBRATION_ROWS
) -> Model | None:
    """A model of all rows with a label; None if there are none."""
    spark = df.sparkSession
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    at = F.pmod(F.xxhash64(F.col(key_col), F.col(text_col)), F.lit(1 << 20))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), at.alias("at"))
    labels = {r.lang: r["rows"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not labels:
        return None
    share = calibration_rows / sum(labels.values())
    cuts = {name: int(min(KEPT_OUT, max(share, LABEL_ROWS / n)) * (1 << 20)) if n >= LEAST_ROWS else 0 for name, n in labels.items()}

    def sides() -> tuple[DataFrame, DataFrame]:
        """The rows that are learned from, and those that are kept out."""
        both = rows.join(F.broadcast(_by_language(spark, list(cuts.items()), "cut")), "lang")
        return both.where("at >= cut"), both.where("at < cut")

    counts = checkpointed(spark, count_grams(sides()[0], F.col("lang"), F.col("text")))
    learned = {r.lang for r in counts.select("lang").distinct().collect()}
    if alone := [name for name in labels if cuts[name] and name not in learned]:  # labels of a few equal rows
        cuts |= dict.fromkeys(alone, 0)
        counts = checkpointed(spark, count_grams(sides()[0], F.col("lang"), F.col("text")))
    all_grams = counts.count()
    if not all_grams:
        return None
    if all_grams <= max_grams:
        found = counts.toArrow()
        langs, grams, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
        model = Model({name: KneserNey(grams[langs == name].view(np.uint64), n[langs == name]) for name in set(langs.tolist())})
    else:
        rest = Rest(counts)
        found = rest.logarithms(_frequent(counts, max_grams)[0].select("gram").distinct()).toArrow()
        keys, logs = found.column("gram").to_numpy().view(np.uint64), found.column("logs").combine_chunks().flatten()
        model = Model.beside(rest, keys, logs.to_numpy().reshape(len(keys), -1))
    names = model.langs
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts, _ in chunks(batches, CHUNK):
            entropy, length, _ = shared.value.cross_entropy(texts)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(length)], ["lang", "e", "n"])

    sample = sides()[1].where(F.col("lang").isin(names))
    if sample.isEmpty():  # too few rows to keep any out
        sample = sides()[0].where(F.col("lang").isin(names)).limit(calibration_rows)
    if model.rest is None:
        seen = sample.select("lang", "text").mapInArrow(measure, "lang string, e array<double>, n long")
    else:
        seen = model.rest.measured(sample.select("lang", "text"), model, "text", "found").select("lang", "found.e", "found.n")
    seen = seen.toArrow()
    if seen.num_rows:
        langs, entropy, n = seen.column("lang").to_numpy(), np.array(seen.column("e").to_pylist()), seen.column("n").to_numpy()
        order = np.lexsort((*entropy.T, n, langs.astype(str)))  # sums of a sample that comes in any order
        model.calibrate(langs[order], entropy[order], n[order])
    return model


def predict(df: DataFrame, model: Model | None, text_col: str = "text", into: str = "language", strictness: float = 8.0) -> DataFrame:
    """Adds a struct column ``into`` (:data:`RESULT`) to the rows."""
    if model is None:
        nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
        return df.withColumn(into, nothing)
    if model.rest is not None:
        return _predict_beside(df, model, text_col, into, strictness)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.concat_arrays([_answer(shared.value, part, strictness) for part in _parts(batch)])

    return df.withColumn(into, run(F.col(text_col)))


def _parts(batch: pa.Array) -> Iterator[list[bytes]]:
    numbered = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch], ["id", "text"])
    for _, texts, _ in chunks([numbered], CHUNK):
        yield texts


def _predict_beside(df: DataFrame, model: Model, text_col: str, into: str, strictness: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    def run(measures: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in measures:
            none = {"e": [0.0] * len(shared.value.langs), "n": 0, "letters": 0}
            e, n, letters = (np.array([(m or none)[c] for m in batch.to_pylist()]) for c in ("e", "n", "letters"))
            yield _result(shared.value.judge(e.reshape(len(n), -1), n, letters, strictness))

    return model.rest.measured(df, model, text_col, into).withColumn(into, run(F.col(into)))


def _answer(model: Model, texts: list[bytes], strictness: float) -> pa.Array:
    return _result(model.predict(texts, strictness))


def _result(found: dict[str, np.ndarray]) -> pa.Array:
    fields = [pa.array(found["lang_pred"].tolist(), pa.string()), pa.array(found["score"]), pa.array(found["rejected"]), pa.array(found["cross_entropy"], mask=np.isnan(found["cross_entropy"]))]
    return pa.StructArray.from_arrays(fields, list(found))
