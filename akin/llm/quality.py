"""Quality scores by a generalised additive model with pairwise interactions.

Each text gets a few statistics. Every statistic is cut into quantile bins, and shallow
trees are boosted in turn over the features: a tree sees one feature (or, afterwards, one
pair of features), so the sum of a feature's trees is a lookup table over its bins. A score
is the logistic function of the summed tables' entries: integer bins and additions.

Fitting uses at most ``sample_rows`` labelled rows, taken by the order of a hash of their
ids; their statistics are worked out by Spark and only those come to the driver. All texts
are then scored where they are read, without a shuffle.

Cases: null and empty texts have statistics of 0 and are scored by them. Without labelled
rows of both kinds the score is their share, or 0.5 if there are none. Repeated rows count
as often as they occur. Further columns are kept by ``score`` and cannot clash but for the
result's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NON_SPACE, chunks, class_table, mix, words_of

SAMPLE_ROWS = 20_000
_UPPER = class_table(range(0x41, 0x5B))
_LOWER = class_table(range(0x61, 0x7B))
_DIGIT = class_table(range(0x30, 0x3A))
_HIGH = class_table(range(0x80, 0x100))
_STOP = class_table(b".!?")
_COMMA = class_table(b",;:'\"()-")
_OTHER = class_table(b for b in range(0x21, 0x7F) if not (_UPPER | _LOWER | _DIGIT | _STOP | _COMMA)[b])
FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "high", "digits", "stops", "marks", "others", "bangs", "distinct_words",
    "repeated_pairs", "common_words", "words_per_line", "distinct_lines", "others_per_word",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of :data:`FEATURES` for each text."""
    n = len(texts)
    words = words_of(texts, NON_SPACE)
    data = np.frombuffer(words.data, np.uint8)
    border = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    size = np.maximum(np.diff(border) - 1, 1)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    share = lambda table: np.add.reduceat(table[data].view(np.int8), border[:-1], dtype=np.int64) / size
    length = words.end - words.start
    by_text = lambda values: np.bincount(words.doc, values, n)
    distinct = _distinct(words.doc, words.hash, n)
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]) if len(words) else np.zeros(0, bool)
    ends = np.searchsorted(words.start, np.flatnonzero(data == 0x0A))
    line_doc = np.repeat(np.arange(n), np.add.reduceat((data == 0x0A).view(np.int8), border[:-1], dtype=np.int64))
    begins = np.r_[0, ends[:-1]]
    filled = ends > begins
    total = np.r_[np.uint64(0), np.cumsum(mix(words.hash))]
    line = (total[ends] - total[begins])[filled]
    lines = np.maximum(np.bincount(line_doc[filled], minlength=n), 1)
    others = share(_OTHER)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), by_text(length) / some, by_text(length > 12) / some, share(_UPPER), share(_HIGH), share(_DIGIT), share(_STOP),
            share(_COMMA), others, share(class_table(b"!")), distinct / some, np.bincount(words.doc[1:][same], minlength=n) / some, by_text(length <= 3) / some,
            np.log1p(count / lines), _distinct(line_doc[filled], line, n) / lines, others * size / some,
        ],
        1,
    ).astype(np.float32)


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float64)


class AdditiveModel:
    """Lookup tables over binned features and over some pairs of them."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, leaves: int = 3):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.leaves = bins, pair_bins, rounds, pair_rounds, pairs, rate, leaves
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(y.mean()) if len(y) else 0.5
        self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not len(y) or share in (0.0, 1.0):
            return self
        cut = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
        self.edges = [cut(c, self.bins) for c in x.T]
        self.coarse = [cut(c, self.pair_bins) for c in x.T]
        fine = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, b in enumerate(fine):  # cyclic: each feature's tree fits what the others left
                step = self._tree(*self._sums(b, len(self.tables[j]), logit, y))
                self.tables[j] += step
                logit += step[b]
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            width = len(self.coarse[j]) + 1
            g, h = self._sums(rough[i] * width + rough[j], (len(self.coarse[i]) + 1) * width, logit, y)
            gains.append((float((g**2 / (h + 5)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
                g, h = self._sums(rough[i] * table.shape[1] + rough[j], table.size, logit, y)
                step = self._pair_tree(g.reshape(table.shape), h.reshape(table.shape))
                table += step
                logit += step[rough[i], rough[j]]
        return self

    @staticmethod
    def _sums(b: np.ndarray, n: int, logit: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Step of a tree with at most ``leaves`` leaves over ordered bins."""
        parts = [(0, len(g))]
        for _ in range(self.leaves - 1):
            best, chosen = 1e-9, None
            for a, b in parts:
                if b - a < 2:
                    continue
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gs, hs = g[a:b].sum(), h[a:b].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = float(gain[k]), (a, a + k + 1, b)
            if chosen is None:
                break
            a, m, b = chosen
            parts.remove((a, b))
            parts += [(a, m), (m, b)]
        step = np.zeros(len(g))
        for a, b in parts:
            step[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + 1)
        return step

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Step of a tree that splits one feature, and each half by the other."""

        def halves(axis: int):
            gl, hl = g.sum(1 - axis).cumsum()[:-1], h.sum(1 - axis).cumsum()[:-1]
            if not len(gl):
                return -np.inf, 0
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
            return float(gain.max()), int(gain.argmax()) + 1

        axis = int(halves(1)[0] > halves(0)[0])
        _, at = halves(axis)
        step = np.zeros(g.shape)
        for part in (slice(0, at), slice(at, None)) if at else (slice(None),):
            own = (part, slice(None)) if axis == 0 else (slice(None), part)
            one = AdditiveModel(rate=self.rate, leaves=2)._tree(g[own].sum(axis), h[own].sum(axis))
            step[own] = one[None, :] if axis == 0 else one[:, None]
        return step

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for column, edges, table in zip(x.T, self.edges, self.tables, strict=False):
            logit += table[np.searchsorted(edges, column, "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            logit += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-logit))


def sample_of(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most about ``rows`` rows, by a hash of the key; all rows if there are no more than that."""
    total = df.count()
    return df if total <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(0.98 * rows / total * (1 << 20)))


def train(labelled: DataFrame, label_col: str, key_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, model: AdditiveModel | None = None) -> AdditiveModel:
    """A model of the rows whose label is not null (0 or 1)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts, _ in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(list(statistics(texts)), pa.list_(pa.float32()))], ["y", "x"])

    rows = sample_of(labelled.where(F.col(label_col).isNotNull()), F.col(key_col), sample_rows)
    found = rows.select(F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text")).mapInArrow(measure, "y int, x array<float>").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(found.num_rows, len(FEATURES))
    y = found.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y)) if len(y) else slice(0)  # sums then don't depend on the rows' order
    return (model or AdditiveModel()).fit(x[order], y[order])


def score(df: DataFrame, model: AdditiveModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the column ``into``: probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            numbered = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch], ["id", "text"])
            parts = [shared.value.score(statistics(texts)) for _, texts, _ in chunks([numbered])]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return df.withColumn(into, run(F.col(text_col)))
