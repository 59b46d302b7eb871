"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and beginnings of words. Of a bounded sample of labelled texts,
terms that lean toxic beyond chance (``least_evidence``, in nats, in ``least_texts`` texts or more)
make the vocabulary; all other words of a text count together as one background term, so that
similarity sees how dense the telling terms are. So similarity is not over all words: a toxic
text whose words the sample doesn't show to be so is not found. The examples' TF-IDF vectors lie in an inverted index whose
postings are cut into blocks of examples with the largest weight of each term in each block.
A search bounds every block from these maxima, scores the most promising blocks exactly, and
then all blocks whose bound still beats the k-th similarity: the result is exact.

The neighbours vote, weighted by closeness; votes are calibrated by isotonic regression on
the examples themselves, each left out of its own search. Neighbours are kept as evidence.

Scale: only the sample's counts and vectors come to the driver (``sample_rows``,
``max_terms``); the index is broadcast, and texts are scored where they are read.

Cases: a text without a telling term, so also a null or empty one, gets the calibrated share
of toxic texts among such examples and has no evidence. Equal similarities go to the smaller
example. Texts of any length are read whole. Repeated examples each have a vote. Rows with a null
key or label are not learned from. With no labelled rows every score is 0. Further columns are kept; one that has the result's name is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import sample_of
from .text import ALNUM_HIGH, checkpointed, chunks, words_of

SAMPLE_ROWS, MAX_TERMS, NEIGHBOURS, BLOCK = 20_000, 20_000, 15, 64
BEGINNINGS = (4, 5, 6, 7, 8, 9)
LEAST_EVIDENCE, LEAST_TEXTS = 13.0, 5


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, term)`` of every occurrence, and words by text."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    words = words_of(lowered, ALNUM_HIGH, beginnings=BEGINNINGS)
    doc = np.concatenate([words.doc, *(words.doc[i] for i, _ in words.beginnings)])
    return doc, np.concatenate([words.hash, *(h for _, h in words.beginnings)]), np.diff(words.first)


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their counts, in order of text and term."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[at], term[at], np.diff(np.r_[at, len(doc)])


class Vocabulary:
    """Sorted hashes of the telling terms, with a sieve in front."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.idf = terms[order], idf[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.terms >> np.uint64(42)).astype(np.int64)] = True

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors as ``(text, term index, weight)``; the index past the last is the background. Texts without a term have none."""
        doc, term, words = terms_of(texts)
        near = np.flatnonzero(self.sieve[(term >> np.uint64(42)).astype(np.int64)])
        doc, term = doc[near], term[near]
        if not len(self.terms) or not len(doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        index = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        own = self.terms[index] == term
        doc, index, n = _counted(doc[own], index[own])
        weight = np.log1p(n) * self.idf[index]
        have = np.unique(doc)
        doc, index = np.r_[doc, have], np.r_[index, np.full(len(have), len(self.terms))]
        weight = np.r_[weight, np.log1p(words[have])]
        norm = np.sqrt(np.bincount(doc, weight**2, len(texts)))
        order = np.lexsort((index, doc))
        return doc[order], index[order], (weight / norm[doc])[order]


@dataclass
class BlockMaxIndex:
    """Postings by term, cut into blocks of :data:`BLOCK` examples, with each block's largest weight."""

    keys: np.ndarray  #: id of each example, ascending
    labels: np.ndarray
    n_terms: int
    ids: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    blocks: list[np.ndarray] = field(default_factory=list)
    maxima: list[np.ndarray] = field(default_factory=list)

    def fill(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> BlockMaxIndex:
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        edge = np.searchsorted(term, np.arange(self.n_terms + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            ids, own = example[a:b], weight[a:b]
            block = ids // BLOCK
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(ids) else np.zeros(0, np.int64)
            self.ids.append(ids)
            self.weights.append(own)
            self.blocks.append(block[at])
            self.maxima.append(np.maximum.reduceat(own, at) if len(ids) else own)
        return self

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest similarity and their similarities, nearest first."""
        n = len(self.keys)
        bound = np.zeros(-(-n // BLOCK))
        for t, w in zip(term, weight, strict=True):
            bound[self.blocks[t]] += w * self.maxima[t]
        scores = np.zeros(n)
        order = np.argsort(-bound, kind="stable")
        first = order[: max(1, -(-4 * k // BLOCK))]
        self._score(term, weight, first, len(bound), scores)
        if without >= 0:
            scores[without] = -1.0
        reached = np.sort(scores)[-k] if n >= k else 0.0
        rest = order[len(first) :]
        rest = rest[bound[rest] >= reached - 1e-12]
        if len(rest):
            self._score(term, weight, rest, len(bound), scores)
            if without >= 0:
                scores[without] = -1.0
        if n > 4 * k:
            near = np.argpartition(-scores, k)[: k + 1]
            near = np.flatnonzero(scores >= scores[near].min())
        else:
            near = np.arange(n)
        near = near[np.lexsort((near, -scores[near]))][:k]
        near = near[scores[near] > 0]
        return near, scores[near]

    def _score(self, term, weight, blocks: np.ndarray, n_blocks: int, scores: np.ndarray) -> None:
        chosen = np.zeros(n_blocks, bool)
        chosen[blocks] = True
        for t, w in zip(term, weight, strict=True):
            own = chosen[self.ids[t] // BLOCK]
            scores[self.ids[t][own]] += w * self.weights[t][own]


class Model:
    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, without_terms: float, neighbours: int = NEIGHBOURS):
        self.vocabulary, self.index, self.without_terms, self.neighbours = vocabulary, index, without_terms, neighbours
        self.votes, self.shares = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def _vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        weight = 1.0 / (1.02 - np.minimum(similarity, 1.0))
        return float((weight * self.index.labels[near]).sum() / weight.sum()) if len(near) else 0.0

    def calibrate(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Isotonic regression of the labels on votes from which each example is left out."""
        edge = np.searchsorted(example, np.arange(len(self.index.keys) + 1))
        votes = np.array([self._vote(*self.index.search(term[a:b], weight[a:b], self.neighbours, i)) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))])
        if len(votes) < 20:
            return
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y in zip(votes[order], self.index.labels[order], strict=True):
            pools.append([y, 1.0, v, v])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
                y2, n2, _, v2 = pools.pop()
                pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], v2]
        prior = float(self.index.labels.mean())
        self.votes = np.array([(p[2] + p[3]) / 2 for p in pools])
        self.shares = np.array([(p[0] + prior) / (p[1] + 1) for p in pools])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple]]]:
        doc, term, weight = self.vocabulary.vectors(texts)
        out, evidence = np.full(len(texts), self.without_terms), [[] for _ in texts]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            near, similarity = self.index.search(term[a:b], weight[a:b], self.neighbours)
            if len(near):
                out[doc[a]] = np.interp(self._vote(near, similarity), self.votes, self.shares)
                evidence[doc[a]] = list(zip(self.index.keys[near].tolist(), similarity.tolist(), self.index.labels[near].tolist(), strict=True))
        return out, evidence


def train(
    labelled: DataFrame, label_col: str, key_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, neighbours: int = NEIGHBOURS,
    least_evidence: float = LEAST_EVIDENCE, least_texts: int = LEAST_TEXTS,
) -> Model | None:
    """A model of the rows whose label is not null (0 or 1); None if there are none."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull())
    rows = sample_of(rows, F.col(key_col), sample_rows)
    rows = checkpointed(spark, rows.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in chunks(batches):
            y = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, term, _ = _counted(*terms_of(texts)[:2])
            term, at = np.unique(term, return_inverse=True)
            n, toxic = np.bincount(at, minlength=len(term)), np.bincount(at, y[doc], len(term)).astype(np.int64)
            for i in range(0, len(term), 1 << 16):
                own = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(term[own].view(np.int64)), pa.array(n[own]), pa.array(toxic[own])], ["term", "n", "toxic"])

    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return None
    share = min(max(toxic / total, 1e-6), 1 - 1e-6)
    own = F.col("toxic") / F.col("n")
    part = lambda p, q: F.when(p > 0, p * F.log(p / F.lit(q))).otherwise(0.0)
    evidence = F.col("n") * (part(own, share) + part(1 - own, 1 - share))
    counts = rows.mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = counts.withColumn("evidence", evidence).where((F.col("n") >= least_texts) & (F.col("evidence") >= least_evidence) & (own > share))
    found = counts.orderBy(F.desc("evidence"), "term").limit(max_terms).toArrow()
    n = found.column("n").to_numpy()
    vocabulary = Vocabulary(found.column("term").to_numpy().view(np.uint64), np.log((total + 1) / (n + 1)) + 1)
    shared = spark.sparkContext.broadcast(vocabulary)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, part in chunks(batches):
            doc, term, weight = shared.value.vectors(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(term)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(weight)),
                ],
                ["key", "y", "term", "weight"],
            )

    vectors = rows.mapInArrow(vector, "key long, y int, term array<long>, weight array<double>")
    filled = vectors.where(F.size("term") > 0).orderBy("key", "y", "weight").toArrow()
    empty, empty_toxic = vectors.where(F.size("term") == 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    index = BlockMaxIndex(filled.column("key").to_numpy(), filled.column("y").to_numpy().astype(np.float64), len(vocabulary.terms) + 1)
    lengths = [len(t) for t in filled.column("term").to_pylist()]
    example = np.repeat(np.arange(filled.num_rows), lengths)
    term = np.fromiter((t for row in filled.column("term").to_pylist() for t in row), np.int64, sum(lengths))
    weight = np.fromiter((w for row in filled.column("weight").to_pylist() for w in row), np.float64, sum(lengths))
    model = Model(vocabulary, index.fill(example, term, weight), float(empty_toxic + share) / (empty + 1), neighbours)
    model.calibrate(example, term, weight)
    return model


def score(df: DataFrame, model: Model | None, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds a struct ``into`` with ``score`` and ``evidence`` (example, similarity, label)."""
    kind = "struct<score:double,evidence:array<struct<example:bigint,similarity:double,label:int>>>"
    if model is None:
        return df.withColumn(into, F.from_json(F.lit('{"score": 0.0, "evidence": []}'), kind))
    shared = df.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])

    @F.arrow_udf(kind)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            numbered = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch], ["id", "text"])
            scores, evidence = [], []
            for _, part, _ in chunks([numbered]):
                own, near = shared.value.score(part)
                scores.append(own)
                evidence += [[{"example": i, "similarity": s, "label": int(y)} for i, s, y in row] for row in near]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(evidence, pa.list_(item))], ["score", "evidence"])

    return df.withColumn(into, run(F.col(text_col)))
