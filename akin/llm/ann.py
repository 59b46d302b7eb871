"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Codebooks of 16 centres a two-dimensional subspace are fitted so that the error of inner
products counts: the part of a residual parallel to its vector weighs ``eta`` times the rest
(``eta`` follows from the dimension and the threshold ``T``). Every vector is coded with four
bits a subspace. A block of codes is scanned for many queries by adding table entries, one
lookup for each byte of code; the block's best ``rerank`` vectors are then scored exactly, as
the block holds its vectors too. Of each block the same share is scored exactly however many
blocks there are, so recall doesn't fall as the table grows.

Scale: vectors are dealt into blocks of bounded bytes once and then stay where they are; what moves
are the queries, ``query_bytes`` at a time to all tasks, and back the best ``k + 1`` of each
task and query, which are merged ``FAN`` tasks at a time. So the shuffle is the table's size, and
grows with it. Equal vectors are one node, of which the ``k + 1`` smallest ids are kept (no
more can be in a result), so a vector that a third of all rows share is coded and scanned once.
The fit uses about ``sample_rows`` vectors; all are indexed.

Cases: vectors that are null, all zero, of another length than most, or that hold a null or
non-finite component take no part, neither as query nor as candidate. Ties go to the smaller
id. Rows that repeat an id and vector count once. Where one id has several vectors, each of
them is asked for and found; in a list an id counts once, with its best score, and such a list
can be shorter than ``k``. With fewer candidates than ``k`` all are given. Only the two columns
(and what ``is_query`` names) are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .text import checkpointed, release

#: Vectors that the codebook is fitted on; vectors of a block that are scored exactly.
SAMPLE_ROWS, RERANK, THRESHOLD = 10_000, 96, 0.2
#: Most vectors, and most bytes of them, in a block; bytes of queries that are sent to all tasks at once.
BLOCK_ROWS, BLOCK_BYTES, QUERY_BYTES = 8_192, 8 << 20, 8 << 20
#: Queries that are scanned together; tasks whose answers one task merges.
CHUNK, FAN = 64, 64
_ANSWERS = "part long, chunk long, asked binary, scores binary, counts binary, ids binary"


class Codebook:
    """16 centres for each pair of dimensions."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres  #: subspaces x 16 x 2; an even number of subspaces

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 7) -> Codebook:
        parts = _split(x)
        n, m, _ = parts.shape
        weight = _weight(x, threshold)
        chance = np.random.default_rng(seed)
        centres = parts[chance.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
        centres += 1e-6 * chance.standard_normal(centres.shape)
        book = cls(centres)
        code = book._nearest(parts)
        for _ in range(rounds):
            parallel = ((parts - book.decoded(code)) * parts).sum(2)
            total = parallel.sum(1)
            for s in range(m):
                p, rest = parts[:, s], total - parallel[:, s]
                aim = rest + (p**2).sum(1)
                for c in range(16):
                    own = code[:, s] == c
                    if own.any():
                        q, w = p[own], weight[own]
                        left = own.sum() * np.eye(2) + (q * w[:, None]).T @ q
                        centres[s, c] = np.linalg.solve(left, q.sum(0) + (q * (w * aim[own])[:, None]).sum(0))
                code[:, s] = cls._choose(p, rest, weight, centres[s])
                parallel[:, s] = ((p - centres[s][code[:, s]]) * p).sum(1)
                total = rest + parallel[:, s]
        return book

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((c**2).sum(1) - 2 * parts[:, s] @ c.T).argmin(1) for s, c in enumerate(self.centres)], 1)

    @staticmethod
    def _choose(p: np.ndarray, rest: np.ndarray, weight: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The centre of least score-aware error for each part, given the parallel error of the other parts."""
        along = p @ centres.T
        return ((centres**2).sum(1) - 2 * along + weight[:, None] * ((rest + (p**2).sum(1))[:, None] - along) ** 2).argmin(1)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(len(self.centres)), code]

    def encode(self, x: np.ndarray, rounds: int = 3, threshold: float = THRESHOLD) -> np.ndarray:
        """Two four-bit codes a byte."""
        parts, weight = _split(x), _weight(x, threshold)
        code = self._nearest(parts)
        parallel = ((parts - self.decoded(code)) * parts).sum(2)
        total = parallel.sum(1)
        for _ in range(rounds):
            for s, c in enumerate(self.centres):
                rest = total - parallel[:, s]
                code[:, s] = self._choose(parts[:, s], rest, weight, c)
                parallel[:, s] = ((parts[:, s] - c[code[:, s]]) * parts[:, s]).sum(1)
                total = rest + parallel[:, s]
        return (code[:, ::2] * 16 + code[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Code byte x 256 x query: what each value of each byte adds to each query's score."""
        part = np.einsum("qsd,scd->scq", _split(queries), self.centres).astype(np.float32)
        return (part[::2, :, None] + part[1::2, None, :]).reshape(len(part) // 2, 256, len(queries))

    @staticmethod
    def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Approximate inner products, codes x queries."""
        total = np.take(tables[0], codes[:, 0], axis=0)
        more = np.empty_like(total)
        for b in range(1, codes.shape[1]):
            np.take(tables[b], codes[:, b], axis=0, out=more, mode="clip")
            total += more
        return total


def _weight(x: np.ndarray, threshold: float) -> np.ndarray:
    """What a parallel error weighs beyond any other, by the squared length of its vector."""
    eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    return (eta - 1) / np.maximum((x**2).sum(1), 1e-30)


def _split(x: np.ndarray) -> np.ndarray:
    """Vectors as subspaces of two dimensions, an even number of them (zeros are added)."""
    more = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, 2)


def block_near(book: Codebook, codes: np.ndarray, x: np.ndarray, queries: np.ndarray, rerank: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """By query, the best ``keep`` of the block's ``rerank`` best rows by code, and their exact inner products."""
    guesses = np.ascontiguousarray(Codebook.scan(codes, book.tables(queries)).T)
    m = min(max(rerank, keep), len(codes))
    near = np.argpartition(guesses, len(codes) - m, axis=1)[:, len(codes) - m :]
    scores = np.einsum("qmd,qd->qm", x[near].astype(np.float64), queries)
    if m > keep:  # with all that tie with the last: which of them stays is decided by their ids
        least = np.partition(scores, m - keep, axis=1)[:, m - keep]
        most = max(keep, int((scores >= least[:, None]).sum(1).max()))
        order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        near, scores = np.take_along_axis(near, order, 1), np.take_along_axis(scores, order, 1)
    return near, scores


class Best:
    """The nodes of largest score of some queries so far: scores, and each node's ids, least first."""

    def __init__(self, keep: int):
        self.keep, self.scores, self.least, self.own = keep, None, None, None
        self.ids: list[np.ndarray] = []

    def add(self, scores: np.ndarray, which: np.ndarray, ids: list[np.ndarray]) -> None:
        """More nodes (queries x nodes): their scores, and their places in ``ids``."""
        least = np.array([i[0] for i in ids], np.int64)[which]
        which = which + len(self.ids)
        self.ids += ids
        if self.scores is not None:
            scores, least, which = (np.hstack(x) for x in ((self.scores, scores), (self.least, least), (self.own, which)))
        order = np.lexsort((least, -scores), axis=1)[:, : self.keep]
        self.scores, self.least, self.own = (np.take_along_axis(x, order, 1) for x in (scores, least, which))
        used, at = np.unique(self.own, return_inverse=True)  # the others' ids aren't needed any more
        self.ids, self.own = [self.ids[i] for i in used.tolist()], at.reshape(self.own.shape)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Scores, and the numbers of ids and the ids of each query's nodes."""
        flat = [self.ids[i] for i in self.own.reshape(-1).tolist()]
        return self.scores.tobytes(), np.array([len(i) for i in flat], np.int64).tobytes(), np.concatenate(flat).tobytes()

    @staticmethod
    def unpacked(asked: int, scores: bytes, counts: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """What :meth:`add` takes."""
        ends = np.cumsum(np.frombuffer(counts, np.int64))
        found = np.frombuffer(scores, np.float64).reshape(asked, -1)
        return found, np.arange(found.size).reshape(found.shape), np.split(np.frombuffer(ids, np.int64), ends[:-1])

    def lists(self) -> Iterator[tuple[list[int], list[float]]]:
        """Each query's ids and scores, best first; an id counts once."""
        for scores, own in zip(self.scores.tolist(), self.own.tolist(), strict=True):
            best: dict[int, float] = {}
            for score, i in zip(scores, own, strict=True):
                for each in self.ids[i].tolist():
                    best.setdefault(each, score)
            ranked = sorted((-score, i) for i, score in best.items())[: self.keep]
            yield [i for _, i in ranked], [-s for s, _ in ranked]


def usable(column: str) -> Column:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    c = F.col(column)
    return F.coalesce(c.isNotNull() & F.forall(c, fine) & F.exists(c, lambda v: v != 0), F.lit(False))


def search(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, fan: int = FAN,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row of ``is_query`` its nearest other rows."""
    spark = df.sparkSession
    kind = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).withColumn("n", F.size("v"))
    usual = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return df.select(*(F.lit(0).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), ("id", "long"), ("score", "double")))).limit(0)
    rows, dims = rows.where(F.col("n") == usual["n"]).drop("n"), usual["n"]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(batch)).astype(kind) + np.dtype(kind).type(0)  # -0.0 and 0.0 are one number
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)], ["id", "raw", "q"])
        release()

    rows = checkpointed(spark, rows.mapInArrow(raw, "id long, raw binary, q boolean"))
    first = Window.partitionBy("raw").orderBy("id")
    few = rows.select("id", "raw").distinct().withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= k + 1)
    nodes = checkpointed(spark, few.groupBy("raw").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")))
    n = nodes.count()
    share = int(min(1.0, sample_rows / n) * (1 << 20))
    sample = nodes.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 20)) < share).orderBy("node", "raw").select("raw").toArrow()
    if not sample.num_rows:
        sample = nodes.orderBy("node", "raw").limit(sample_rows).select("raw").toArrow()
    book = spark.sparkContext.broadcast(Codebook.fit(_vectors(sample.column("raw").to_pylist(), kind).astype(np.float64)))
    own_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    n_blocks = -(-n // own_rows)
    tasks = min(n_blocks, max(spark.sparkContext.defaultParallelism, n_blocks // 8))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), own_rows):
                raws, ids = batch.column(0).slice(at, own_rows).to_pylist(), batch.column(1).slice(at, own_rows)
                codes = book.value.encode(_vectors(raws, kind).astype(np.float64))
                counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                packed = [codes.tobytes(), b"".join(raws), counts.tobytes(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["codes", "raw", "counts", "ids"])
        release()

    dealt = nodes.select("raw", "ids").repartition(tasks, F.xxhash64("raw"))
    blocks = checkpointed(spark, dealt.mapInArrow(encode, "codes binary, raw binary, counts binary, ids binary"))

    def scanning(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, raws = shared.value
            queries = np.frombuffer(raws, kind).reshape(len(asked), -1).astype(np.float64)
            best = [Best(k + 1) for _ in range(0, len(asked), CHUNK)]
            for batch in batches:
                for codes, raw, counts, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    own = np.split(np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(counts, np.int64))[:-1])
                    codes, x = np.frombuffer(codes, np.uint8).reshape(len(own), -1), np.frombuffer(raw, kind).reshape(len(own), -1)
                    for chunk, held in enumerate(best):
                        near, scores = block_near(book.value, codes, x, queries[chunk * CHUNK : (chunk + 1) * CHUNK], rerank, k + 1)
                        used, which = np.unique(near, return_inverse=True)
                        held.add(scores, which.reshape(near.shape), [own[i] for i in used.tolist()])
            part = TaskContext.get().partitionId()
            for chunk, held in enumerate(best):
                if held.scores is not None:
                    yield _answer(part, chunk, asked[chunk * CHUNK : (chunk + 1) * CHUNK].tobytes(), held)
            release()

        return scan

    def merge(key, table):
        best = Best(k + 1)
        asked = table.column("asked")[0].as_py()
        for scores, counts, ids in zip(*(table.column(c).to_pylist() for c in ("scores", "counts", "ids")), strict=True):
            best.add(*Best.unpacked(len(asked) // 8, scores, counts, ids))
        return pa.Table.from_batches([_answer(key[0].as_py(), key[1].as_py(), asked, best)])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, scores, counts, ids in zip(*(batch.column(c).to_pylist() for c in ("asked", "scores", "counts", "ids")), strict=True):
                best = Best(k + 1)
                best.add(*Best.unpacked(len(asked) // 8, scores, counts, ids))
                ids, scores = zip(*best.lists(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["asked", "ids", "scores"])

    queries = rows.where("q").select(F.col("id").alias("query_id"), "raw").distinct()
    wanted = checkpointed(spark, queries.select("raw").distinct().withColumn("asked", F.monotonically_increasing_id()))
    groups = max(1, -(-wanted.count() // max(CHUNK, query_bytes // (8 * dims))))
    found = None
    for group in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("asked"), F.lit(groups)) == group).orderBy("asked").toArrow()
        shared = spark.sparkContext.broadcast((own.column("asked").to_numpy(), b"".join(own.column("raw").to_pylist())))
        answers, parts = blocks.mapInArrow(scanning(shared), _ANSWERS), blocks.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // fan)
            answers = answers.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part", "chunk").applyInArrow(merge, _ANSWERS)
        answers = answers.mapInArrow(listed, "asked long, ids array<long>, scores array<double>")
        if groups > 1:
            answers = checkpointed(spark, answers)
            shared.unpersist()
        found = answers if found is None else found.unionByName(answers)
    near = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    answered = queries.join(wanted, "raw").select("query_id", "asked").join(found, "asked")
    if queries.count() > queries.select("query_id").distinct().count():  # ids with several vectors: their answers are ranked together
        joined = answered.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "scores"))).alias("both"))
        pairs = joined.select("query_id", F.explode("both").alias("x")).groupBy("query_id", "x.ids").agg(F.max("x.scores").alias("scores"))
        each = F.array_sort(F.collect_list(F.struct((-F.col("scores")).alias("far"), "ids")))
        answered = pairs.groupBy("query_id").agg(each.alias("each")).select("query_id", F.col("each.ids").alias("ids"), F.transform("each.far", lambda x: -x).alias("scores"))
    ranked = answered.select("query_id", F.posexplode(F.slice(near, 1, k)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))


def _answer(part: int, chunk: int, asked: bytes, best: Best) -> pa.RecordBatch:
    scores, counts, ids = best.packed()
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, chunk, asked, scores, counts, ids), kinds, strict=True)], [c.split()[0] for c in _ANSWERS.split(", ")])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _vectors(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 1), kind)
