"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the weighted set of its shingles of five words (lower case, letters and digits),
a shingle weighing its count. Each unit of weight owns a stream of hashed darts with rising
ranks; a text throws those darts that land below a rank bound set by its total weight, about
``k ln k + 2k`` of them whatever its length, and each of the ``k`` coordinates keeps its
earliest dart. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. Bands of coordinates are joined; every candidate is verified exactly.

Scale: texts with the same words are one node (a digest of 16 bytes), so a group of copies of
any size is a single row before banding. In each band bucket the members are first compared
with one of them, then those outside the bucket's largest component with one member of it: a
linear number of pairs. Of buckets that then still hold several components, texts are left out
that can't be alike any other: of each the rarest fifth of its cells (by their number of texts)
would meet every text that is alike, so texts with much of their own drop out, however large their
bucket. What is left of a bucket is compared in full, block against block, by matrix products of which only
links that join components come out (a bucket's blocks travel once; Spark splits a large bucket's join). That is exact, and
the one step whose work can grow with the square of a group: of many texts nearly alike enough.
Rows of a key are dealt out by ``SALT_ROWS``, so no task gets a whole large bucket. Shingle profiles are
made for candidates only. Components are found by Spark (large-star and small-star); neither
links nor components come to the driver. Keys of candidates have 64 bits; links, which are
verified, name digests.

Cases: a text of one to four words is one shingle. Texts without a word are in one class if
they are equal; a null text is a class of its own. Rows that share an id fall in one class and
give one row, whatever their order; :func:`later_copies` judges them by their texts instead.
Rows without an id have no class, but as copies they can go. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components, sized
from .text import ALNUM_HIGH, chunks, mix, release, rolling, settled, starts_inside, words_of

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Rounds that try members against one member of their bucket's largest component; rows of a key that stay together; text bytes signed at once.
HUB_ROUNDS, SALT_ROWS, CHUNK = 1, 256, 1 << 20
#: Most members, and most bytes of their cells, in a block that is compared with another.
BLOCK, BLOCK_BYTES = 256, 2 << 20
_LOW48 = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cells_of(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Units of weight: ``(text, 48-bit cell)`` sorted, each text's first cell, and the words.

    The n-th occurrence of a shingle is a cell of its own, so weighted Jaccard similarity of
    texts is plain Jaccard similarity of their cells.
    """
    words = words_of(texts, ALNUM_HIGH, lower=True)
    lengths = np.diff(words.first)
    start = np.flatnonzero(starts_inside(words, shingle))
    values, owner = rolling(words.hash, shingle)[start] if len(start) else np.zeros(0, np.uint64), words.doc[start]
    for k in range(1, shingle):  # shorter texts are one shingle
        few = np.flatnonzero(lengths == k)
        if len(few):
            at = words.first[few]
            values, owner = np.r_[values, rolling(words.hash, k)[at]], np.r_[owner, few]
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    turn = (np.arange(len(key)) - np.repeat(at, np.diff(np.r_[at, len(key)]))).astype(np.uint64)
    doc = (key >> np.uint64(48)).astype(np.int64)
    cell = np.where(turn == 0, key & _LOW48, mix((key & _LOW48) + turn * _STEP) & _LOW48)
    return doc, cell, np.searchsorted(doc, np.arange(len(texts) + 1)), words


def darts(doc: np.ndarray, cell: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Signatures (texts x k): each coordinate's earliest dart, as rank and dart packed in 64 bits."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(weight), k), none)
    bound = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = np.ones(len(doc), bool)
    while todo.any():
        own, base = doc[todo], mix(cell[todo] + np.uint64(1))
        rank, turn = np.zeros(len(own)), 0
        while len(own):
            turn += 1
            seed = mix(base + np.uint64(turn * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank <= bound[own]
            own, base, rank, seed = own[hit], base[hit], rank[hit], mix(seed[hit] + _STEP)
            dart = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (seed >> np.uint64(32))
            np.minimum.at(out.reshape(-1), own * k + (seed & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, dart)
        short = (out == none).any(1) & (weight > 0)  # a coordinate without a dart: look twice as far
        bound = np.where(short, 2 * bound, bound)
        todo = short[doc]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, part.shape[:2])
    for i in range(rows):
        key = mix(key + part[:, :, i])
    return key


def _digests(texts: list[bytes], words) -> list[bytes]:
    """What two texts share if they have the same words; of texts without a word, if they are equal."""
    bounds = zip(words.first[:-1].tolist(), words.first[1:].tolist(), texts, strict=True)
    return [hashlib.blake2b(words.hash[a:b].tobytes() if b > a else b"\0" + text, digest_size=16).digest() for a, b, text in bounds]


def _signing(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in chunks(batches, CHUNK):
            doc, cell, first, words = cells_of(texts, shingle)
            keys = band_keys(darts(doc, cell, np.diff(first), bands * rows), bands, rows).view(np.int64)
            some = np.diff(first) > 0
            digests = pa.array(_digests(texts, words), pa.binary(), mask=~part.column(1).is_valid().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.r_[0, np.cumsum(np.where(some, bands, 0))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), digests, pa.ListArray.from_arrays(offsets, pa.array(keys[some].reshape(-1)))], ["id", "mark", "digest", "keys"]
            )

    return run


def _profiles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in chunks(batches, CHUNK):
            _, cell, first, words = cells_of(texts, shingle)
            raw = cell.view(np.uint8).reshape(-1, 8)[:, :6]
            cells = [raw[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_digests(texts, words), pa.binary()), pa.array(cells, pa.binary())], ["digest", "cells"])

    return run


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def similarity_of(left: bytes, right: bytes) -> float:
    a, b = _wide(left), _wide(right)
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _verifying(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([similarity_of(a, b) >= threshold for a, b in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)
        release()

    return run


def _opening(threshold: float):
    """The rarest cells of each text, as many that two texts alike enough share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, cells = [], []
            for node, raw, frequent, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = _wide(raw)
                times = np.ones(len(own), np.int64)
                if frequent:
                    order = np.argsort(known := np.array(frequent, np.uint64))
                    at = np.minimum(np.searchsorted(known[order], own), len(known) - 1)
                    times = np.where(known[order][at] == own, np.array(counts, np.int64)[order][at], 1)
                first = np.lexsort((own, times))[: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]
                first = first[times[first] > 1]  # a cell that no other text has joins nothing
                nodes.append(np.full(len(first), node, np.int64))
                cells.append(own[first])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(cells).view(np.int64))], ["d", "cell"])
        release()

    return run


def _linking(threshold: float):
    """Links that join different components of two blocks of members, at most one for each component joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (nodes, roots, left), (others, tops, right) = _members(batch.column(0)[k].values), _members(batch.column(1)[k].values)
                common = _common(left, right)
                n, m = np.array([len(c) for c in left]), np.array([len(c) for c in right])
                alike = common >= threshold * (n[:, None] + m[None] - common) - 1e-9
                over: dict[int, int] = {}

                def top(x: int, over=over) -> int:
                    while over.get(x, x) != x:
                        x = over[x]
                    return x

                found = []
                for i, j in np.argwhere(alike & (roots[:, None] != tops[None])).tolist():
                    a, b = top(int(roots[i])), top(int(tops[j]))
                    if a != b and common[i, j] / max(1, n[i] + m[j] - common[i, j]) >= threshold:
                        over[max(a, b)] = min(a, b)
                        found.append((int(nodes[i]), int(others[j])))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    return run


def _members(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return block.field("d").to_numpy(), block.field("root").to_numpy(), [_wide(c) for c in block.field("cells").to_pylist()]


def _common(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Cells that each left member shares with each right one; a slab of the cells on both sides at a time."""
    ours, theirs = np.concatenate(left), np.concatenate(right)
    cells = np.intersect1d(ours, theirs)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(cells):
        return out
    sides = []
    for parts, every in ((left, ours), (right, theirs)):
        member = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
        at = np.minimum(np.searchsorted(cells, every), len(cells) - 1)
        held = cells[at] == every
        order = np.argsort(at[held], kind="stable")
        sides.append((member[held][order], at[held][order]))
    for low in range(0, len(cells), slab):
        grids = []
        for parts, (member, at) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(at, [low, low + slab])
            grid = np.zeros((len(parts), slab), np.float32)
            grid[member[a:b], at[a:b] - low] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_wide(raw) for raw in batch.column(1).to_pylist()]
        if parts:
            owner = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(parts).view(np.int64))], ["d", "cell"])


def _spread(side: DataFrame) -> DataFrame:
    """Each key's row once for every salt of its ``n`` members."""
    salts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SALT_ROWS) - 1)
    return side.withColumn("salt", F.explode(salts))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(key, salt, n, d, root, hub)`` of the buckets that hold several components; hub is the one with most members."""
    of = roots.select(F.xxhash64("node").alias("d"), F.xxhash64("root").alias("root")).dropDuplicates(["d"])
    placed = members.join(of, "d", "left").select("key", "salt", "n", "d", F.coalesce("root", "d").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"), F.first("n").alias("n"))
    hubs = parts.groupBy("key").agg(F.max(F.struct("own", "root")).alias("hub"), F.count(F.lit(1)).alias("parts"), F.first("n").alias("n")).where("parts > 1")
    return placed.join(_spread(hubs.select("key", "n", "hub.root")).select("key", "salt", F.col("root").alias("hub")), ["key", "salt"])


def _meeting(rest: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """``d`` of the texts that share one of their rarest cells with a text of another component; no others can be alike enough."""
    spark = rest.sparkSession
    held = settled(spark, rest.select("d", "root").distinct().join(profiles, "d").select("d", "root", "cells"))
    cells = held.select("d", "cells").mapInArrow(_cells, "d long, cell long")
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    known = cells.join(counted, "cell").groupBy("d").agg(F.collect_list("cell").alias("frequent"), F.collect_list("texts").alias("counts"))
    first = held.join(known, "d").select("d", "cells", "frequent", "counts").mapInArrow(_opening(threshold), "d long, cell long")
    first = settled(spark, first.join(held.select("d", "root"), "d"))
    several = first.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    return settled(spark, first.join(several, "cell").select("d").distinct())


def _across(rest: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` that join all components of each key's members ``(key, salt, n, d, root)`` which any alike pair joins: block against block."""
    spark = rest.sparkSession
    sizes = profiles.select("d", F.length("cells").alias("size"))
    near = settled(spark, rest.join(sized(_meeting(rest, profiles, threshold)), "d").join(sizes, "d").select("key", "salt", "n", "d", "root", "size"))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES))
    counted = near.groupBy("key").agg(size.alias("blocks"), F.first("n").alias("n"))
    parts = near.join(_spread(counted).select("key", "salt", "blocks"), ["key", "salt"]).withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")))
    parts = parts.join(profiles.select("d", "cells"), "d").groupBy("key", "block").agg(F.collect_list(F.struct("d", "root", "cells")).alias("members"))
    parts = settled(spark, parts)
    left, right = (parts.select("key", F.col("block").alias(i), F.col("members").alias(side)) for i, side in (("i", "left"), ("j", "right")))
    return left.join(right, "key").where("i <= j").select("left", "right").mapInArrow(_linking(threshold), "a long, b long").distinct()


def _linked(docs: DataFrame, shingle: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows ``(id, mark, digest)``, digests with their first row (``first``: none, id, mark), and components ``(node, root)`` of linked digests."""
    spark = docs.sparkSession
    signed = settled(spark, docs.mapInArrow(_signing(shingle, bands, rows), "id long, mark long, digest binary, keys array<long>"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min(own).alias("first"), F.first("keys").alias("keys"))
    nodes = settled(spark, nodes.withColumn("d", F.xxhash64("digest")))
    members = nodes.select("d", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("d").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settled(spark, members.join(buckets, "key").select("key", "d", "lead", "n"))
    pairs = settled(spark, shared.where("d <> lead").select(F.col("lead").alias("a"), F.col("d").alias("b")).distinct())
    wanted = settled(spark, nodes.join(pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct(), "d").select("first.id", "first.mark"))
    wanted = sized(wanted)
    held = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["mark"] == wanted["mark"]), "left_semi")
    profiles = held.mapInArrow(_profiles(shingle), "digest binary, cells binary").dropDuplicates(["digest"])
    profiles = settled(spark, profiles.withColumn("d", F.xxhash64("digest")))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (profiles.select(F.col("d").alias(x), F.col("digest").alias(f"{x}_node"), F.col("cells").alias(f"{x}_cells")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a").where("a_node <> b_node").select("a_node", "b_node", "a_cells", "b_cells")
        return settled(spark, both.mapInArrow(_verifying(threshold), "a binary, b binary"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        return settled(spark, components(spark, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(links)))

    roots = settled(spark, components(spark, verified(pairs)))
    several = shared.where("n > 2").select("key", "d", "n", F.pmod(F.xxhash64("d"), F.ceil(F.col("n") / SALT_ROWS)).alias("salt"))
    for turn in range(HUB_ROUNDS):
        mixed = settled(spark, _mixed(several, roots))
        hubs = mixed.where("root = hub").groupBy("key").agg(F.min(F.struct(F.xxhash64("d", F.lit(turn)), "d"))["d"].alias("a"), F.first("n").alias("n"))
        tries = mixed.where("root <> hub").join(_spread(hubs).select("key", "salt", "a"), ["key", "salt"]).select(F.least("a", "d").alias("a"), F.greatest("a", "d").alias("b"))
        more = verified(settled(spark, tries.distinct()))
        if more.isEmpty():
            break
        roots = joined(roots, more)
    rest = settled(spark, _mixed(several, roots).select("key", "salt", "n", "d", "root"))
    if not rest.isEmpty():
        more = verified(settled(spark, _across(rest, profiles, threshold)))
        if not more.isEmpty():
            roots = joined(roots, more)
    return signed.drop("keys"), nodes.select("digest", "first"), roots


def _judged(df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """``(id, mark, first)`` of every row: ``first`` is the first row (none, id, mark) of its class, null where the text is."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    signed, nodes, roots = _linked(docs, shingle, threshold, bands, rows)
    placed = roots.join(nodes.withColumnRenamed("digest", "node"), "node")
    leads = settled(df.sparkSession, placed.groupBy("root").agg(F.min("first").alias("lead")))
    lead = roots.join(sized(leads), "root").select(F.col("node").alias("digest"), "lead")
    found = nodes.join(lead, "digest", "left").select("digest", F.coalesce("lead", "first").alias("first"))
    return signed.join(found, "digest", "left").select("id", "mark", "first")


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(id, class_id)``, one row an id; class_id is the smallest id of its class of near copies."""
    spark = df.sparkSession
    judged = settled(spark, _judged(df, id_col, text_col, shingle, threshold, bands, rows).where("id is not null").select("id", F.col("first.id").alias("own")))
    found = settled(spark, judged.groupBy("id").agg(F.min("own").alias("own"), F.max("own").alias("last")))
    several = found.where("own < last").select("id")
    if several.isEmpty():
        return found.select(F.col("id").alias(id_col), F.coalesce("own", "id").alias("class_id"))
    # The texts of an id belong together: the classes that it joins are one.
    edges = judged.where("own is not null").join(several, "id").select(F.col("id").alias("a"), F.col("own").alias("b"))
    roots = settled(spark, components(spark, edges.union(several.select("id", "id").toDF("a", "b")).distinct()))
    found = found.withColumn("node", F.coalesce("own", "id")).join(roots, "node", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("root", "node").alias("class_id"))


def later_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(id, mark)`` of the rows that aren't their class's first: the smallest id, then the smallest ``mark`` (``xxhash64`` of the text).

    Rows are judged by their texts: different texts under one id don't stand for each other. Rows
    that repeat id and text are all first, or none of them is.
    """
    judged = _judged(df, id_col, text_col, shingle, threshold, bands, rows).where("first is not null")
    return judged.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))).select("id", "mark").distinct()
