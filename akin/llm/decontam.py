"""Benchmark decontamination by winnowing.

An item's windows of ``span`` words are what must not occur in a document. Both sides are
fingerprinted by winnowing: of each ``span - gram + 1`` neighbouring ``gram``-word hashes the
smallest is kept, so any shared run of ``span`` words shares a kept hash (the guarantee).
Joined fingerprints are hits, which are extended over the neighbouring windows by comparing
two independent 64-bit hashes of each window. Items shorter than ``span`` are one window of
their own length, each such length being looked up by its own hashes.

Scale: documents are read once and never shuffled while the benchmark's fingerprints fit
``max_entries`` (counted first). The windows of a larger benchmark stay in Spark: documents are
read once for the windows around their fingerprints that a bitmap of the benchmark's lets
through (16 bits an entry, 32 MB at most), these windows are joined with the benchmark's by a
shuffle, and the hits meet their rows by id and text hash.

Cases: null or empty texts and items have no words. Repeated rows are judged one by one, also
where they share an id; items that share an id count once. Further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import sized
from .text import ALNUM_HIGH, checkpointed, chunks, covered, release, rolling, runs, starts_inside, words_of

SPAN, GRAM, MAX_ENTRIES = 8, 4, 2_000_000
#: Bits of a bitmap of a large benchmark's hashes, by entry and at most.
SIEVE_BITS, MOST_BITS = 16, 1 << 28
_FIELDS = "n_words long, hits array<struct<start:long,end:long>>, items array<{kind}>, whole_items long"


def winnow(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest value of each run of ``width`` values (the rightmost of equals), each once."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    low = values[:n].copy()
    for step in range(1, width):
        other = values[step : step + n]
        take = other <= low
        low = np.where(take, other, low)
        best = np.where(take, np.arange(n) + step, best)
    return best[np.r_[True, best[1:] != best[:-1]]]  # the smallest value's place never moves back


class Index:
    """Fingerprints and windows of some items."""

    def __init__(self, ids: list, texts: list[bytes], span: int, gram: int):
        self.span, self.gram = span, gram
        words = words_of(texts, ALNUM_HIGH, lower=True)
        lengths = np.diff(words.first)
        self.items = ids
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(int(n), span) for n in lengths if n}):
            start = np.flatnonzero(starts_inside(words, k))
            item = words.doc[start]
            own = (lengths[item] == k) | (k == span)
            start, item = start[own], item[own]
            first, second = rolling(words.hash, k, 1)[start], rolling(words.hash, k, 0)[start]
            order = np.argsort(first, kind="stable")
            self.windows[k] = first[order], second[order], item[order]
        self.prints = np.zeros(0, np.uint64)
        if span in self.windows:
            grams, whole = rolling(words.hash, gram), starts_inside(words, gram)
            kept = [
                at + winnow(grams[at:end], span - gram + 1)
                for at, end in zip(words.first[:-1], words.first[1:] - gram + 1, strict=True)
                if end - at >= span - gram + 1
            ]
            found = np.concatenate(kept)
            assert whole[found].all()
            self.prints = np.unique(grams[found])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.prints >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(first word, window length, item)`` of every occurrence of a window in the texts."""
        out = []
        for k, (first, second, item) in self.windows.items():
            if k == self.span:
                start = self._hit_by_prints(words)
            else:
                start = np.flatnonzero(starts_inside(words, k))
            if not len(start):
                continue
            a, b = self._hashes(words, start, k)
            left, right = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
            n = right - left
            entry = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            same = second[entry] == np.repeat(b, n)
            out.append((np.repeat(start, n)[same], np.full(int(same.sum()), k), item[entry[same]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    @staticmethod
    def _hashes(words, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(start) * k > len(words):
            return rolling(words.hash, k, 1)[start], rolling(words.hash, k, 0)[start]
        part = words.hash[start[:, None] + np.arange(k)].reshape(-1)
        return rolling(part, k, 1)[::k], rolling(part, k, 0)[::k]

    def _hit_by_prints(self, words) -> np.ndarray:
        """Starts of the windows around the kept grams that are fingerprints of an item as well."""
        grams = rolling(words.hash, self.gram)
        at = winnow(grams, self.span - self.gram + 1)  # over text borders too, which only adds fingerprints
        at = at[self.sieve[(grams[at] >> np.uint64(48)).astype(np.int64)]]
        return _around(words, at[np.isin(grams[at], self.prints)], self.span, self.gram)


def _around(words, at: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a gram at ``at``: as a window's smallest gram is kept on both sides, all that match are among them."""
    start = np.unique((at[:, None] - np.arange(span - gram + 1)).reshape(-1))
    start = start[(start >= 0) & (start + span <= len(words))]
    return start[words.doc[start] == words.doc[start + span - 1]]


class Sieve:
    """Bitmaps of a benchmark's fingerprints and window hashes; what they let through need not be there."""

    def __init__(self, lengths: list[int], span: int, gram: int, bits: int):
        self.lengths, self.span, self.gram = lengths, span, gram
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.maps = {which: np.zeros(max(1, bits // 8), np.uint8) for which in ("prints", "windows")}

    def add(self, which: str, hashes: np.ndarray) -> None:
        at = np.unique(hashes >> self.shift)
        np.bitwise_or.at(self.maps[which], (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def held(self, which: str, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.maps[which][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def windows(self, words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(length, starts, hashes, second hashes)`` of the windows that may be the benchmark's."""
        for k in self.lengths:
            if k == self.span:
                grams = rolling(words.hash, self.gram)
                at = winnow(grams, self.span - self.gram + 1)
                start = _around(words, at[self.held("prints", grams[at])], self.span, self.gram)
            else:
                start = np.flatnonzero(starts_inside(words, k))
            if len(start):
                a, b = Index._hashes(words, start, k)
                own = self.held("windows", a)
                yield k, start[own], a[own], b[own]


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, gram: int = GRAM, max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """``(id, n_words, hits, items, whole_items)`` of every document.

    ``hits``: maximal intervals of words inside an occurring window. ``items``: ids with an
    occurring window. ``whole_items``: how many of them have an occurring window of ``span`` words.
    """
    if not 1 <= gram <= span:
        raise ValueError("gram must be from 1 to span")
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = _FIELDS.format(kind=item_kind)
    words = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 2  # a word takes two bytes or more
    entries = int(items.agg(words).first()[0])
    if entries > max_entries:
        return _joined(source, items, kind, item_kind, span, gram, entries).withColumnRenamed("id", id_col)
    rows = sorted(items.collect(), key=lambda r: str(r["item"]))  # at most max_entries words
    index = Index([r["item"] for r in rows], [(r["text"] or "").encode() for r in rows], span, gram)
    return source.mapInArrow(_scanner(spark.sparkContext.broadcast(index), item_kind), f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def _joined(source: DataFrame, items: DataFrame, kind: str, item_kind: str, span: int, gram: int, entries: int) -> DataFrame:
    """The scan by a shuffle: documents' windows that a bitmap lets through, joined with the benchmark's windows."""
    spark = source.sparkSession

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in chunks(batches):
            index = Index(list(range(len(texts))), texts, span, gram)
            for k, (first, second, item) in index.windows.items():
                columns = [pa.array(np.full(len(item), k)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), part.column(0).take(pa.array(item))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "first", "second", "item"])
            none = pa.nulls(len(index.prints), part.column(0).type)  # fingerprints: of length 0
            zero = pa.array(np.zeros(len(index.prints), np.int64))
            yield pa.RecordBatch.from_arrays([zero, pa.array(index.prints.view(np.int64)), zero, none], ["k", "first", "second", "item"])

    listed = items.mapInArrow(list_windows, f"k long, first long, second long, item {item_kind}")
    listed = checkpointed(spark, listed.distinct())
    lengths = sorted(r.k for r in listed.select("k").distinct().collect() if r.k)
    bits = 1 << max(16, min(MOST_BITS, SIEVE_BITS * entries).bit_length() - 1)

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sieve(lengths, span, gram, bits)
        for batch in batches:
            k, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            own.add("prints", hashes[k == 0])
            own.add("windows", hashes[k > 0])
        packed = [zstandard.compress(own.maps[which].tobytes()) for which in ("prints", "windows")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["prints", "windows"])

    sieve = Sieve(lengths, span, gram, bits)
    for row in listed.select("k", "first").mapInArrow(sieved, "prints binary, windows binary").toLocalIterator():  # a partition at a time
        for which in ("prints", "windows"):
            sieve.maps[which] |= np.frombuffer(zstandard.decompress(bytes(row[which])), np.uint8)
    shared = spark.sparkContext.broadcast(sieve)
    marked = source.withColumn("mark", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in chunks(batches):
            words = words_of(texts, ALNUM_HIGH, lower=True)
            for k, start, a, b in shared.value.windows(words):
                doc = words.doc[start]
                take = pa.array(doc)
                columns = [part.column(0).take(take), part.column(2).take(take), pa.array(np.full(len(doc), k)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(start - words.first[doc])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "k", "first", "second", "start"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in chunks(batches):
            n = np.diff(words_of(texts, ALNUM_HIGH, lower=True).first)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["id", "mark", "n_words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans = [_merge([(x["start"], x["end"]) for x in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(interval)), batch.column(3), batch.column(4)], ["id", "mark", "hits", "items", "whole_items"])
        release()

    seen = marked.mapInArrow(find, f"id {kind}, mark long, k long, first long, second long, start long").distinct()
    met = checkpointed(spark, seen.join(listed.where("k > 0"), ["k", "first", "second"]).select("id", "mark", "k", "start", "item"))
    spans = met.select("id", "mark", "start", (F.col("start") + F.col("k")).alias("end")).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    held = met.groupBy("id", "mark", "item").agg(F.max("k").alias("k")).groupBy("id", "mark").agg(F.collect_list("item").alias("items"), F.sum((F.col("k") == span).cast("long")).alias("whole_items"))
    both = spans.alias("s").join(held.alias("h"), F.col("s.id").eqNullSafe(F.col("h.id")) & F.col("s.mark").eqNullSafe(F.col("h.mark"))).select("s.id", "s.mark", "hits", "items", "whole_items")
    found = both.mapInArrow(merge, f"id {kind}, mark long, hits array<struct<start:bigint,end:bigint>>, items array<{item_kind}>, whole_items long")
    found = sized(checkpointed(spark, found.toDF("own", "text_mark", "hits", "items", "whole_items")))
    counted = marked.mapInArrow(count, f"id {kind}, mark long, n_words long")
    together = counted.join(found, counted["id"].eqNullSafe(found["own"]) & counted["mark"].eqNullSafe(found["text_mark"]), "left")
    nothing = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return together.select("id", "n_words", nothing("hits").alias("hits"), F.array_sort(nothing("items")).alias("items"), F.coalesce("whole_items", F.lit(0)).alias("whole_items"))


def _scanner(shared, item_kind: str):
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for _, texts, part in chunks(batches):
            words = words_of(texts, ALNUM_HIGH, lower=True)
            lengths = np.diff(words.first)
            spans, found, whole = defaultdict(list), defaultdict(set), defaultdict(set)
            start, k, item = index.hits(words)
            for size in np.unique(k):
                own = k == size
                for a, b in zip(*runs(covered(len(words), start[own], int(size))), strict=True):
                    # a run may cross into the next text only where both texts are hit up to their border
                    for d in range(words.doc[a], words.doc[b - 1] + 1):
                        spans[d].append((max(a, words.first[d]) - words.first[d], min(b, words.first[d + 1]) - words.first[d]))
            for d, i, size in set(zip(words.doc[start].tolist(), item.tolist(), k.tolist(), strict=True)):
                found[d].add(index.items[i])
                if size == index.span:
                    whole[d].add(index.items[i])
            n = len(texts)
            hits = [_merge(spans[d]) if d in spans else [] for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(lengths, pa.int64()), pa.array(hits, pa.list_(interval)),
                    pa.array([sorted(found[d], key=str) if d in found else [] for d in range(n)], pa.list_(_arrow(item_kind))),
                    pa.array([len(whole[d]) if d in whole else 0 for d in range(n)], pa.int64()),
                ],
                ["id", "n_words", "hits", "items", "whole_items"],
            )

    return run


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": int(a), "end": int(b)} for a, b in out]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
