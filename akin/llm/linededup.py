"""Line dedup by pairwise alignment: common blocks are deleted from the later document.

Overlapping documents are found through hashes of line runs: from every line on, and back from
every line, the shortest run of lines that together have ``min_chars`` characters. Whatever two
documents can lose to each other holds such a run, and each of its lines lies in one, so
documents without a shared run need no alignment, and lines outside shared runs stay. Each
holder of a run is aligned with the run's first holder. Where lines of a shared run still stand,
the document is aligned with about ``rare`` more holders of the run, chosen by hash, then with
``rare`` times as many, until the lines go or every earlier holder was tried. The result is that
of all pairs. Each linked pair is aligned by
patience diff: lines that occur once on both sides and keep their order (longest increasing
subsequence) are anchors, and the stretches between are aligned in the same way. Runs of
aligned lines with at least ``min_chars`` characters are deleted from the document with the
larger id. Documents are judged as they came in, so what a line's first document holds stays.

Scale: what is shuffled are line hashes and, for linked pairs, both documents' hash lists;
texts meet their deletions by a broadcast of the deletions only if these are few (counted),
else by a shuffle. A pair's lists are bounded by the documents' own lines. Copies of a list of
lines are judged without alignment, and only the first one is a holder. A run's holders are
never ranked or gathered: which of them are tried next follows from a hash and their number, so
a frequent run needs only sums and joins, whose partitions Spark splits. Pairs beyond those with
first holders are made only for lines that stand, so only lines that many documents share and
that align with none of them (repeated inside each, say) cost pairs of all their holders.

Cases: lines are split at line feeds and compared without white space (of Unicode) at their
ends; blank lines never match and never go. A null or empty text is unchanged. Rows that share
an id are not compared with each other; each row loses its own lines. Copies of a text lose all
but their blank and short lines, except for the smallest id. Other columns are kept as they are.
Lines and runs are compared by hashes of 64 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .graphs import BROADCAST_ROWS, sized
from .text import checkpointed, mix, powers, release

RARE, MIN_CHARS = 8, 25
#: What Unicode counts as white space, but for the line feed.
BLANKS = " \t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two lists, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        left, right = Counter(a[i:i_end]), Counter(b[j:j_end])
        once = {x: at for at, x in enumerate(a[i:i_end], i) if left[x] == 1 and right.get(x) == 1}
        pairs = [(once[x], at) for at, x in enumerate(b[j:j_end], j) if x in once]
        anchors = _increasing(pairs)
        if not anchors:
            continue
        out += anchors
        borders = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(borders, borders[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (ascending in the second) that also ascends in the first, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for at, (first, _) in enumerate(pairs):
        pile = bisect_left(tops, first)
        before[at] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(first)
            piles.append(at)
        else:
            tops[pile], piles[pile] = first, at
    at, out = (piles[-1] if piles else -1), []
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def common_blocks(a: list, b: list, sizes: list[int], min_chars: int) -> list[int]:
    """Positions in ``b`` of the aligned blocks of at least ``min_chars`` characters."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-1, -1)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if block and sum(sizes[x] for x in block) >= min_chars:
                gone += block
            block = []
        block.append(j)
        last = i, j
    return gone


def runs_of(h: np.ndarray, n: np.ndarray, first: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest runs of lines with ``min_chars`` characters, from and back from each line.

    ``first``: index of each document's first line; one more entry than documents.
    """
    total = np.r_[0, np.cumsum(n, dtype=np.int64)]
    line = np.arange(len(n))
    border = np.repeat(first[1:], np.diff(first))
    end = np.searchsorted(total, total[:-1] + max(min_chars, 1))
    on = end <= border
    opening = np.repeat(first[:-1], np.diff(first))
    start = np.searchsorted(total, total[1:] - max(min_chars, 1), "right") - 1
    back = start >= opening
    both = np.unique(np.r_[line[on] * (len(n) + 1) + end[on], start[back] * (len(n) + 1) + line[back] + 1])
    start, end = both // (len(n) + 1), both % (len(n) + 1)
    power, inverse = powers(len(n) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(mix(h.view(np.uint64)) * power[:-1], dtype=np.uint64)]
    return start, end, mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, mark, lines)``: line numbers to delete from the row with this id and text hash."""
    spark = df.sparkSession
    pieces = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    line = F.transform(pieces, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i"), F.length(x).alias("n")))
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.filter(line, lambda x: x["n"] > 0).alias("line"))
    docs = docs.select("id", "mark", F.col("line.h").alias("h"), F.col("line.i").alias("i"), F.col("line.n").alias("n"))
    docs = docs.where(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y) >= min_chars)  # the others hold no run
    docs = checkpointed(spark, docs.where(F.size("h") > 0).withColumn("whole", F.xxhash64("h")))
    leads = docs.groupBy("whole").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("whole", "lead")
    known = docs.join(sized(checkpointed(spark, leads)), "whole", "left")
    copies = known.where("lead < id").select("id", "mark", F.col("i").alias("lines"))
    docs = checkpointed(spark, known.where("lead is null or lead = id").select("id", "mark", "h", "i", "n"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, i, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h", "i", "n"))
            first = np.r_[0, np.cumsum(batch.column("h").value_lengths().to_numpy())]
            start, end, key = runs_of(h, n, first, min_chars)
            doc = pa.array(np.searchsorted(first, start, "right") - 1)
            size = end - start
            own = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            own = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(i[own], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(doc), batch.column("mark").take(doc), pa.array(key.view(np.int64)), own], ["id", "mark", "key", "own"])
        release()

    runs = docs.select("id", "mark", "h", "i", "n").mapInArrow(find, "id long, mark long, key long, own array<int>")
    shared = runs.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    shared = checkpointed(spark, shared)  # else the join below would follow the sums' partitions, which Spark doesn't split
    # A holder's place among a run's holders in an order by hash, but for chance; places are from 0 to their number.
    place = F.pmod(F.xxhash64("key", "id"), F.lit(1 << 32)) * F.col("n") / F.lit(float(1 << 32))
    held = checkpointed(spark, runs.join(shared, "key").withColumn("place", place))
    holders = held.select("key", F.col("id").alias("a"), "place").distinct()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, gone = [], [], []
            lists = zip(*(_lists(batch.column(c)) for c in ("x", "h", "i", "n")), strict=True)
            for k, (x, h, i, n) in enumerate(lists):
                found = common_blocks(x.tolist(), h.tolist(), n.tolist(), min_chars)
                if found:
                    ids.append(batch.column(0)[k].as_py())
                    marks.append(batch.column(1)[k].as_py())
                    gone.append(i[found].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["id", "mark", "lines"])
        release()

    def aligned(pairs: DataFrame) -> DataFrame:
        later = pairs.join(docs.withColumnRenamed("id", "b"), "b")
        both = later.join(docs.select(F.col("id").alias("a"), F.col("h").alias("x")), "a").select("b", "mark", "h", "i", "n", "x")
        return _merged(both.mapInArrow(align, "id long, mark long, lines array<int>"))

    later = held.where("id > first")
    gone = checkpointed(spark, aligned(later.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()))
    standing = later.where("n > 2").select("id", "mark", "key", "own", "first", "n")
    tried, more, latest = 0, max(rare, 2), gone
    found = [copies, gone]
    while True:
        standing = standing.where(F.col("n") > tried).join(latest, ["id", "mark"], "left")
        standing = standing.withColumn("own", F.when(F.col("lines").isNull(), F.col("own")).otherwise(F.array_except("own", "lines"))).where(F.size("own") > 0).drop("lines")
        standing = checkpointed(spark, standing)
        if standing.isEmpty():
            break
        wanted = standing.select("key", F.col("id").alias("b"), "first").distinct()
        near = holders.where((F.col("place") >= tried) & (F.col("place") < tried + more))
        pairs = wanted.join(near, "key").where("a < b and a <> first").select("a", "b").distinct()
        latest = checkpointed(spark, aligned(pairs))
        found.append(latest)
        tried, more = tried + more, more * max(rare, 2)
    return _merged(reduce(DataFrame.union, found))


def _merged(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, lines in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if text is not None and lines:
            drop = set(lines)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
        out.append(text)
    found = pa.array(out, pa.string())
    del out
    release()
    return found


_without = _without.asNondeterministic()  # else a filter on the new text would have it made twice


def remove_common_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_chars: int = MIN_CHARS, into: str = "removed_lines") -> DataFrame:
    """The rows with shortened texts, and ``into``: how many lines each lost."""
    gone = checkpointed(df.sparkSession, deletions(df, id_col, text_col, rare, min_chars))
    own = [f"_{name}" * (1 + max(map(len, df.columns)) // 5) for name in ("owner", "mark", "lines")]  # longer than any column's name
    gone = gone.toDF(*own)
    n = gone.agg(F.coalesce(F.sum(F.size(own[2]) + 1), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if n <= BROADCAST_ROWS else gone
    met = df.join(gone, (F.col(id_col).cast("long") == gone[own[0]]) & (F.xxhash64(text_col) == gone[own[1]]), "left")
    met = met.withColumn(text_col, _without(F.col(text_col), F.col(own[2])))
    return met.select(*df.columns, F.coalesce(F.size(own[2]), F.lit(0)).alias(into))
