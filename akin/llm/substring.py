"""Exact substring dedup: remove words covered by a window that starts in an earlier document.

Every window of ``k`` consecutive words of one document gets a Rabin-Karp hash. The
windows are dealt out by hash and counted there; a window whose hash also occurs in a
document with a smaller id is repeated, and repeated windows merge into maximal removal
intervals.

Scale: windows travel as packed columns (7 hash bytes below the bucket's bits, about one
byte of position), not as rows. Each map task settles repeats inside its own chunk first,
so a passage that a third of all rows share sends one entry a chunk, not one a document.
Texts travel once, compressed, to meet their intervals. The numbers of buckets, groups and
shuffle partitions follow the counted text bytes, so the memory of a task and what it reads
stay the same at any size.

Cases: a null or empty text, or one of fewer than ``k`` words, loses nothing. Rows that
share an id never remove each other's words and are judged one by one; rows without an id
are neither earlier nor later than others and lose nothing. Identical texts lose all but the
smallest id's words (given ``k`` words). Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, covered, mix, rolling, runs, sizes, starts_inside, words_of

#: Text bytes behind one bucket of hashes, behind one group of texts, and in one chunk.
BUCKET_BYTES, GROUP_BYTES, CHUNK = 16 << 20, 8 << 20, 8 << 20
_SCHEMA = "key long, docs binary, counts binary, hashes binary, at binary"
_NAMES = ["key", "docs", "counts", "hashes", "at"]
_OWNER = np.dtype([("id", "<i8"), ("mark", "<u4")])


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _pack_gaps(at: np.ndarray, new: np.ndarray) -> bytes:
    """Positions as gaps in bytes: 255 counts 255 and goes on, anything less ends a gap."""
    gap = np.diff(np.r_[0, at])
    gap[new] = at[new]
    more, rest = gap // 255, gap % 255
    out = np.full(int(more.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def _unpack_gaps(raw: bytes, counts: np.ndarray) -> np.ndarray:
    values = np.frombuffer(raw, np.uint8).astype(np.int64)
    ends = np.flatnonzero(values < 255)
    total = np.cumsum(values)[ends]
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    before = np.where(first > 0, total[first - 1], 0) if len(total) else first
    return total - np.repeat(before, counts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], _NAMES)


def _packed(keys: np.ndarray, owners: np.ndarray, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray | None) -> Iterator[tuple]:
    """Rows, one a key. Entries come in order of document and position; ``doc`` indexes ``owners``."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    keys, doc, at = keys[order], doc[order], at[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = doc[a:b]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = b"" if hashes is None else hashes[order[a:b]].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
        yield int(keys[a]), owners[own[new]].tobytes(), np.diff(np.r_[new, b - a]).astype(np.uint32).tobytes(), low, _pack_gaps(at[a:b], new)


def _later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries' hash also has an entry with a smaller id."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes)
    sorted_hashes, sorted_ids = hashes[order], ids[order]
    new = np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]
    least = np.minimum.reduceat(sorted_ids, np.flatnonzero(new))
    later = np.empty(len(hashes), bool)
    later[order] = sorted_ids > least[np.cumsum(new) - 1]
    return later


def _owners(ids: list, texts: list[bytes]) -> np.ndarray:
    """Ids with a mark of the text, which keeps rows that share an id apart."""
    out = np.empty(len(ids), _OWNER)
    out["id"], out["mark"] = ids, [zlib.crc32(t) for t in texts]
    return out


def repeated_windows(df: DataFrame, k: int, buckets: int, groups: int, parts: int) -> DataFrame:
    """Packed rows ``(key = group of the document, docs, counts, at)`` of the repeated windows' starts."""
    bits = buckets.bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in chunks(batches, CHUNK):
            words = words_of(texts)
            start = np.flatnonzero(starts_inside(words, k))
            if not len(start):
                continue
            hashes, owners = rolling(words.hash, k)[start], _owners(ids, texts)
            doc = words.doc[start]
            at = start - words.first[doc]
            del words, start
            known = _later(hashes, owners["id"][doc])
            keys = _group(owners["id"][doc[known]], groups)
            rows = [(-1 - key, *rest) for key, *rest in _packed(keys, owners, doc[known], at[known], None)]
            known = ~known
            hashes, doc, at = hashes[known], doc[known], at[known]
            keys = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            for row in chain(rows, _packed(keys, owners, doc, at, hashes)):
                yield _batch([row])

    def count(key, table):
        if key[0].as_py() < 0:  # settled in its chunk
            return table.set_column(0, "key", pa.array([-1 - key[0].as_py()] * table.num_rows, pa.int64()))
        owners, counts, low, at = ([], [], [], [])
        for owner, n, low_bytes, gaps in zip(*(table.column(i).to_pylist() for i in range(1, 5)), strict=True):
            owners.append(np.frombuffer(owner, _OWNER))
            counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
            low.append(np.frombuffer(low_bytes, np.uint8))
            at.append(_unpack_gaps(gaps, counts[-1]))
        owners, at = np.concatenate(owners), np.concatenate(at)
        doc = np.repeat(np.arange(len(owners)), np.concatenate(counts))
        hashes = np.zeros((len(doc), 8), np.uint8)
        hashes[:, :7] = np.concatenate(low).reshape(-1, 7)
        later = _later(hashes.reshape(-1).view(np.uint64), owners["id"][doc])
        keys = _group(owners["id"][doc[later]], groups)
        rows = [_batch([row]) for row in _packed(keys, owners, doc[later], at[later], None)]
        return pa.Table.from_batches(rows) if rows else table.slice(0, 0)

    return df.mapInArrow(emit, _SCHEMA).repartition(parts, "key").groupBy("key").applyInArrow(count, _SCHEMA)


def remove_repeats(
    df: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``(id, n_words, n_removed, kept, spans)``: the kept words joined by a space, and the removed word intervals."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = every.where("id is not null")
    _, size = sizes(docs)
    buckets, groups = _power_of_two(size / bucket_bytes), max(1, size // group_bytes)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    flagged = repeated_windows(docs, k, buckets, groups, parts).repartition(parts, "key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for ids, texts, _ in chunks(batches, CHUNK):
            owners = _owners(ids, texts)
            key = _group(owners["id"], groups)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                lengths = np.array([len(texts[i]) for i in own], np.int64)
                yield _batch([(int(key[own[0]]), owners[own].tobytes(), lengths.tobytes(), press.compress(b"".join(texts[i] for i in own)), b"")])

    def cut(key, left, right):
        at: dict[tuple[int, int], list[np.ndarray]] = {}
        for owner, counts, gaps in zip(*(right.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
            n = np.frombuffer(counts, np.uint32).astype(np.int64)
            for i, part in zip(np.frombuffer(owner, _OWNER).tolist(), np.split(_unpack_gaps(gaps, n), np.cumsum(n)[:-1]), strict=True):
                at.setdefault(i, []).append(part)
        out = []
        unpress = zstandard.ZstdDecompressor()
        for docs_, lengths, raw in zip(*(left.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data, n = unpress.decompress(raw) if raw else b"", 0
            for i, length in zip(np.frombuffer(docs_, _OWNER).tolist(), np.frombuffer(lengths, np.int64).tolist(), strict=True):
                words = data[n : n + length].split()  # splits at ASCII space and 0x09-0x0D, as the word pattern
                n += length
                spans = []
                if i in at:
                    gone = covered(len(words), np.concatenate(at[i]), k)
                    spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)]
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                out.append((i[0], len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), spans))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "n_words", "n_removed", "kept", "spans"])

    schema = "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in chunks(batches, CHUNK):
            kept = [t.split() for t in texts]
            n = pa.array([len(w) for w in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([n, pa.array([b" ".join(w).decode("utf-8", "replace") for w in kept], pa.string())], ["n_words", "kept"])

    met = docs.mapInArrow(pack, _SCHEMA).repartition(parts, "key").groupBy("key").cogroup(flagged.groupBy("key")).applyInArrow(cut, schema)
    alone = every.where("id is null").mapInArrow(whole, "n_words long, kept string")
    none = F.array().cast("array<struct<start:long,end:long>>")
    alone = alone.select(F.lit(None).cast("long").alias("id"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept", none.alias("spans"))
    return met.unionByName(alone).withColumnRenamed("id", id_col)
