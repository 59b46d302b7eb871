"""Vectorised byte-level word handling shared by the text operators.

All functions work on whole texts. Byte-sized arrays are made piece by piece
(:data:`PIECE` bytes), so memory follows the words of one chunk, never the table.
Hashes are polynomials over Z/2^64 taken from prefix sums (Rabin-Karp) and then
mixed, so each costs a handful of numpy passes whatever the window length.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
CHUNK_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse, modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        base = _BASES[which]
        have = tuple(
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
            for b in (base, pow(base, -1, 1 << 64))
        )
        if size <= 2 * PIECE:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def class_table(word_bytes: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


#: Anything but ASCII white space.
NON_SPACE = class_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM_HIGH = class_table(
    b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
)
#: Lower-cases A-Z and nothing else.
LOWER_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass
class Words:
    """Words of several texts, in text order."""

    data: bytes  #: the texts, each followed by a line feed
    start: np.ndarray  #: byte offset of each word in ``data``
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  #: index of the text of each word
    first: np.ndarray  #: index of each text's first word; one more entry than texts
    beginnings: list[tuple[np.ndarray, np.ndarray]]  #: by length asked for: word, and hash of so many characters of it

    def __len__(self) -> int:
        return len(self.start)


def words_of(texts: list[bytes], table: np.ndarray = NON_SPACE, lower: bool = False, which: int = 0, beginnings: tuple[int, ...] = ()) -> Words:
    """Words (maximal runs of bytes in ``table``) of ``texts``; a line feed is never a word byte.

    ``beginnings``: lengths in UTF-8 characters of word beginnings to hash, of longer words only.
    """
    data = b"\n".join(texts) + b"\n"
    if lower:
        data = data.translate(LOWER_ASCII)
    array = np.frombuffer(data, np.uint8)
    starts, ends, hashes, at, n = [], [], [], 0, len(array)
    short: list[tuple[list, list]] = [([], []) for _ in beginnings]
    words = 0
    while at < n:
        stop = min(n, at + PIECE)
        while stop < n and table[array[stop - 1]]:
            gap = np.flatnonzero(~table[array[stop : stop + 4096]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(n, stop + 4096)
        piece = array[at:stop]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = table[piece]
        edge = np.flatnonzero(np.diff(inside))
        s, e = edge[::2], edge[1::2]
        power, inverse = powers(len(piece), which)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        if beginnings:
            character = np.flatnonzero((piece & 0xC0) != 0x80)  # where characters begin
            own = np.searchsorted(character, s)
            for length, (which_word, value) in zip(beginnings, short, strict=True):
                stop_at = np.r_[character, np.full(length + 1, len(piece))][own + length]
                longer = np.flatnonzero(stop_at < e)
                b, f = s[longer], stop_at[longer]
                which_word.append(longer + words)
                value.append(mix((total[f] - total[b]) * inverse[b] + np.uint64(length << 32)))
            words += len(s)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    bounds = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, join(ends, np.int64), join(hashes, np.uint64), doc, first, [(join(i, np.int64), join(h, np.uint64)) for i, h in short])


def rolling(values: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Rabin-Karp hash of every run of ``k`` values (over text borders too), mixed."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = max(PIECE, 4 * k)
    out = np.empty(n, np.uint64)
    for at in range(0, n, step):
        part = values[at : at + step + k - 1]
        power, inverse = powers(len(part), which)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power, out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k:] - total[:-k]) * inverse[:m])
    return out


def starts_inside(words: Words, k: int) -> np.ndarray:
    """For each run of ``k`` words, whether it lies in one text."""
    n = len(words) - k + 1
    return words.doc[:n] == words.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``k`` that starts in ``at``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + k, n), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values: the maximal intervals."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A text column as UTF-8; null as the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes], pa.RecordBatch]]:
    """Split Arrow batches into parts of at most ``limit`` text bytes (a longer text stands alone).

    Yields the first column's values, the texts of the second, and the part itself. At the end
    of a task what the worker's allocators hold unused goes back to the system, as Python
    workers live on and share their executor's memory with the JVM.
    """
    for drop in worker_caches:
        drop()
    try:
        yield from _chunks(batches, limit)
    finally:
        release()


#: What another operator left in this Python worker and can make anew; dropped when a task of these chunks begins.
worker_caches: list = []


def release() -> None:
    """Give unused memory of Arrow's and the C library's allocators back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:  # another C library
        return None


_LIBC = _libc()


def _chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes], pa.RecordBatch]]:
    for batch in batches:
        lengths = np.fromiter((0 if t is None else t for t in pc.binary_length(batch.column(1)).to_pylist()), np.int64, batch.num_rows)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(lengths[at:])
            n = max(1, int(np.searchsorted(total, limit, "right")))
            part = batch.slice(at, n)
            yield part.column(0).to_pylist(), as_bytes(part.column(1)), part
            at += n


def sizes(df, column: str = "text") -> tuple[int, int]:
    """Rows and text bytes of a table, counted by Spark; used to choose partition counts."""
    from pyspark.sql import functions as F

    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def checkpointed(spark, df):
    """Cut the lineage through ``spark.checkpoint.dir``; a private folder is made only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import atexit
            import shutil
            import tempfile

            folder = tempfile.mkdtemp(prefix="akin-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Has Spark (4.1 and later; others ignore it) drop an action's shuffle files at its end; read when a frame is made.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(spark, df):
    """:func:`checkpointed`, and the shuffles behind it go at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        own = df.select("*")  # its own plan, so nothing else reads these shuffles
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return checkpointed(spark, own)
