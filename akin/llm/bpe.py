"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that can end a valid
encoding of it, because a token sequence is a valid encoding when each of its
neighbouring pairs is one. :class:`PrefixEncoder` stores that last token for every
prefix. Walking the stored tokens backwards gives the encoding of any prefix, so
bytes can be appended exactly, and after an edit only the prefixes from the edit
onwards are worked out again.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import release, worker_caches

#: Encoded pieces that a Python worker remembers, and twice as many as pairs of tokens.
MAX_CACHE = 400_000
#: Bytes of a piece's beginning whose last tokens are remembered.
HEAD = 6


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a ``token rank`` file (base64 and decimal); the vocabulary's size bounds what is read."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in io.BytesIO(raw) if line.strip())}


class Vocabulary:
    """Tokens with their ranks, and whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The two tokens whose merge made each token; a single byte's are itself.
        self.halves = {i: self._halves(i, t) for i, t in self.tokens.items()}
        self._judged: dict[int, bool] = {}

    def _halves(self, token: int, data: bytes) -> tuple[int, int]:
        if len(data) == 1:
            return token, token
        parts = self.merged(data, token)
        return (parts[0], parts[1]) if len(parts) == 2 else (token, token)

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Encoding by repeated merging of the lowest-ranked neighbours (of ranks under ``below``)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_judged": {}}

    def may_follow(self, left: int, right: int) -> bool:
        """:meth:`judge`, remembered."""
        pair = left << 20 | right
        known = self._judged.get(pair)
        if known is None:
            if len(self._judged) >= MAX_CACHE // 2:
                self._judged.clear()
            known = self._judged[pair] = self.judge(left, right)
        return known

    def judge(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode as just these two tokens.

        Merges are undone latest first, always of the side that touches the border. At each
        step the border's neighbours must not have merged before the merge just undone.
        """
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        limit = None
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (limit is None or across < limit):
                return False
            left_half, right_half = halves[left][1], halves[right][0]
            if left_half != left and (left > right or right_half == right):
                limit, left = left, left_half
            elif right_half != right:
                limit, right = right + 1, right_half
            else:
                return True


class PrefixEncoder:
    """The last token of every prefix of a byte string that can grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    @classmethod
    def resumed(cls, vocabulary: Vocabulary, data: bytes, last: list[int]) -> PrefixEncoder:
        """An encoder of ``data`` whose last tokens are known already."""
        own = cls(vocabulary)
        own.data, own.last = data, list(last)
        return own

    def append(self, more: bytes) -> PrefixEncoder:
        """Add bytes; stored tokens of shorter prefixes stay as they are."""
        v, data, last = self.vocabulary, self.data + more, self.last
        find, judged, longest = v.ranks.get, v._judged.get, v.longest
        for end in range(len(self.data) + 1, len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = find(data[begin:end])
                if token is not None and (begin == 0 or judged(last[begin - 1] << 20 | token) or v.may_follow(last[begin - 1], token)):
                    last.append(token)
                    break
            else:  # a single byte may always stand alone in a proper vocabulary
                raise ValueError("the ranks give no valid last token for a prefix")
        self.data = data
        return self

    def replace(self, begin: int, end: int, new: bytes) -> PrefixEncoder:
        """Replace ``data[begin:end]``; prefixes that end before ``begin`` keep their tokens.

        Behind the edit, work stops once enough stored tokens agree that later ones must as well.
        """
        v, old, old_last = self.vocabulary, self.data, self.last
        shift = begin + len(new) - end
        self.data, self.last = old[:begin], old_last[:begin]
        self.append(new)
        tail, at, same = old[end:], end, 0
        while at < len(old):
            self.append(tail[at - end : at - end + 1])
            same = same + 1 if self.last[-1] == old_last[at] else 0
            at += 1
            # A last token is fixed by the last tokens of at most `longest` prefixes before it,
            # and whole-prefix tokens cannot reach past `longest` bytes.
            if same >= v.longest and min(at, at + shift) >= v.longest:
                self.data += old[at:]
                self.last += old_last[at:]
                break
        return self

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes (all, by default)."""
        at, out = len(self.data) if end is None else end, []
        while at > 0:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; each match of ``pattern`` is encoded separately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, pattern
        self.find = regex.compile(pattern).findall
        self._seen: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._heads: dict[bytes, list[int]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        """Tokens of one match; a match that is itself a token is that token, as the rank format defines."""
        found = self._older.get(text)
        if found is not None:
            self._remember(text, found)
            return found
        data = text.encode()
        whole = self.vocabulary.ranks.get(data)
        found = (whole,) if whole is not None else tuple(self._begun(data[:HEAD]).append(data[HEAD:]).tokens())
        if len(data) <= 64:
            self._remember(text, found)
        return found

    def _begun(self, head: bytes) -> PrefixEncoder:
        """An encoder of a beginning, whose last tokens are remembered, as many pieces share it."""
        last = self._heads.get(head)
        if last is None:
            if len(self._heads) >= MAX_CACHE // 8:
                self._heads.clear()
            last = self._heads[head] = PrefixEncoder(self.vocabulary, head).last
        return PrefixEncoder.resumed(self.vocabulary, head, last)

    def _remember(self, text: str, found: tuple[int, ...]) -> None:
        """Two generations: what is asked for again survives when the older one goes."""
        if len(self._seen) >= MAX_CACHE // 2:
            self._older, self._seen = self._seen, {}
        self._seen[text] = found

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        get = self._seen.get
        found = list(map(get, pieces))
        if None in found:
            piece = self.piece
            found = [f if f is not None else self._seen.get(p) or piece(p) for p, f in zip(pieces, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_codecs: list[Codec] = []


def _drop() -> None:
    for codec in _codecs:
        codec.vocabulary._judged.clear()  # the vocabulary itself stays as long as its broadcast does
    _codecs.clear()


worker_caches.append(_drop)


def _codec(vocabulary: Vocabulary, pattern: str) -> Codec:
    """A worker's codec, kept while the same vocabulary and pattern are asked for."""
    if not _codecs or _codecs[0].vocabulary.ranks != vocabulary.ranks or _codecs[0].pattern != pattern:
        _codecs[:] = [Codec(vocabulary, pattern)]
    return _codecs[0]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text.

    A null or empty text has no ids. Repeated rows and ids are encoded row by row; other
    columns are not read, so their names cannot clash. Nothing is shuffled. The vocabulary
    is broadcast: its size is fixed by the rank file.
    """
    return _run(df, ranks, pattern, id_col, text_col, "ids array<int>", lambda codec, text: (codec.encode(text),))


def digest(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, and its ids decoded again."""
    names = {i: str(i) for i in ranks.values()}

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        joined = " ".join(map(names.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _run(df, ranks, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes binary)``: the bytes of each row's ids; null ids give no bytes."""
    shared = df.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def _run(df: DataFrame, ranks, pattern: str, id_col: str, text_col: str, columns: str, row) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in columns.split(", "))]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [row(codec, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names)
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
