"""Edit metrics of many text pairs at once, on numpy arrays.

A batch's texts become code points (renumbered, so that a table over them stays small) in
matrices of a few thousand pairs of like length. The bit-parallel recurrences of
:mod:`.kernels` then run over the characters of one side, a step for all pairs together; a
pair's bit vector is as many 64-bit words as its shorter side needs. Pairs whose shorter
side is longer than ``MOST`` are left to those kernels, whose cost by character is lower there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest bit vector in characters; pairs at once; entries of their table of characters, and of a matrix of texts.
MOST, PAIRS, TABLE, CELLS = 256, 4096, 1 << 20, 1 << 21
_ONE, _TOP, _FULL = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Texts:
    """Texts as renumbered code points, one after the other."""

    codes: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def matrix(self, rows: np.ndarray, pad: int) -> np.ndarray:
        """The texts of the rows, one a row, filled up with ``pad``."""
        length = self.length[rows]
        place = np.arange(int(length.max(initial=0)))
        at = np.minimum(self.start[rows][:, None] + place, max(0, len(self.codes) - 1))
        out = self.codes[at] if len(self.codes) else np.zeros(at.shape, np.int64)
        return np.where(place < length[:, None], out, pad)


def decoded(*columns: pa.Array) -> tuple[int, list[Texts]]:
    """How many characters occur, and each column's texts; null counts as the empty text."""
    parts, plain = [], True
    for column in columns:
        column = column.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        plain = plain and not (raw & 0x80).any()
        parts.append((column, raw, at - at[0]))
    out = []
    for column, raw, at in parts:
        if not plain:
            raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.r_[0, np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))]
        out.append((raw, at[:-1].astype(np.int64), np.diff(at).astype(np.int64)))
    if plain:
        return 128, [Texts(codes.astype(np.int64), *rest) for codes, *rest in out]
    seen = np.zeros(0x110000, bool)
    for codes, *_ in out:
        seen[codes] = True
    number = np.cumsum(seen) - 1
    return int(seen.sum()), [Texts(number[codes], *rest) for codes, *rest in out]


def pairwise(measure: Callable, shorter_first: bool = True, bits: bool = True):
    """A function of two Arrow columns from one of a :class:`Chunk`; gives scores, and which pairs it left out.

    ``bits``: whether the measure has bit vectors, which bound a pair's length and a chunk's table.
    """

    def run(a: pa.Array, b: pa.Array, **config) -> tuple[np.ndarray, np.ndarray]:
        kinds, (x, y) = decoded(a, b)
        out = np.zeros(len(a))
        if shorter_first:
            swap = x.length > y.length
            codes, offset = np.r_[x.codes, y.codes], len(x.codes)
            x, y = _ordered(codes, offset, x, y, swap)
        order = np.lexsort((y.length, x.length))
        long = x.length if shorter_first else np.maximum(x.length, y.length)
        widest = np.maximum(x.length, y.length)
        left = long > MOST if bits else np.zeros(len(a), bool)
        order = order[~left[order]]
        at = 0
        while at < len(order):
            words = -(-max(1, int(long[order[at : at + PAIRS]].max())) // 64)
            n = min(PAIRS, max(16, TABLE // (words * (kinds + 2)))) if bits else PAIRS
            while n > 1 and n * int(widest[order[at : at + n]].max()) > CELLS:
                n = max(1, min(n // 2, CELLS // int(widest[order[at : at + n]].max()) + 1))
            rows = order[at : at + n]
            out[rows] = measure(Chunk(x, y, rows, kinds), **config)
            at += n
        return out, left

    return run


def _ordered(codes: np.ndarray, offset: int, x: Texts, y: Texts, swap: np.ndarray) -> tuple[Texts, Texts]:
    """Each pair's sides with the shorter one first."""
    first = Texts(codes, np.where(swap, y.start + offset, x.start), np.where(swap, y.length, x.length))
    return first, Texts(codes, np.where(swap, x.start, y.start + offset), np.where(swap, x.length, y.length))


class Chunk:
    """Some pairs as matrices, with a table of where each character stands in the first side."""

    def __init__(self, x: Texts, y: Texts, rows: np.ndarray, kinds: int):
        self.kinds, self.n, self.m = kinds, x.length[rows], y.length[rows]
        self.a, self.b = x.matrix(rows, kinds), y.matrix(rows, kinds + 1)
        self.words = -(-max(1, self.a.shape[1]) // 64)

    def made(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> Chunk:
        """Other pairs of the same characters."""
        new = Chunk.__new__(Chunk)
        new.kinds, new.a, new.b, new.n, new.m, new.words = self.kinds, a, b, n, m, -(-max(1, a.shape[1]) // 64)
        return new

    def places(self, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bit vectors by pair and character, flat; and where each pair's begin. The pad's are never looked up."""
        side = self.a if side is None else side
        words = -(-max(1, side.shape[1]) // 64)
        table = np.zeros(len(side) * (self.kinds + 2) * words, np.uint64)
        base = np.arange(len(side)) * ((self.kinds + 2) * words)
        for i, at in enumerate(_lookups(base, side, words)):
            at = at + i // 64 if i >= 64 else at
            table[at] = table.take(at) | np.uint64(1 << i % 64)
        return table, base

    def matches(self):
        """For each character of the second side, the words of its places in the first."""
        table, base = self.places()
        for j, at in enumerate(_lookups(base, self.b, self.words)):
            yield j, [table.take(at + w if w else at) for w in range(self.words)]


def _lookups(base: np.ndarray, side: np.ndarray, words: int) -> np.ndarray:
    """By position, where each pair's character has its bit vector."""
    return np.ascontiguousarray((base[:, None] + (side * words if words > 1 else side)).T)


def _plus(v: np.ndarray, u: np.ndarray, carry: np.ndarray | None, last: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """A word's sum and what it carries into the next word."""
    total = v + u
    over = None if last else total < v
    if carry is not None:
        total = total + carry
        over = None if last else over | ((total == 0) & (carry != 0))
    return total, None if over is None else over.astype(np.uint64)


def _common(chunk: Chunk) -> np.ndarray:
    """Lengths of longest common subsequences."""
    state = [np.full(len(chunk.n), _FULL) for _ in range(chunk.words)]
    for _, match in chunk.matches():
        carry = None
        for w, (v, m) in enumerate(zip(state, match, strict=True)):
            u = v & m
            total, carry = _plus(v, u, carry, w + 1 == chunk.words)
            state[w] = total | (v - u)
    return sum(np.bitwise_count(~v).astype(np.int64) for v in state)


def _edits(chunk: Chunk, swaps: bool) -> np.ndarray:
    """Levenshtein distances, or with ``swaps`` those of optimal string alignment."""
    words, rows = chunk.words, len(chunk.n)
    last = np.maximum(chunk.n - 1, 0)
    top = [np.where(last // 64 == w, _ONE << (last % 64).astype(np.uint64), np.uint64(0)) for w in range(words)]
    up, down = [np.full(rows, _FULL) for _ in range(words)], [np.zeros(rows, np.uint64) for _ in range(words)]
    zero, before, score = [np.zeros(rows, np.uint64) for _ in range(words)], [np.zeros(rows, np.uint64) for _ in range(words)], chunk.n.copy()
    least = int(chunk.m.min(initial=0))
    for j, match in chunk.matches():
        carry, raised, lowered, swapped = None, np.uint64(1), np.uint64(0), np.uint64(0)
        change = np.zeros(rows, np.int64)
        for w in range(words):
            m, p, n = match[w], up[w], down[w]
            total, carry = _plus(p, m & p, carry, w + 1 == words)
            d = (total ^ p) | m | n
            if swaps:
                able = ~zero[w] & m
                d |= ((able << _ONE) | swapped) & before[w]
                swapped = able >> _TOP
            plus, minus = n | ~(d | p), p & d
            change += (plus & top[w]) != 0
            change -= (minus & top[w]) != 0
            shifted, fallen = (plus << _ONE) | raised, (minus << _ONE) | lowered
            raised, lowered = plus >> _TOP, minus >> _TOP
            up[w], down[w] = fallen | ~(d | shifted), shifted & d
            zero[w], before[w] = d, m
        score += change if j < least else np.where(j < chunk.m, change, 0)
    return np.where(chunk.n == 0, chunk.m, score)


def _same(chunk: Chunk) -> np.ndarray:
    width = min(chunk.a.shape[1], chunk.b.shape[1])
    return chunk.a[:, :width] == chunk.b[:, :width]


def _begun(same: np.ndarray) -> np.ndarray:
    """How many true values open each row."""
    return np.where(same.all(1), same.shape[1], same.argmin(1)) if same.shape[1] else np.zeros(len(same), np.int64)


def _flipped(side: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    place = length[:, None] - 1 - np.arange(side.shape[1])
    return np.where(place >= 0, np.take_along_axis(side, np.maximum(place, 0), 1), pad)


def _ended(chunk: Chunk) -> np.ndarray:
    width = min(chunk.a.shape[1], chunk.b.shape[1])
    return _begun(_flipped(chunk.a, chunk.n, chunk.kinds)[:, :width] == _flipped(chunk.b, chunk.m, chunk.kinds + 1)[:, :width])


def _below(bits: np.ndarray, word: int) -> np.ndarray:
    """The word's mask of the positions below ``bits``."""
    own = np.clip(bits - 64 * word, 0, 64)
    return np.where(own == 64, _FULL, (_ONE << np.minimum(own, 63).astype(np.uint64)) - _ONE)


def _jaro(chunk: Chunk) -> np.ndarray:
    n, m, rows = chunk.n, chunk.m, len(chunk.n)
    table, base = chunk.places(chunk.b)
    words = -(-max(1, chunk.b.shape[1]) // 64)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    taken = [np.zeros(rows, np.uint64) for _ in range(words)]
    mine = np.zeros(chunk.a.shape, bool)
    for i, at in enumerate(_lookups(base, chunk.a, words)):
        open_ = chunk.a[:, i] < chunk.kinds
        for w in range(words):
            free = table.take(at + w if w else at) & ~taken[w] & _below(i + reach + 1, w) & ~_below(i - reach, w)
            free = np.where(open_, free, np.uint64(0))
            first = free & (~free + _ONE)
            taken[w] |= first
            open_ = open_ & (first == 0)
        mine[:, i] = (chunk.a[:, i] < chunk.kinds) & ~open_
    theirs = np.unpackbits(np.stack(taken, 1).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : chunk.b.shape[1]].astype(bool)
    k = mine.sum(1)
    owner = np.repeat(np.arange(rows), k)
    half = np.bincount(owner, chunk.a[mine] != chunk.b[theirs], rows).astype(np.int64) // 2
    some = np.maximum(k, 1)
    score = (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - half) / some) / 3
    return np.where((n == 0) & (m == 0), 1.0, np.where(k == 0, 0.0, score))


def _jaro_winkler(chunk: Chunk, prefix_weight: float = 0.1) -> np.ndarray:
    score = _jaro(chunk)
    more = np.minimum(score + np.minimum(_begun(_same(chunk)), 4) * prefix_weight * (1 - score), 1.0)
    return np.where(score > 0.7, more, score)


def _apart(chunk: Chunk, pad: bool = True) -> np.ndarray:
    if not pad and (chunk.n != chunk.m).any():
        raise ValueError("Sequences are not the same length.")
    return np.maximum(chunk.n, chunk.m) - _same(chunk).sum(1)


def _longer(chunk: Chunk) -> np.ndarray:
    return np.maximum(chunk.n, chunk.m)


def _ratio(chunk: Chunk) -> np.ndarray:
    total = chunk.n + chunk.m
    return np.where(total > 0, 1 - (total - 2 * _common(chunk)) / np.maximum(total, 1), 1.0) * 100


def _scales(measure: Callable, most: Callable, **how) -> dict[str, Callable]:
    """The four operations of a family whose measure is a distance."""
    share = lambda c, **config: np.where(most(c) > 0, measure(c, **config) / np.maximum(most(c), 1), 0.0)
    return {
        "distance": pairwise(measure, **how), "similarity": pairwise(lambda c, **config: most(c) - measure(c, **config), **how),
        "normalized_distance": pairwise(share, **how), "normalized_similarity": pairwise(lambda c, **config: 1.0 - share(c, **config), **how),
    }


def _both(chunk: Chunk) -> np.ndarray:
    return chunk.n + chunk.m


def _openings(chunk: Chunk) -> np.ndarray:
    """The best ratio of the first side with a beginning of the second that isn't longer."""
    state = [np.full(len(chunk.n), _FULL) for _ in range(chunk.words)]
    best = np.zeros(len(chunk.n))
    for j, match in chunk.matches():
        if j >= chunk.a.shape[1]:
            break
        carry = None
        for w, (v, m) in enumerate(zip(state, match, strict=True)):
            u = v & m
            total, carry = _plus(v, u, carry, w + 1 == chunk.words)
            state[w] = total | (v - u)
        common = sum(np.bitwise_count(~v).astype(np.int64) for v in state)
        best = np.maximum(best, np.where((j < chunk.n) & (j < chunk.m), 200 * common / (chunk.n + j + 1), 0.0))
    return best


def _partial(chunk: Chunk) -> np.ndarray:
    """The best ratio of the first side (the shorter) with a window of the second, or of either if both are equally long."""
    backwards = chunk.made(_flipped(chunk.a, chunk.n, chunk.kinds), _flipped(chunk.b, chunk.m, chunk.kinds + 1), chunk.n, chunk.m)
    best = np.maximum(_openings(chunk), _openings(backwards))
    same = np.flatnonzero((chunk.n == chunk.m) & (best < 100))
    if len(same):
        for side in (chunk, backwards):
            turned = chunk.made(*(np.where(m >= chunk.kinds, pad, m) for m, pad in ((side.b[same], chunk.kinds), (side.a[same], chunk.kinds + 1))), chunk.m[same], chunk.n[same])
            best[same] = np.maximum(best[same], _openings(turned))
    # Windows in the middle that end with a character of the first side; no other is better than all of them.
    table, base = chunk.places()
    ends = np.zeros(chunk.b.shape, bool)
    for j, at in enumerate(_lookups(base, chunk.b, chunk.words)):
        ends[:, j] = (j >= chunk.n - 1) & (j < chunk.m - 1) & (sum(table.take(at + w) for w in range(chunk.words)) != 0)
    row, last = np.nonzero(ends & (chunk.n > 0)[:, None] & (best < 100)[:, None])
    for at in range(0, len(row), PAIRS):
        r, e = row[at : at + PAIRS], last[at : at + PAIRS]
        place = np.arange(chunk.a.shape[1])
        window = np.take_along_axis(chunk.b[r], np.minimum((e - chunk.n[r] + 1)[:, None] + place, chunk.b.shape[1] - 1), 1)
        window = np.where(place < chunk.n[r][:, None], window, chunk.kinds + 1)
        np.maximum.at(best, r, 100 * _common(chunk.made(chunk.a[r], window, chunk.n[r], chunk.n[r])) / np.maximum(chunk.n[r], 1))
    return np.where(chunk.m == 0, 100.0, best)


def _listed(column: pa.Array) -> list[str]:
    return column.cast(pa.string()).fill_null("").to_pylist()


def _derived(score: Callable, derive: Callable[[str], str]):
    """A score of texts that are derived from the operands, each distinct one once."""

    def run(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sides = []
        for column in (a, b):
            coded = column.cast(pa.string()).fill_null("").dictionary_encode()
            sides.append(pa.array([derive(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices))
        return score(*sides)

    return run


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def _token_set(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sets = [{}, {}]
    first, second, sizes = [], [], np.zeros((4, len(a)))
    for i, pair in enumerate(zip(_listed(a), _listed(b), strict=True)):
        x, y = (known.get(t) or known.setdefault(t, frozenset(t.split())) for known, t in zip(sets, pair, strict=True))
        both = x & y
        p, q = " ".join(sorted(x - both)), " ".join(sorted(y - both))
        first.append(p)
        second.append(q)
        sizes[:, i] = len(" ".join(both)), len(p), len(q), 0 if not x or not y else 1 if both and (len(both) == len(x) or len(both) == len(y)) else 2
    common, left = SCORES["lcs"]["similarity"](pa.array(first, pa.string()), pa.array(second, pa.string()))
    sect, p, q, kind = sizes
    gap = sect > 0
    one, two = sect + gap + p, sect + gap + q
    with np.errstate(divide="ignore", invalid="ignore"):
        best = 100 - 100 * (p + q - 2 * common) / (one + two)
        best = np.where(gap, np.maximum(best, np.maximum(100 - 100 * (1 + p) / (sect + one), 100 - 100 * (1 + q) / (sect + two))), best)
    return np.where(kind == 0, 0.0, np.where(kind == 1, 100.0, best)), left & (kind == 2)


def _unshared(lists: bool):
    """Partial ratio of the sorted tokens of pairs that share none; 100 for the others. ``lists``: repeated tokens too, and two texts without tokens are alike."""

    def run(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, frozenset] = {}
        out, rest, derived = np.full(len(a), 100.0), [], ([], [], [], [])
        for i, (p, q) in enumerate(zip(_listed(a), _listed(b), strict=True)):
            x, y = (known.get(t) or known.setdefault(t, frozenset(t.split())) for t in (p, q))
            if x.isdisjoint(y):
                rest.append(i)
                for at, part in enumerate((" ".join(sorted(x)), " ".join(sorted(y)), _sorted(p), _sorted(q))):
                    derived[at].append(part)
        left = np.zeros(len(a), bool)
        if rest:
            columns = [pa.array(d, pa.string()) for d in derived]
            partial = SCORES["fuzz"]["partial_ratio"]
            best, left[rest] = partial(*columns[:2])
            if lists:
                more, other = partial(*columns[2:])
                best, left[rest] = np.maximum(best, more), left[rest] | other
            else:
                empty = np.array([not p or not q for p, q in zip(*derived[:2], strict=True)])
                best = np.where(empty, 0.0, best)
            out[rest] = best
        return out, left

    return run


def _weighted(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, y = _listed(a), _listed(b)
    n, m = (np.fromiter(map(len, side), np.int64, len(side)) for side in (x, y))
    some = (n > 0) & (m > 0)
    share = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    best, left = SCORES["fuzz"]["ratio"](a, b)
    spaced = np.fromiter((any(map(str.isspace, p)) or any(map(str.isspace, q)) for p, q in zip(x, y, strict=True)), bool, len(x))
    scale = np.where(share <= 8, 0.9, 0.6)
    for own, name, factor in ((some & (share < 1.5) & spaced, "token_ratio", 0.95 + 0 * scale), (some & (share >= 1.5), "partial_ratio", scale), (some & (share >= 1.5), "partial_token_ratio", 0.95 * scale)):
        rows = np.flatnonzero(own)
        if len(rows):
            take = pa.array(rows)
            found, out = SCORES["fuzz"][name](a.take(take), b.take(take))
            best[rows] = np.maximum(best[rows], found * factor[rows])
            left[rows] |= out
    return np.where(some, best, 0.0), left & some


def _best_of(*scores: Callable):
    def run(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [score(a, b) for score in scores]
        return np.maximum.reduce([f for f, _ in found]), np.logical_or.reduce([left for _, left in found])

    return run


def _counted(texts: Texts, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``row * grams + gram`` in order, how often each occurs, and how many grams each row has."""
    many = np.maximum(texts.length - n + 1, 0)
    at = np.repeat(texts.start - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    gram = np.zeros(len(at), np.int64)
    for i in range(n):
        gram = gram * kinds + texts.codes[at + i]
    key = np.sort(np.repeat(np.arange(len(many)), many) * kinds**n + gram)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], np.diff(np.r_[new, len(key)]), many


def bags(score: Callable, far: bool = False):
    """A function of two Arrow columns from one of shared grams, dot product, gram counts and square sums; with ``far`` a distance."""

    def run(a: pa.Array, b: pa.Array, gram_size: int = 2, **config) -> tuple[np.ndarray, np.ndarray]:
        kinds, (x, y) = decoded(a, b)
        if gram_size * np.log2(max(2, kinds)) + np.log2(max(2, len(a))) > 62:  # no room for a number a gram
            return np.zeros(len(a)), np.ones(len(a), bool)
        (p, np_, nx), (q, nq, ny) = _counted(x, gram_size, kinds), _counted(y, gram_size, kinds)
        rows = kinds**gram_size
        at = np.minimum(np.searchsorted(q, p), max(0, len(q) - 1))
        held = np.flatnonzero(q[at] == p) if len(q) else np.zeros(0, np.int64)
        owner, left, right = p[held] // rows, np_[held], nq[at[held]] if len(q) else np_[held]
        total = lambda owner, values: np.bincount(owner, values, len(a))
        shared, dot = total(owner, np.minimum(left, right)), total(owner, left * right)
        squares = total(p // rows, np_**2), total(q // rows, nq**2)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = score(shared, dot, nx, ny, *squares, **config)
        found = 1.0 - found if far else found
        bare = (nx == 0) | (ny == 0)
        if bare.any():
            equal = pc.equal(a.fill_null(""), b.fill_null("")).to_numpy(zero_copy_only=False)
            alike = ((nx == 0) & (ny == 0) & equal).astype(float)
            found = np.where(bare, 1.0 - alike if far else alike, found)
        return found, np.zeros(len(a), bool)

    return run


def _dice(shared, dot, nx, ny, xx, yy):
    return 2 * shared / (nx + ny)


def _cosine(shared, dot, nx, ny, xx, yy):
    return np.minimum(dot / np.sqrt(xx * yy), 1.0)


def _tversky(shared, dot, nx, ny, xx, yy, alpha=0.5, beta=0.5):
    scale = max(1.0, alpha, beta)
    s = shared / scale
    below = s + alpha / scale * (nx - shared) + beta / scale * (ny - shared)
    return np.where(below > 0, s / np.where(below > 0, below, 1.0), 0.0)


def _kinds(score: Callable) -> dict[str, Callable]:
    return {"similarity": bags(score), "distance": bags(score, far=True)}


_ends = {"shorter_first": False, "bits": False}
#: By family and operation: a function of two Arrow columns of texts.
SCORES: dict[str, dict[str, Callable]] = {
    "lcs": _scales(lambda c: _longer(c) - _common(c), _longer), "indel": _scales(lambda c: _both(c) - 2 * _common(c), _both),
    "osa": _scales(lambda c: _edits(c, True), _longer), "levenshtein": _scales(lambda c: _edits(c, False), _longer),
    "hamming": _scales(_apart, _longer, **_ends), "prefix": _scales(lambda c: _longer(c) - _begun(_same(c)), _longer, **_ends),
    "postfix": _scales(lambda c: _longer(c) - _ended(c), _longer, **_ends),
    "jaro": {"similarity": pairwise(_jaro, shorter_first=False), "distance": pairwise(lambda c: 1.0 - _jaro(c), shorter_first=False)},
    "jaro_winkler": {"similarity": pairwise(_jaro_winkler, shorter_first=False), "distance": pairwise(lambda c, **w: 1.0 - _jaro_winkler(c, **w), shorter_first=False)},
    "dice": _kinds(_dice), "cosine": _kinds(_cosine), "tversky": _kinds(_tversky), "fuzz": {"ratio": pairwise(_ratio), "partial_ratio": pairwise(_partial)},
}
SCORES["fuzz"]["token_sort_ratio"] = _derived(SCORES["fuzz"]["ratio"], _sorted)
SCORES["fuzz"]["partial_token_sort_ratio"] = _derived(SCORES["fuzz"]["partial_ratio"], _sorted)
SCORES["fuzz"]["token_ratio"] = _best_of(_token_set, SCORES["fuzz"]["token_sort_ratio"])
SCORES["fuzz"]["partial_token_set_ratio"] = _unshared(lists=False)
SCORES["fuzz"]["partial_token_ratio"] = _unshared(lists=True)
SCORES["fuzz"]["weighted_ratio"] = _weighted
