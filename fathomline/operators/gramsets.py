"""Trigram sets of many texts in arrays: bit rows, common counts, the least hashes, pairs of a cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Trigrams that have a bit, the most frequent of a batch first; rarer ones are kept as sorted numbers.
BITS = 16384
#: Words of bits whose common counts are worked out for all pairs of a cell, by one product of matrices; the others only where these leave a chance.
FIRST_WORDS = 32
_SPAN = 1 << 20


def as_strings(texts: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of every window of three characters, two blanks at either end; the characters of each number."""
    padded = [f"  {t}  " for t in texts]
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    there = np.zeros(0x110000, bool)
    there[chars] = True
    alphabet = np.flatnonzero(there)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    c, n = place[chars], len(alphabet)
    inside = np.ones(len(c), bool)
    ends = np.cumsum(lens)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    codes = (c[at] * n + c[at + 1]) * n + c[at + 2]
    if n**3 <= max(1 << 24, 2 * len(codes)):
        seen = np.zeros(n**3, bool)
        seen[codes] = True
        known = np.flatnonzero(seen)
        number = np.zeros(n**3, np.int32)
        number[known] = np.arange(len(known), dtype=np.int32)
        numbers = number[codes]
    else:
        known, numbers = np.unique(codes, return_inverse=True)
        numbers = numbers.astype(np.int32)
    letters = np.stack([alphabet[known // n // n], alphabet[known // n % n], alphabet[known % n]], 1)
    return np.repeat(np.arange(len(texts), dtype=np.int32), lens - 2), numbers, letters


class Sets:
    """The trigram sets of a batch of texts."""

    def __init__(self, texts: list[str]):
        rows, numbers, letters = windows(texts)
        v = len(letters)
        order = np.argsort(-np.bincount(numbers, minlength=v), kind="stable")
        rank = np.empty(v, np.int32)
        rank[order] = np.arange(v, dtype=np.int32)
        ids = rank[numbers]
        head = min(v, BITS)
        words = -(-head // 64)
        self.bits = np.zeros((len(texts), words), np.uint64)
        step = max(1, (1 << 24) // (words * 64))
        cut = np.searchsorted(rows, np.arange(0, len(texts) + step, step))
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            low = ids[i:j] < head
            full = np.zeros((min(step, len(texts) - k * step), words * 64), bool)
            full[rows[i:j][low] - k * step, ids[i:j][low]] = True
            self.bits[k * step : k * step + len(full)] = np.packbits(full, axis=1).view(np.uint64)
        self.size = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.first = np.bitwise_count(self.bits[:, :FIRST_WORDS]).sum(1, dtype=np.int32)
        self.tail = self.ends = None
        if v > head:
            rare = ids >= head
            pairs = np.unique(rows[rare].astype(np.int64) * v + ids[rare])
            self.tail, counts = pairs % v, np.bincount(pairs // v, minlength=len(texts))
            self.ends, self.width = np.concatenate([[0], np.cumsum(counts)]), v
            self.size += counts

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Trigrams that rows a[i] and b[i] share."""
        out = np.empty(len(a), np.int64)
        step = max(1, _SPAN // self.bits.shape[1])
        for i in range(0, len(a), step):
            s = slice(i, i + step)
            out[s] = np.bitwise_count(self.bits[a[s]] & self.bits[b[s]]).sum(1, dtype=np.int64)
            if self.tail is not None:
                out[s] += self._rare(a[s], b[s])
        return out

    def _rare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        sizes = np.diff(self.ends)
        # as many pairs at a time as their numbers leave room for
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(sizes[a] + sizes[b]) // _SPAN)) + 1):
            keys = np.sort(np.concatenate([self._flat(a[part]), self._flat(b[part])]))
            out[part] = np.bincount(keys[1:][keys[1:] == keys[:-1]] // self.width, minlength=len(part))
        return out

    def _flat(self, rows: np.ndarray) -> np.ndarray:
        """The rare trigrams of the rows, each with its place in them."""
        n = self.ends[rows + 1] - self.ends[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[rows], n)
        return owner * self.width + self.tail[at]


def least_hashes(texts: list[str], most: int = 16) -> list[bytes]:
    """The least FNV-1a hashes of each text's trigrams in order, four bytes each."""
    if not texts:
        return []
    rows, numbers, letters = windows(texts)
    h = np.full(len(letters), 2166136261, np.uint64)
    step = lambda h, u: ((h ^ u) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    for c in letters.astype(np.uint64).T:
        wide = c >= 65536  # such a character counts as its two surrogates
        low = (c - np.uint64(65536)) & np.uint64(0xFFFFF)
        h = np.where(wide, step(step(h, (low >> np.uint64(10)) + np.uint64(0xD800)), (low & np.uint64(0x3FF)) + np.uint64(0xDC00)), step(h, c))
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    keys = np.unique(rows * np.int64(len(h)) + rank[numbers])
    owner, hashes = keys // len(h), h[order].astype("<u4")[keys % len(h)]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [hashes[i : min(i + most, j)].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def cell_pairs(x: np.ndarray, y: np.ndarray | None, n: np.ndarray, sets: Sets, threshold: float, length_ratio: float):
    """(i, j, common) of similar rows, one of x and one of y (or both of x), by chunks.

    Where the first words of bits, and all that the others could add, fall
    short of the threshold, a pair is passed over.
    """
    x = x[np.argsort(n[x], kind="stable")]
    other = x if y is None else y[np.argsort(n[y], kind="stable")]
    size = sets.size
    rest, need = (size - sets.first).astype(np.float32), (threshold / (1 + threshold) * size - 1e-2).astype(np.float32)
    spread = lambda rows: np.unpackbits(sets.bits[rows, :FIRST_WORDS].view(np.uint8), axis=1).astype(np.float32)
    ns, rows, columns = n[other], 256, 1024
    # made once: fresh pages for every chunk would take longer than the work
    got_, least_, fits_ = (np.empty(rows * columns, t) for t in (np.float32, np.float32, bool))
    for i in range(0, len(x), rows):
        a = x[i : i + rows]
        lo = np.searchsorted(ns, n[a[0]] * length_ratio, "left") if y is not None else i
        hi = len(other) if length_ratio <= 0 else np.searchsorted(ns, n[a[-1]] / length_ratio * (1 + 1e-9), "right")
        left = spread(a) if lo < hi else None
        for j in range(lo, hi, columns):
            b = other[j : min(j + columns, hi)]
            got, least, fits = (m[: len(a) * len(b)].reshape(len(a), len(b)) for m in (got_, least_, fits_))
            np.matmul(left, spread(b).T, out=got)
            np.minimum(rest[a][:, None], rest[b][None, :], out=least)
            np.add(got, least, out=got)
            np.add(need[a][:, None], need[b][None, :], out=least)
            p, q = np.divmod(np.flatnonzero(np.greater_equal(got, least, out=fits)), len(b))
            if y is None:
                keep = p + i < q + j
                p, q = p[keep], q[keep]
            p, q = a[p], b[q]
            keep = np.minimum(n[p], n[q]) >= np.maximum(n[p], n[q]) * length_ratio
            p, q = p[keep], q[keep]
            if len(p):
                common = sets.common(p, q)
                keep = common / (size[p] + size[q] - common) >= threshold
                if keep.any():
                    yield p[keep], q[keep], common[keep]


def best_in_band(n: np.ndarray, order: np.ndarray, codes: np.ndarray, k: int, home: np.ndarray, length_ratio: float, most: int):
    """(b, a, key) of one band's rows by chunks: for each home row b the best candidates a that come before it.

    codes: a number for each of a row's bands, less than 0 for none.  Only
    pairs that share no band before the k-th are looked at; key is less for
    more shared bands, then for less apart in length, then for a lesser a.
    """
    n = n.astype(np.int64)  # shifted below, by more than 32 bits hold
    by = np.argsort(n, kind="stable")
    ns, b_rows = n[by], by[home[by]]
    step = max(16, (1 << 21) // max(1, len(n)))
    for i in range(0, len(b_rows), step):
        b = b_rows[i : i + step]
        lo = np.searchsorted(ns, n[b[0]] * length_ratio * (1 - 1e-9), "left")
        hi = len(by) if length_ratio <= 0 else np.searchsorted(ns, n[b[-1]] / length_ratio * (1 + 1e-9), "right")
        a = by[lo:hi]
        na, nb = n[a][None, :], n[b][:, None]
        fits = (order[a][None, :] < order[b][:, None]) & (np.minimum(na, nb) >= np.maximum(na, nb) * length_ratio)
        hits = np.zeros(fits.shape, np.int64)
        for j in range(codes.shape[1]):
            same = (codes[a, j][None, :] == codes[b, j][:, None]) & (codes[b, j] >= 0)[:, None]
            if j < k:
                fits &= ~same
            else:
                hits += same
        key = np.where(fits, ((codes.shape[1] - hits) << 57) | (np.abs(na - nb) << 26) | order[a][None, :], np.int64(2**63 - 1))
        if key.shape[1] > most:
            top = np.argpartition(key, most - 1, axis=1)[:, :most]
            key = np.take_along_axis(key, top, 1)
            p, q = np.nonzero(key != 2**63 - 1)
            yield b[p], a[top[p, q]], key[p, q]
        else:
            p, q = np.nonzero(fits)
            yield b[p], a[q], key[p, q]


def places(values: pa.Array) -> np.ndarray:
    """The place of each value in their order, equal ones at the same."""
    return pc.rank(values, tiebreaker="dense").to_numpy().astype(np.int64) - 1
