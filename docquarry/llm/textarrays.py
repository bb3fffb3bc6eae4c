"""Arrow string columns as flat NumPy arrays: words, lines, shingles and their 64-bit hashes for a whole batch at once.

A batch is cut into slices of bounded bytes (a single longer text is its own slice), so memory follows ``SLICE_BYTES``
and the longest text, never the partition. Null counts as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Keeps the first 0 to 8 bytes of a little-endian block.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Starting values of the independent hashes that a range of bytes can be given.
_SEEDS = np.random.default_rng(20240701).integers(1, 2**63, 2, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Flat:
    """A slice of texts: ``data`` (UTF-8 bytes end to end), ``offs`` (where each text begins, and the end), ``first`` (its row in the batch)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1
        self._padded: np.ndarray | None = None

    def lower(self) -> Flat:
        return Flat(_LOWER[self.data], self.offs, self.first)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, side="right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes where ``inside`` holds, cut where texts meet."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~_IS_SPACE[self.data])

    def _block(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes from each place on as one number, of at most 8 and ``left`` bytes."""
        if self._padded is None:
            self._padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        whole = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), self._padded, strides=(1,))
        return whole[at] & _FIRST_BYTES[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each range; ``which`` picks one of two independent ones.

        Blocks of 8 bytes are mixed each with a key of its place and summed, so no family of strings collides by its form.
        """
        lengths, seed = ends - starts, _SEEDS[which]
        total = mix(self._block(starts, lengths) ^ seed)
        longer = np.flatnonzero(lengths > 8)
        if len(longer):
            n = (lengths[longer] - 1) >> 3
            place = spread(np.ones(len(n), np.int64), n)
            shift = place * 8
            block = self._block(np.repeat(starts[longer], n) + shift, np.repeat(lengths[longer], n) - shift)
            total[longer] += np.add.reduceat(mix(block ^ mix(place.astype(np.uint64) + seed)), np.cumsum(n) - n)
        return mix(total ^ mix(lengths.astype(np.uint64) + seed))

    def numbers(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each range, the same for two ranges exactly when their bytes are the same: hits are compared byte by byte."""
        _, first, number = np.unique(self.hashes(starts, ends), return_index=True, return_inverse=True)
        model, lengths = starts[first][number], ends - starts
        same = lengths == (ends - starts)[first][number]
        same &= self._block(starts, lengths) == self._block(model, lengths)
        longer = np.flatnonzero(same & (lengths > 8) & (starts != model))
        if len(longer):
            n = (lengths[longer] - 1) >> 3
            shift = spread(np.ones(len(n), np.int64), n) * 8
            left = np.repeat(lengths[longer], n) - shift
            equal = self._block(np.repeat(starts[longer], n) + shift, left) == self._block(np.repeat(model[longer], n) + shift, left)
            same[longer] &= np.logical_and.reduceat(equal, np.cumsum(n) - n)
        if not same.all():  # two strings with one hash
            known: dict[bytes, int] = {}
            return np.array([known.setdefault(bytes(self.data[a:b]), len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        return number

    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_doc(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs, weights, self.n)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Flat]:
    """Slices of a batch's text column in order, each within ``limit`` bytes unless one text alone is longer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield Flat(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring values."""
    m = max(len(h) - k + 1, 0)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = mix(out * _U(3) + h[i : m + i])
    return out


def shingles(flat: Flat, k: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the distinct k-word shingles of each text, sorted within it, and where each text's begin (n + 1 offsets).

    A text of 1 to k - 1 words has its whole sequence as its one shingle; a text without words has none. With ``second``,
    an independent hash of each shingle comes last.
    """
    starts, ends = flat.words()
    doc = flat.doc_of(starts)
    counts = np.bincount(doc, minlength=flat.n)
    first = np.concatenate(([0], np.cumsum(counts)))
    m = len(starts)
    same = doc[: m - k + 1] == doc[k - 1 :] if m >= k else np.zeros(0, bool)
    few = np.flatnonzero((counts > 0) & (counts < k))

    def values(which: int) -> np.ndarray:
        h = flat.hashes(starts, ends, which)
        value = _rolled(h, k)[same]
        if not len(few):
            return value
        extra = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            has = counts[few] > i
            extra = np.where(has, mix(extra * _U(3) + h[np.where(has, first[few] + i, 0)]), extra)
        return np.concatenate((value, mix(extra + _U(k))))

    value, owner = values(0), np.concatenate((doc[: len(same)][same], few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    offs = np.concatenate(([0], np.cumsum(np.bincount(owner[fresh], minlength=flat.n)))).astype(np.int64)
    if second:
        return value[fresh], offs, values(1)[order][fresh]
    return value[fresh], offs


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all ranges, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(step)
