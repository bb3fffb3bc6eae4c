"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased over A-Z. Every template is indexed by all its windows of W shingles, W the
largest power of two that is at most two thirds of it; texts are cut in windows of W shingles every W / 2. A whole copy of a
template thus holds a text window equal to one of its own, which collides in every band; for windows of Jaccard similarity s a
collision has probability 1 - (1 - s**ROWS)**BANDS, 0.999 at 0.6. A retrieved template counts when at least
CONTAINED percent of its distinct shingles occur in the stretch of text that its window points to.

Edge cases: a null text counts as empty and has no match; repeated rows give equal results; an empty table gives an empty
result; only doc_id and text are read; a template repeated in a text is reported at each place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES
from .textarrays import Flat, mix, slices

WORDS, BANDS, ROWS, CONTAINED = 3, 16, 2, 80
SCHEMA = "doc_id bigint, n_licenses bigint, matches array<struct<license:string,begin:bigint,until:bigint,contained:int>>"
_U = np.uint64
_FACTORS = np.random.default_rng(41).integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_INSIDE = np.zeros(256, bool)
_INSIDE[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_FILTER_BITS = 20


def _shingles(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of WORDS words, whether it lies in one text, and the words' bounds."""
    low = flat.lower()
    starts, ends = low.runs(_INSIDE[low.data])
    h, doc = low.hashes(starts, ends), low.doc_of(starts)
    m = len(h) - WORDS + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, ends
    value = np.zeros(m, np.uint64)
    for i in range(WORDS):
        value = mix(value * _U(3) + h[i : m + i])
    return value, np.where(doc[:m] == doc[WORDS - 1 :], doc[:m], -1), starts, ends


def band_keys(value: np.ndarray, sizes: Sequence[int], strides: dict[int, int]):
    """(size, stride, band, keys) for windows of each size (powers of two, ascending), every ``stride`` shingles."""
    for band in range(BANDS):
        rows = [value * f for f in _FACTORS[band * ROWS : (band + 1) * ROWS]]
        size, step = 1, 1
        while size < max(sizes) and len(rows[0]) * step > size:
            # Minima of windows of twice the size, from those that begin at the same place and one size on.
            shift = size // step
            rows = [np.minimum(r[:-shift], r[shift:]) for r in rows]
            size *= 2
            wanted = strides.get(size, max(1, size // 2))
            rows, step = [r[:: wanted // step] for r in rows], wanted
            if not len(rows[0]):
                break
            if size in sizes:
                key = rows[0]
                for r in rows[1:]:
                    key = key * _U(3) ^ (r >> _U(7))
                yield size, step, band, mix(key + _U(band))


class Index:
    """The templates by the bands of their windows."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.names = [name for name, _ in templates]
        self.shingles: list[np.ndarray] = []
        self.windows: list[int] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, (_, text) in enumerate(templates):
            (flat,) = slices(pa.array([text]))
            value = _shingles(flat)[0]
            if len(value) < 3:
                raise ValueError("a template needs five words at least")
            size = 1 << int(np.log2(max(2, len(value) * 2 // 3)))
            self.shingles.append(np.unique(value))
            self.windows.append(len(value))
            for got, _, _, keys in band_keys(value, [size], {1 << k: 1 for k in range(1, 20)}):
                found.setdefault(got, []).append((keys, number))
        self.sizes = sorted(found)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, entries in found.items():
            keys = np.concatenate([k for k, _ in entries])
            number = np.concatenate([np.full(len(k), n) for k, n in entries])
            offset = np.concatenate([np.arange(len(k)) for k, _ in entries])
            order = np.argsort(keys, kind="stable")
            near = np.zeros(1 << _FILTER_BITS, bool)
            near[(keys >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.keys[size] = keys[order], np.stack((number[order], offset[order])), near

    def candidates(self, value: np.ndarray) -> np.ndarray:
        """Distinct (template, first shingle of where it would begin) that some band retrieves."""
        out = []
        for size, step, _, keys in band_keys(value, self.sizes, {}):
            known, where, near = self.keys[size]
            hit = np.flatnonzero(near[(keys >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            first = np.searchsorted(known, keys[hit])
            last = np.searchsorted(known, keys[hit], side="right")
            for place, a, b in zip(hit[last > first] * step, first[last > first], last[last > first]):
                out.append(np.stack((where[0, a:b], place - where[1, a:b])))
        return np.unique(np.concatenate(out, 1), axis=1).T if out else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    """The worker's index of some templates."""
    return Index(templates)


def matches(flat: Flat, index: Index) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each text with a match: (first word, last word, percent contained, template), no two of a template overlapping."""
    value, doc, starts, ends = _shingles(flat)
    if not len(value):
        return {}
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for template, begin in index.candidates(value):
        size, shingles = index.windows[template], index.shingles[template]
        slack = size // 4
        anchor = min(max(int(begin) + size // 2, 0), len(value) - 1)
        owner = doc[anchor] if doc[anchor] >= 0 else (doc[anchor - 1] if anchor else -1)
        if owner < 0:
            continue
        a, b = max(int(begin) - slack, 0), min(int(begin) + size + slack, len(value))
        here = np.arange(a, b)[(doc[a:b] == owner) & np.isin(value[a:b], shingles)]
        contained = 100 * len(np.unique(value[here])) // len(shingles)
        if contained >= CONTAINED:
            found.setdefault((int(owner), int(template)), []).append((contained, int(here[0]), int(here[-1]) + WORDS - 1))
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for (owner, template), places in found.items():
        taken: list[tuple[int, int]] = []
        for contained, a, b in sorted(places, key=lambda p: (-p[0], p[1], p[2])):
            if all(b < x or y < a for x, y in taken):
                taken.append((a, b))
                out.setdefault(owner, []).append((a, b, contained, template))
    return {owner: _best(places) for owner, places in out.items()}


def _best(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without matches that overlap a fuller match which is about as long or longer (another version of the same notice)."""
    fuller = lambda p, q: q[2] > p[2] and q[0] <= p[1] and p[0] <= q[1] and 5 * (q[1] - q[0]) >= 4 * (p[1] - p[0])
    return [p for p in places if not any(fuller(p, q) for q in places)]


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """SCHEMA's columns for every row; begin and until are code points of the text, until exclusive."""
    templates = tuple(map(tuple, templates))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates)
        for batch in batches:
            for flat in slices(batch.column(1)):
                found = matches(flat, index)
                lists: list[list[dict]] = [[] for _ in range(flat.n)]
                if found:
                    starts, ends = flat.lower().runs(_INSIDE[flat.lower().data])
                    chars = flat.chars()
                    for d, places in found.items():
                        base = chars[flat.offs[d]]
                        rows = {(index.names[t], int(chars[starts[a]] - base), int(chars[ends[b]] - base)): c for a, b, c, t in sorted(places, key=lambda p: p[2])}
                        lists[d] = [{"license": k[0], "begin": k[1], "until": k[2], "contained": c} for k, c in sorted(rows.items(), key=lambda r: (r[0][1], r[0][2], r[0][0]))]
                kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("until", pa.int64()), ("contained", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(flat.first, flat.n), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, kind)], ["doc_id", "n_licenses", "matches"]
                )

    return common.map_arrow(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), per_task, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_licenses, licenses (``license:begin:until:percent``, comma-joined)."""
    text = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["begin"].cast("string"), m["until"].cast("string"), m["contained"].cast("string")))
    return scanned.select("doc_id", "n_licenses", F.array_join(text, ",").alias("licenses"))
