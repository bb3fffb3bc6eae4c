"""Range asymmetric numeral system for token ids: interleaved lanes, one static frequency table, checkpoints, checksum.

A block is independent: header, checkpoint table, lane states and words. Lane j holds the symbols j, j + lanes, ...; all lanes
of a step are coded by one array operation. States are 64 bits and give out 32-bit words. At every checkpoint the states and
the position in the words are kept, so decoding may begin there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 17
LOW = np.uint64(1 << 31)
LANES, CHECKPOINT_STEPS = 512, 256
#: Fixed value: header of a block: mark, version, lanes, symbols, words, checkpoints, steps between them, checksum of the ids.
HEADER = struct.Struct("<4sHHQQIII")
MARK, VERSION = b"RANB", 1
_U = np.uint64


class Corrupt(ValueError):
    """A block or table whose mark, length or checksum is wrong."""


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**SCALE_BITS over the symbols that occur."""

    symbols: np.ndarray
    freq: np.ndarray

    @staticmethod
    def from_counts(symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Scale counts so that each symbol keeps at least 1; at most 2**SCALE_BITS distinct symbols."""
        total = 1 << SCALE_BITS
        if len(symbols) > total:
            raise ValueError("more distinct symbols than the table holds")
        if not len(symbols):
            return Table(np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        spare = total - len(symbols)
        freq = 1 + (counts.astype(np.float64) * (spare / counts.sum())).astype(np.int64)
        freq[np.argmax(counts)] += total - freq.sum()
        return Table(symbols.astype(np.uint32), freq.astype(np.uint32))

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        body = zlib.compress(gaps.tobytes() + self.freq.astype("<u4").tobytes(), 6)
        return struct.pack("<II", len(self.symbols), zlib.crc32(body)) + body

    @staticmethod
    def from_bytes(raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw)
        if zlib.crc32(raw[8:]) != crc:
            raise Corrupt("frequency table fails its checksum")
        both = np.frombuffer(zlib.decompress(raw[8:]), "<u4")
        return Table(np.cumsum(both[:n], dtype=np.uint32), both[n:].astype(np.uint32))

    def cumulative(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.freq, dtype=np.uint64)[:-1])).astype(np.uint64) if len(self.freq) else np.zeros(0, np.uint64)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    at = np.searchsorted(table.symbols, ids)
    if n and (at.max(initial=0) >= len(table.symbols) or not np.array_equal(table.symbols[at], ids)):
        raise ValueError("an id is not in the frequency table")
    steps = -(-n // lanes)
    filled = np.zeros(steps * lanes, np.int64)
    filled[:n] = at
    filled[n:] = int(np.argmax(table.freq)) if len(table.freq) else 0
    freq = table.freq.astype(np.uint64)[filled].reshape(steps, lanes)
    cum = table.cumulative()[filled].reshape(steps, lanes)
    top = (LOW >> _U(SCALE_BITS)) << _U(32)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [None] * steps  # type: ignore[list-item]
    marks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        full = state >= top * f
        words[t] = state[full].astype(np.uint32)
        state = np.where(full, state >> _U(32), state)
        q, r = np.divmod(state, f)
        state = (q << _U(SCALE_BITS)) + r + cum[t]
        if t % every == 0:
            marks.append(state.copy())
    before = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.uint64)
    marks.reverse()
    body = np.concatenate(words) if steps else np.zeros(0, np.uint32)
    places = before[: max(steps, 1) : every][: len(marks)]
    head = HEADER.pack(MARK, VERSION, lanes, n, len(body), len(marks), every, zlib.crc32(ids.astype("<u4").tobytes()))
    rest = places.astype("<u8").tobytes() + b"".join(m.astype("<u8").tobytes() for m in marks) + body.astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(rest)) + rest


def decode(block: bytes, table: Table, first_checkpoint: int = 0, n_checkpoints: int | None = None) -> np.ndarray:
    """The ids from one checkpoint on (all of them by default); the checksum of the ids is held against a whole block."""
    mark, version, lanes, n, n_words, n_marks, every, crc = HEADER.unpack_from(block)
    if mark != MARK or version != VERSION:
        raise Corrupt("not a block of this format")
    (rest_crc,) = struct.unpack_from("<I", block, HEADER.size)
    rest = memoryview(block)[HEADER.size + 4 :]
    if len(rest) != 8 * n_marks * (1 + lanes) + 4 * n_words or zlib.crc32(rest) != rest_crc:
        raise Corrupt("block fails its length or checksum")
    places = np.frombuffer(rest, "<u8", n_marks)
    marks = np.frombuffer(rest, "<u8", n_marks * lanes, 8 * n_marks).reshape(n_marks, lanes)
    words = np.frombuffer(rest, "<u4", n_words, 8 * n_marks * (1 + lanes)).astype(np.uint64)
    steps = -(-n // lanes)
    last = n_marks if n_checkpoints is None else min(n_marks, first_checkpoint + n_checkpoints)
    begin, end = first_checkpoint * every, min(steps, last * every)
    if begin >= end:
        return np.zeros(0, np.uint32)
    slot = np.repeat(np.arange(len(table.freq)), table.freq)
    freq, cum = table.freq.astype(np.uint64), table.cumulative()
    low_bits = _U((1 << SCALE_BITS) - 1)
    state, at = marks[first_checkpoint].astype(np.uint64), int(places[first_checkpoint])
    out = np.empty((end - begin, lanes), np.int64)
    for t in range(begin, end):
        part = state & low_bits
        s = slot[part]
        out[t - begin] = s
        state = freq[s] * (state >> _U(SCALE_BITS)) + part - cum[s]
        empty = np.flatnonzero(state < LOW)
        state[empty] = (state[empty] << _U(32)) | words[at : at + len(empty)]
        at += len(empty)
    ids = table.symbols[out.ravel()][: n - begin * lanes]
    if begin == 0 and end == steps and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise Corrupt("decoded ids fail their checksum")
    return ids
