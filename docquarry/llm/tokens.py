"""Token ids of whole batches with the public vocabulary files.

A text is cut where no token of the vocabulary can span, each distinct piece is encoded once by the tokenizers library, and
the ids are put together by array lookups. The pieces already seen stay in a bounded table of the worker. Ids are the
library's own for the whole text with add_special_tokens=False: the string of an added token in a text, such as an end-of-text mark, gives
that token's id, and a text that holds one is encoded whole. With ``ordinary_specials`` such strings are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .textarrays import _IS_SPACE, Flat, mix, slices, spread

#: Distinct pieces kept by a worker before it starts over, and encoded in one call.
CACHE_PIECES, ENCODED_AT_ONCE = 1_000_000, 2_000
#: Fixed value: white space outside ASCII's six, which the byte-level pattern also splits at.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes slices of texts. ``keeps_space``: white space belongs to tokens (byte-level), else it only separates words."""

    def __init__(self, path: str, keeps_space: bool, ordinary_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        if ordinary_specials:
            self.tokenizer.encode_special_tokens = True
        added = () if ordinary_specials else (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # Letters' case is ignored, as a vocabulary may match its added tokens in normalised text.
        self.added = [t.lower().encode() for t in added if t]
        self._clear()

    def _clear(self) -> None:
        # Known pieces by ascending hash: their second hash, and where their ids are in the pool.
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _cut(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        if not len(flat.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, stops = self._cut_at_space(flat) if self.keeps_space else flat.words()
        whole = self._with_added(flat)
        if self.keeps_space:
            whole = np.union1d(whole, self._odd(flat))
        if len(whole):
            keep = ~np.isin(flat.doc_of(starts), whole)
            starts, stops = np.concatenate((starts[keep], flat.offs[whole])), np.concatenate((stops[keep], flat.offs[whole + 1]))
            order = np.argsort(starts, kind="stable")
            starts, stops = starts[order], stops[order]
        return starts, stops

    @staticmethod
    def _cut_at_space(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        runs, ends = flat.runs(_IS_SPACE[flat.data])
        alone = (ends - runs == 1) & (flat.data[runs] == 10)
        cut = np.zeros(len(flat.data) + 1, bool)
        cut[flat.offs] = True
        cut[runs] = True
        cut[ends[alone]] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]

    def _with_added(self, flat: Flat) -> np.ndarray:
        """Texts that hold the string of an added token, which stay whole."""
        docs: set[int] = set()
        low = flat.lower().data
        for token in self.added:
            at = np.flatnonzero(low == token[0])
            for k in range(1, len(token)):
                at = at[at + k < len(low)]
                at = at[low[at + k] == token[k]]
                if not len(at):
                    break
            docs.update(flat.doc_of(at).tolist())
        return np.array(sorted(docs), np.int64)

    def _odd(self, flat: Flat) -> np.ndarray:
        """Texts with other white space, which stay whole."""
        rare = np.isin(flat.data, (0x1C, 0x1D, 0x1E, 0x1F, 0x80, 0x85, 0x9F, 0xA0))  # bytes that such characters contain
        docs = np.unique(flat.doc_of(np.flatnonzero(rare)))
        return np.array([d for d in docs if _OTHER_SPACE.search(bytes(flat.data[flat.offs[d] : flat.offs[d + 1]]).decode())], np.int64)

    def _add(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces and merge them into the table; ``keys`` ascend."""
        ids: list[np.ndarray] = []
        for k in range(0, len(pieces), ENCODED_AT_ONCE):
            encoded = self.tokenizer.encode_batch_fast(pieces[k : k + ENCODED_AT_ONCE], add_special_tokens=False)
            ids += [np.asarray(e.ids, self.pool.dtype) for e in encoded]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, self.pool.dtype)
        if len(self.pool) < self.used + len(flat):
            grown = np.zeros(self.used + len(flat) + (self.used >> 2), self.pool.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.starts, self.lengths = np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)

    def encode(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slice's texts end to end, and where each text's begin (n + 1 offsets)."""
        starts, stops = self._cut(flat)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(flat.n + 1, np.int64)
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        keys, first, inverse = np.unique(flat.hashes(starts, stops), return_index=True, return_inverse=True)
        a, b = starts[first], stops[first]
        second = flat.hashes(starts, stops, 1)
        checks = second[first]
        if (second != checks[inverse]).any():  # two pieces with one hash
            return self._encode_singly(flat)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        clash = np.flatnonzero(known & (self.checks[at] != checks)) if len(self.keys) else np.zeros(0, np.int64)
        if len(clash):  # two pieces with one hash: start over with the one that is needed now
            self._clear()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            raw = flat.data.tobytes()
            self._add(keys[new], checks[new], [raw[i:j].decode() for i, j in zip(a[new].tolist(), b[new].tolist())])
        known = np.searchsorted(self.keys, keys)[inverse]
        lengths = self.lengths[known].astype(np.int64)
        ids = self.pool[spread(self.starts[known], lengths)].astype(np.uint32)
        per_doc = np.bincount(flat.doc_of(starts), lengths, flat.n).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_doc)))

    def _encode_singly(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        texts = [bytes(flat.data[a:b]).decode() for a, b in zip(flat.offs[:-1], flat.offs[1:])]
        ids = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))


_ENCODERS: dict[tuple[str, bool, bool], PieceEncoder] = {}


def encoder(path: str, keeps_space: bool, ordinary_specials: bool = False) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if (key := (path, keeps_space, ordinary_specials)) not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keeps_space, ordinary_specials)
    return _ENCODERS[key]
