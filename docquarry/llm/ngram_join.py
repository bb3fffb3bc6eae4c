"""Similarity join of texts on their word shingles: all links of Jaccard similarity p percent or more, as components.

1. Texts with the same shingle set become one node (a third of all rows may be one node).
2. Two sets that link differ in at most d shingles, d known from their sizes. Each set's shingles are dealt by hash to
   k > d parts; some non-empty part of a linked pair is the same in both, unless both sets have many empty parts: such sets also
   give their first shingles by hash, one more than a linked set can lack. Sets that share such a key are candidates; connected
   candidates form a cell. No link crosses cells.
3. In a cell a signature tree is built over its sets, and a dual traversal finds the links. Cells over a bound are cut in
   blocks; what blocks leave open is decided among the sets that share a key, never among all sets of the cell.

Very frequent shingles (shared passages) are left out of the parts of texts that have enough others: leaving the same
shingles out of both sets never makes them differ more, so no link is lost; which ones are left out only sets the cost.

Edge cases: null or wordless texts have the empty set and link with nothing; fewer words than a shingle make one shingle of
the whole; repeated rows are one node; an empty table gives an empty result; only doc_id and text are read; a row without a
doc_id belongs to its component but never names it unless alone (its component_id is then null). Sets are equal when two independent
64-bit hashes of each shingle are; links are counted on the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components
from .signature_tree import Sets, Tree, join
from .textarrays import mix, shingles, slices

#: A shingle counts as frequent when it is in this share of a task's texts (at least so many), looked for in so many shingles at a time.
HOT_SHARE, HOT_LEAST, HOT_CHUNK, HOT_MOST = 0.002, 12, 4_000_000, 1 << 17
#: Sets and shingles of a block; bytes of sets that one task gets; bits of the membership filter.
BLOCK_SETS, BLOCK_SHINGLES, TASK_BYTES, FILTER_BITS = 1024, 8_000_000, 3_000_000, 1 << 23
#: Keys that a task holds before it gives them on; shingles whose keys meet in one range of keys; bits that keys are told apart by there, and
#: those that number the sets of a run.
KEYS_HELD, RANGE_SHINGLES, KEY_BITS, SET_BITS = 1_000_000, 3_000_000, 48, 24
#: Tasks that the rows of one cell or key are split over when they are joined with what is known of it.
SALTS = 32
_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Words of a shingle and least Jaccard similarity in percent (51 to 99)."""

    words: int = 5
    percent: int = 80

    def __post_init__(self):
        if not 51 <= self.percent <= 99:
            raise ValueError("percent must be from 51 to 99: the parts of smaller similarities would not bound what two linked sets differ in")

    @property
    def all_below(self) -> float:
        """Sets whose share of rare shingles is below this give keys from all their shingles, those from 0.5 from the rare ones.

        With a rare share below 0.5 in one set, a linked set's is largest when it lacks frequent shingles only (0.5 / p), or has rare ones
        in addition (0.5 p + 1 - p); so two linked sets always have one of the two kinds of keys in common.
        """
        p = self.percent / 100
        return max(0.5 / p, 0.5 * p + 1 - p) + 1e-6


@lru_cache(maxsize=32)
def _classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each size class (a linked set is at most one class up), and its part count and spare parts."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, math.floor(bounds[-1] * 100 / percent) + 1))
    low = np.array(bounds)
    high = low[1:] - 1
    differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    spare = np.ones(len(high))
    for _ in range(4):
        k = differ + 1 + spare
        empty = k * np.exp(-low[:-1] / k)  # parts expected to be empty
        spare = np.minimum(np.ceil(empty + 4 * np.sqrt(empty) + 1), differ + 1)
    parts = np.where(differ > 0, differ + 1 + spare, 0).astype(np.int64)  # 0: only equal sets link
    return low, parts, spare.astype(np.int64)


def fingerprints(value: np.ndarray, offs: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set, from two independent hashes of its shingles."""
    out = []
    for hashed, salt in ((value, _U(0x2545F4914F6CDD1D)), (second, _U(0xD1342543DE82EF95))):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(hashed ^ salt), out=total[1:])
        out.append(mix(total[offs[1:]] - total[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def _each_slice(batches: Iterator[pa.RecordBatch], words: int, column: int = 0):
    for batch in batches:
        for flat in slices(batch.column(column)):
            value, offs, second = shingles(flat.lower(), words, True)
            yield batch, flat, value, offs, *fingerprints(value, offs, second)


def _summaries(documents: DataFrame, words: int) -> DataFrame:
    """Rows of (doc_id, n, fp1, fp2) for texts, and of (null, -1, shingle, texts) for shingles frequent within a task."""

    def hot(parts: list[np.ndarray], texts: int) -> Iterator[pa.RecordBatch]:
        value, n = np.unique(np.concatenate(parts), return_counts=True)
        often = n >= max(HOT_LEAST, math.ceil(HOT_SHARE * texts))
        m = int(often.sum())
        if m:
            yield _batch([pa.nulls(m, pa.int64()), np.full(m, -1), value[often].view(np.int64), n[often]])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = texts = 0
        for batch, flat, value, offs, fp1, fp2 in _each_slice(batches, words, 1):
            yield _batch([batch.column(0).slice(flat.first, flat.n), np.diff(offs), fp1, fp2])
            parts.append(value)
            size, texts = size + len(value), texts + flat.n
            if size >= HOT_CHUNK:
                yield from hot(parts, texts)
                parts, size, texts = [], 0, 0
        if parts:
            yield from hot(parts, texts)

    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["doc_id", "n", "fp1", "fp2"])

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return common.map_arrow(source, per_task, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint")


def part_keys(value: np.ndarray, offs: np.ndarray, sizes: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of each non-empty part of each set: those it shares with sets of its size class and with the class below.

    ``sizes`` are the sizes that links are judged by; ``value`` may leave shingles out. Of two linked sets' parts at least one
    more than the spare ones are equal. If either set has no more empty parts than are spared, one of those is not empty; if
    both have more, both give their first shingles, of which they share one.
    """
    low, parts, spare = _classes(percent)
    own = np.searchsorted(low, sizes, side="right") - 1
    token_set = np.repeat(np.arange(len(sizes)), np.diff(offs))
    hashed = mix(value ^ _U(0x5851F42D4C957F2D))
    sets, keys = [], []
    sparse = np.zeros(len(sizes), bool)
    for down in (0, 1):
        level = own - down
        k = np.where((sizes > 0) & (level >= 0), parts[np.maximum(level, 0)], 0)
        use = k[token_set] > 0
        owner = token_set[use]
        # Shingles are sorted within a set, so a part, a range of the hash space, is a run.
        part = ((value[use] >> _U(32)) * k[owner].astype(np.uint64) >> _U(32)).astype(np.int64)
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(fresh)
        sums = np.add.reduceat(hashed[use], at) if len(at) else np.zeros(0, np.uint64)
        owner, part = owner[at], part[at]
        filled = np.bincount(owner, minlength=len(sizes))
        sparse |= (k > 0) & (k - filled > spare[np.maximum(level, 0)])
        sets.append(owner)
        keys.append(mix(sums + mix(part.astype(np.uint64) + _U(seed)) ^ mix((level[owner] + 1).astype(np.uint64))))
    if sparse.any():
        # A linked set lacks at most this many of a set's shingles, so the first common one is among one more of either.
        lacks = sizes - -(-sizes * percent // 100)
        place = np.arange(len(value)) - offs[:-1][token_set]
        first = sparse[token_set] & (place <= lacks[token_set])
        sets.append(token_set[first])
        keys.append(mix(value[first] ^ mix(np.full(int(first.sum()), seed + 1, np.uint64))))
    return np.concatenate(sets), np.concatenate(keys)


def set_keys(value: np.ndarray, offs: np.ndarray, similarity: Similarity, frequent: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) by which any two linked sets meet. ``frequent`` (ascending) are left out of sets that have enough other shingles."""
    sizes = np.diff(offs)
    rest = np.ones(len(value), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        rest = frequent[at] != value
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.bincount(owner[rest], minlength=len(sizes))
    new = sizes > 0 if wanted is None else wanted & (sizes > 0)
    sets, keys = [], []
    for use, pick, seed in ((new & (2 * left >= sizes), rest, 1 << 40), (new & (left < similarity.all_below * sizes), np.ones(len(value), bool), 1 << 41)):
        keep = use[owner] & pick
        part_offs = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(sizes)))))
        a, b = part_keys(value[keep], part_offs, np.where(use, sizes, 0), similarity.percent, seed)
        sets.append(a)
        keys.append(b)
    return np.concatenate(sets), np.concatenate(keys).view(np.int64)


def _coded(values: np.ndarray) -> bytes:
    """Numbers as one compressed string, byte places apart: places that are zero in most of them take no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _decoded(coded: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(coded, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _chained(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each member of the components that equal keys connect owners to, but the least, and that least one. Keys are ascending."""
    same = keys[1:] == keys[:-1]
    ends, at = np.unique(np.concatenate((owner[1:][same], owner[:-1][same])), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(ends))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ends)))
    return ends[moved], ends[root[moved]]


def _meetings(documents: DataFrame, similarity: Similarity, hot: np.ndarray, ranges: int) -> DataFrame:
    """(a, b) of nodes (first fingerprints) that keys connect, not all pairs: what is connected is what keys connect.

    Every key is shuffled once, in a few bytes: a run of a task's keys is sorted, cut at ``ranges`` of the key space and coded as differences,
    each with the number of its set in the run; equal keys of a run are given once. Keys are told apart by KEY_BITS of them, so by
    chance some sets meet that share no key, which the exact join settles. A range gives a star for each of its components.
    """
    shared = documents.sparkSession.sparkContext.broadcast(hot)  # HOT_MOST numbers at most
    names = ["range", "run", "n", "keys", "sets"]

    def given(run: int, keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, (node, number) = np.concatenate(keys).view(np.uint64), np.unique(np.concatenate(nodes), return_inverse=True)
        order = np.argsort(key, kind="stable")
        key, number = key[order] >> _U(64 - KEY_BITS), number[order].astype(np.uint32)
        a, b = _chained(key, number)
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        key, number = key[fresh], number[fresh]
        cuts = np.searchsorted((key >> _U(KEY_BITS - 32)) * _U(ranges) >> _U(32), np.arange(ranges + 1))
        # What the numbers stand for, and stars of the run itself, go to groups of their own.
        rows = [(-1 - run % ranges, run, len(node), node.tobytes(), None), (-1 - run % ranges, run, len(a), a.tobytes(), b.tobytes())]
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(cuts[k], cuts[k + 1])
            rows.append((k, run, part.stop - part.start, _coded(np.diff(key[part], prepend=_U(0))), _coded(number[part])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        run, size, keys, nodes = TaskContext.get().partitionId() << 16, 0, [], []
        for _, _, value, offs, fp1, fp2 in _each_slice(batches, similarity.words):
            new = np.array([x not in seen and not seen.add(x) for x in zip(fp1.tolist(), fp2.tolist())], bool)
            sets, key = set_keys(value, offs, similarity, shared.value, new)
            keys.append(key)
            nodes.append(fp1[sets])
            size += len(key)
            if size >= KEYS_HELD:
                yield from given(run, keys, nodes)
                run, size, keys, nodes = run + 1, 0, [], []
        if size:
            yield from given(run, keys, nodes)

    def meet(table: pa.Table) -> pa.Table:
        kind, out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("names", pa.bool_())]), []
        give = lambda a, b, named: out.append(pa.table([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.full(len(a), named))], schema=kind))
        keys, owner = [], []
        for at, run, n, coded, sets in zip(*(table.column(c).to_pylist() for c in names)):
            first = run << SET_BITS
            if at >= 0:
                keys.append(np.cumsum(_decoded(coded, n, np.uint64), dtype=np.uint64))
                owner.append(first + _decoded(sets, n, np.uint32).astype(np.int64))
            elif sets is None:
                give(first + np.arange(n), np.frombuffer(coded, np.int64), True)
            else:
                give(first + np.frombuffer(coded, np.uint32).astype(np.int64), first + np.frombuffer(sets, np.uint32).astype(np.int64), False)
        if keys:
            key, own = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(key, kind="stable")
            give(*_chained(key[order], own[order]), False)
        return pa.concat_tables(out)

    rows = common.map_arrow(documents.select("text"), per_task, "range bigint, run bigint, n bigint, keys binary, sets binary")
    met = common.stage(rows.groupBy("range").applyInArrow(meet, "a bigint, b bigint, names boolean"), "meetings")
    named = met.where("names").select(F.col("a").alias("set"), F.col("b").alias("node"))
    pairs = met.where("NOT names").select("a", "b").distinct()
    for side in "ab":
        # A run that was made anew with other rows would leave numbers without a name.
        name = F.coalesce("node", F.raise_error(F.lit("a set's number has no name")).cast("bigint"))
        pairs = pairs.join(named.withColumnRenamed("set", side), side, "left").withColumn(side, name).drop("node")
    return pairs


def _cell_sets(documents: DataFrame, cells: DataFrame, words: int) -> DataFrame:
    """(fp1, fp2, n, text, cell, blocks, block) of each distinct set that is in a cell of ``cells`` (fp1, cell, blocks).

    A set goes by a text that has it, which takes less room than its shingles; those are made again where they are compared.
    """
    # A node is a hash, so its own low bits serve as its place in the bitmap.
    bits_wanted = min(max(FILTER_BITS, 1 << (cells.count() * 8).bit_length()), 1 << 26)
    slot = f"cast(pmod(fp1, {bits_wanted}) as int)"
    marked = cells.selectExpr(f"{slot} div 32 AS w", f"shiftleft(1L, {slot} % 32) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(bits_wanted // 32, np.uint64)
    bits[marked.column("w").to_numpy()] = marked.column("b").to_numpy().astype(np.uint64)
    bitmap = documents.sparkSession.sparkContext.broadcast(bits)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch, flat, value, offs, fp1, fp2 in _each_slice(batches, words):
            hashed = fp1 % bits_wanted
            pick = np.flatnonzero((bitmap.value[hashed // 32] >> (hashed % 32).astype(np.uint64)) & _U(1))
            pairs = list(zip(fp1.tolist(), fp2.tolist()))
            pick = [i for i in pick.tolist() if offs[i + 1] > offs[i] and pairs[i] not in seen and not seen.add(pairs[i])]
            if pick:
                texts = batch.column(0).take(pa.array(flat.first + np.array(pick)))
                yield pa.RecordBatch.from_arrays([pa.array(fp1[pick]), pa.array(fp2[pick]), pa.array(np.diff(offs)[pick]), texts], ["fp1", "fp2", "n", "text"])

    sets = common.map_arrow(documents.select(F.col("text").cast("string").alias("text")), per_task, "fp1 bigint, fp2 bigint, n bigint, text string")
    return sets.join(cells, "fp1").dropDuplicates(["fp1", "fp2"]).withColumn("block", _block())


def _set_values(texts: list[str], words: int) -> np.ndarray:
    """The shingles of texts, one text's after the other's."""
    return np.concatenate([shingles(flat.lower(), words, True)[0] for flat in slices(pa.array(texts, pa.string()))])


_SIDED = ["task", "cell", "part", "side", "known", "fp1", "fp2", "n", "text"]
BOTH, LEFT, RIGHT = 0, 1, 2


def _solve(similarity: Similarity):
    """For each part of a task: stars (a belongs with b) of the sets that its links, and what is known, connect.

    Sets of side BOTH are joined with each other, those of LEFT with those of RIGHT. ``known`` is a component that a set is
    already known to be in, or null.
    """

    def solve(table: pa.Table) -> pa.Table:
        cell, part, side, fp1, fp2, n = (table.column(c).to_numpy() for c in ("cell", "part", "side", "fp1", "fp2", "n"))
        known = table.column("known").to_pylist()
        texts = table.column("text").to_pylist()
        order = np.lexsort((fp2, fp1, side, part, cell))
        cuts = np.flatnonzero(np.any([x[order][1:] != x[order][:-1] for x in (cell, part)], 0)) + 1 if len(order) else []
        out: list[np.ndarray] = []
        for group in np.split(order, cuts):
            if len(group) < 2:
                continue
            sets = Sets(_set_values([texts[g] for g in group], similarity.words), np.concatenate(([0], np.cumsum(n[group]))))
            first: dict[int, int] = {}
            sets.root = np.array([k if known[g] is None else first.setdefault(known[g], k) for k, g in enumerate(group)])
            at, before = np.arange(len(group)), sets.root.copy()
            left, right = at[side[group] == LEFT], at[side[group] == RIGHT]
            if len(left) and len(right):
                join(sets, Tree(sets, left), Tree(sets, right), similarity.percent)
            elif not len(left) and not len(right):
                tree = Tree(sets, at)
                join(sets, tree, tree, similarity.percent)
            # What was known already is not told again: only heads of known components that now belong to another.
            a = np.flatnonzero((before == at) & (sets.root != at))
            a, b = group[a], group[sets.root[a]]
            out.append(np.stack((cell[a], fp1[a], fp2[a], fp1[b], fp2[b])))
        data = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
        return pa.table([pa.array(x.astype(np.int64)) for x in data], ["cell", "a1", "a2", "b1", "b2"])

    return solve


def _stars(sided: DataFrame, similarity: Similarity, name: str) -> DataFrame:
    made = sided.select(*_SIDED).groupBy("task").applyInArrow(_solve(similarity), "cell bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    return common.stage(made, name)


def _salted(large: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join many rows with a table that has one row for each value of ``on``; the rows of one value are split over SALTS tasks."""
    salted = large.withColumn("salt", F.pmod(F.xxhash64("fp1", F.lit(5)), F.lit(SALTS)))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [on, "salt"], how).drop("salt")


def _block():
    return F.pmod(F.xxhash64("fp2", "fp1", "blocks"), F.col("blocks"))


def _numbered(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (cell, ...) with the number of blocks that their cell is cut in, by its ``sets`` (cell, n)."""
    sizes = sets.groupBy("cell").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1))
    # Cells of one block, which are most, are not joined.
    sizes = common.stage(sizes.select("cell", blocks.alias("blocks")).where("blocks > 1"), "cell-sizes")
    return _salted(rows, sizes, "cell", "left").withColumn("blocks", F.coalesce(F.col("blocks"), F.lit(1).cast("bigint")))


def _blocks(sets: DataFrame) -> DataFrame:
    """``sets`` with the number of blocks of their cell and the one they are in."""
    return _numbered(sets, sets).withColumn("block", _block())


def _sided(sets: DataFrame, task, part, side: int, known=None) -> DataFrame:
    known = F.lit(None).cast("bigint") if known is None else known
    return sets.withColumns({"task": task, "part": part, "side": F.lit(side), "known": known}).select(*_SIDED)


def _pair(x: str):
    return F.struct(F.col(f"{x}1").alias("fp1"), F.col(f"{x}2").alias("fp2"))


def _shared_tasks(sets: DataFrame):
    """The task of a set: its block of a cell of several, else a task that solves many cells."""
    volume = sets.agg(F.sum(F.col("n") * 8)).first()[0] or 0
    few = F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-volume // TASK_BYTES))))
    return F.when(F.col("blocks") > 1, F.xxhash64("cell", "block")).otherwise(few)


def _roots(blocked: DataFrame, similarity: Similarity, hot: np.ndarray) -> DataFrame:
    """(node, root) of the sets that links connect, given with their blocks; both are fingerprints.

    Cells of one block are solved many to a task. A larger cell is solved by block; then one set for each component found is
    solved again, which connects groups of near copies in two passes over them. Links still missing are between sets that
    share a key, so those are then joined, key by key, where a key has sets of several components.
    """
    many = F.col("blocks") > 1
    stars = _stars(_sided(blocked, _shared_tasks(blocked), F.col("block"), BOTH), similarity, "stars")
    large = blocked.where(many).drop("blocks", "block")
    in_large = common.stage(blocked.where(many).select("cell").distinct(), "large-cells")
    if in_large.isEmpty():
        return stars.select(_pair("a").alias("node"), _pair("b").alias("root"))
    # A star's cell is a key that many stars share as well.
    keyed = stars.withColumnsRenamed({"a1": "fp1", "a2": "fp2"})
    flagged = common.stage(_salted(keyed, in_large.withColumn("large", F.lit(True)), "cell", "left").withColumnsRenamed({"fp1": "a1", "fp2": "a2"}), "flagged")
    roots = flagged.where("large IS NULL").select(_pair("a").alias("node"), _pair("b").alias("root"))
    found = flagged.where("large").select("cell", "a1", "a2", "b1", "b2")
    one = found.select(F.col("a1").alias("fp1"), F.col("a2").alias("fp2"), F.col("b1").alias("h1"), F.col("b2").alias("h2"))
    heads = large.join(one, ["fp1", "fp2"], "left_anti")
    again = common.stage(_blocks(heads), "heads")
    again = _stars(_sided(again, F.xxhash64("cell", "block"), F.col("block"), BOTH), similarity, "head-stars")
    two = again.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b1").alias("r1"), F.col("b2").alias("r2"))
    # Each set's head, and its head's: what is known of its component.
    labelled = large.join(one, ["fp1", "fp2"], "left").withColumns({"h1": F.coalesce("h1", "fp1"), "h2": F.coalesce("h2", "fp2")})
    labelled = labelled.join(two, ["h1", "h2"], "left").withColumns({"r1": F.coalesce("r1", "h1"), "r2": F.coalesce("r2", "h2")}).drop("h1", "h2")
    labelled = common.stage(labelled.withColumn("known", F.xxhash64("r1", "r2")), "labelled")
    root = F.struct(F.col("r1").alias("fp1"), F.col("r2").alias("fp2"))
    so_far = labelled.select(F.struct("fp1", "fp2").alias("node"), root.alias("root"))
    cells = labelled.groupBy("cell").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("cell")
    cells = common.stage(cells, "open-cells")
    if cells.isEmpty():
        return roots.unionByName(so_far)
    rest = common.stage(_salted(labelled, cells, "cell", "left_semi"), "open-sets")
    edges = _within_groups(rest, similarity, hot)
    # Only the components' roots are connected, which are far fewer than the sets.
    ends = rest.select(F.struct("fp1", "fp2").alias("x"), root.alias("root"))
    edges = edges.join(ends.select(F.col("x").alias("a"), F.col("root").alias("ra")), "a").join(ends.select(F.col("x").alias("b"), F.col("root").alias("rb")), "b")
    merged = connected_components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.unionByName(so_far.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _open_groups(labelled: DataFrame, similarity: Similarity, hot: np.ndarray) -> DataFrame:
    """(cell, fp1, fp2): groups of sets within which all links between known components lie.

    They are the keys that have sets of several components (of keys with the same sets one is taken), or the whole cell where that makes
    fewer rows: the keys of a cell that many of its sets share in part would hold the same sets over and over.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(hot)  # HOT_MOST numbers at most

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, fp1, fp2, known, n = (batch.column(c).to_numpy() for c in ("cell", "fp1", "fp2", "known", "n"))
                value = _set_values(batch.column("text").to_pylist(), similarity.words)
                sets, keys = set_keys(value, np.concatenate(([0], np.cumsum(n))), similarity, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[sets], keys, fp1[sets], fp2[sets], known[sets])], ["cell", "key", "fp1", "fp2", "known"])

    source = labelled.select("cell", "fp1", "fp2", "known", "n", "text")
    keys = common.stage(common.map_arrow(source, per_task, "cell bigint, key bigint, fp1 bigint, fp2 bigint, known bigint"), "large-cell-keys")
    same = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("fp1", "fp2").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("fp2", "fp1")).alias("xor"))
    open_keys = keys.groupBy("cell", "key").agg(F.min("known").alias("low"), F.max("known").alias("high"), same.alias("same")).where("low <> high")
    chosen = common.stage(open_keys.groupBy("cell", "same").agg(F.min("key").alias("key")).select("cell", "key", F.col("same.n").alias("n")), "open-keys")
    sizes = labelled.groupBy("cell", "known").agg(F.count("*").alias("size")).groupBy("cell").agg(F.sum("size").alias("sets"), (F.sum("size") - F.max("size")).alias("others"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SETS)
    whole = F.col("sets") * blocks("others") + F.col("others") * blocks("sets")
    costs = sizes.join(chosen.groupBy("cell").agg(F.sum("n").alias("by_key")), "cell", "left").withColumn("by_key", F.coalesce("by_key", F.lit(0)))
    costs = common.stage(costs.select("cell", (F.col("by_key") > whole).alias("whole")), "cell-costs")
    by_cell = _salted(labelled.select("cell", "fp1", "fp2"), costs.where("whole").select("cell"), "cell").select(F.xxhash64("cell").alias("cell"), "fp1", "fp2")
    chosen = common.stage(chosen.join(costs.where("NOT whole").select("cell"), "cell", "left_semi").select("key").distinct(), "chosen-keys")
    by_key = _salted(common.with_mark(keys.select("key", "fp1", "fp2"), ["key"], common.marks(chosen), True), chosen, "key")
    return by_cell.unionByName(by_key.select(F.col("key").alias("cell"), "fp1", "fp2"))


def _within_groups(labelled: DataFrame, similarity: Similarity, hot: np.ndarray) -> DataFrame:
    """(a, b) of links between sets of different known components.

    A group's sets are joined in one task where they are few; of more sets, those outside its largest component are joined with all
    of the group, by pairs of blocks.
    """
    members = common.stage(_open_groups(labelled, similarity, hot).join(labelled.drop("cell"), ["fp1", "fp2"]), "group-sets")
    blocked = common.stage(_blocks(members), "key-blocks")
    few = blocked.where("blocks = 1")
    stars = _stars(_sided(few, _shared_tasks(few), F.col("block"), BOTH, F.col("known")), similarity, "key-stars")
    edges = stars.select(_pair("a").alias("a"), _pair("b").alias("b"))
    many = blocked.where("blocks > 1")
    if many.isEmpty():
        return edges
    sizes = many.groupBy("cell", "known").agg(F.count("*").alias("size"))
    main = common.stage(sizes.groupBy("cell").agg(F.max_by("known", F.struct("size", "known")).alias("main")), "main")
    rest = common.stage(_salted(many, main, "cell").where("known <> main").drop("main", "blocks", "block"), "rest")
    rest_blocks = common.stage(_blocks(rest).withColumnsRenamed({"blocks": "r_blocks", "block": "r_block"}), "rest-blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    right = _salted(many, common.stage(rest_blocks.select("cell", "r_blocks").distinct(), "numbers"), "cell").withColumn("r_block", every("r_blocks"))
    left = _salted(rest_blocks, common.stage(many.select("cell", "blocks").distinct(), "all-numbers"), "cell").withColumn("block", every("blocks"))
    part = F.xxhash64("r_block", "block")
    task = F.xxhash64("cell", "r_block", "block")
    sided = _sided(left, task, part, LEFT, F.col("known")).unionByName(_sided(right, task, part, RIGHT, F.col("known")))
    return edges.unionByName(_stars(sided, similarity, "rest-stars").select(_pair("a").alias("a"), _pair("b").alias("b")))


def components(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return _components(documents, similarity).select("doc_id", "n_shingles", "component_id")


def _components(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """``components`` with the fingerprints fp1 and fp2 of each row's set, and those of its component's first set, r1 and r2."""
    summary = common.stage(_summaries(documents, similarity.words), "summaries")
    texts = summary.where("n >= 0")
    # A shingle that is frequent everywhere has a row from each task: those are summed in two steps.
    counted = summary.where("n = -1").select("fp1", "fp2", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    frequent = counted.groupBy("fp1", "salt").agg(F.sum("fp2").alias("texts")).groupBy("fp1").agg(F.sum("texts").alias("texts"))
    frequent = frequent.orderBy(F.desc("texts"), "fp1").limit(HOT_MOST)
    hot = np.sort(frequent.select("fp1").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    nodes = common.stage(texts.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("least")), "nodes")

    total = nodes.agg(F.sum("n")).first()[0] or 0
    pairs = common.stage(_meetings(documents, similarity, hot, max(1, -(-total // RANGE_SHINGLES))), "met-nodes")
    cells = connected_components(pairs)
    cells = common.stage(cells.unionByName(cells.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp1"), F.col("root").alias("cell")), "cell-nodes")
    placed = common.stage(_numbered(cells, nodes.join(cells, "fp1").select("cell", "n")), "placed-nodes")
    members = common.stage(_cell_sets(documents, placed, similarity.words), "cell-sets")
    roots = _roots(members, similarity, hot)
    roots = roots.select(F.col("node.fp1").alias("fp1"), F.col("node.fp2").alias("fp2"), F.col("root.fp1").alias("r1"), F.col("root.fp2").alias("r2"))
    roots = common.stage(roots, "roots")
    common.discard(members)
    rooted = nodes.join(roots, ["fp1", "fp2"], "left")
    rooted = common.stage(rooted.select("fp1", "fp2", "least", F.coalesce("r1", "fp1").alias("r1"), F.coalesce("r2", "fp2").alias("r2")), "rooted")
    names = common.stage(rooted.groupBy("r1", "r2").agg(F.min("least").alias("component_id")), "names")
    named = common.stage(rooted.join(names, ["r1", "r2"]).select("fp1", "fp2", "component_id", "r1", "r2"), "named")
    n_shingles = F.col("n").alias("n_shingles")
    linked = texts.where("n > 0").join(named, ["fp1", "fp2"]).select("doc_id", n_shingles, "component_id", "fp1", "fp2", "r1", "r2")
    alone = texts.where("n = 0").select("doc_id", n_shingles, F.col("doc_id").alias("component_id"), "fp1", "fp2", F.col("fp1").alias("r1"), F.col("fp2").alias("r2"))
    return linked.unionByName(alone)


def one_of_each(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """``documents`` with one row of each component, that of the smallest doc_id, all columns.

    A row goes by its doc_id and its set: of rows that share a doc_id only those whose own set is linked to the one that stays, or
    equal to it, are dropped. Rows that stay pass without a shuffle, but for those that the bitmap of dropped rows marks by
    chance. Rows without a doc_id, and without words, stay.
    """
    parts = _components(documents, similarity).where("doc_id IS NOT NULL AND n_shingles > 0")
    named = common.stage(parts.select("doc_id", "fp1", "fp2", "component_id", "r1", "r2"), "components")
    # Of a component's rows with its smallest doc_id one stays, of the least fingerprint.
    first = named.where("doc_id = component_id").groupBy("r1", "r2").agg(F.min(F.struct("fp1", "fp2")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    tied = common.stage(first.where("n > 1").select("r1", "r2", "first", "least"), "tied")
    other = F.struct("fp1", "fp2") != F.col("first")
    gone = named.where("doc_id <> component_id").select("doc_id", "fp1", "fp2")
    gone = common.stage(gone.unionByName(named.where("doc_id = component_id").join(tied, ["r1", "r2"]).where(other).select("doc_id", "fp1", "fp2")).distinct(), "gone")
    alike = common.stage(tied.select(F.col("least").alias("doc_id"), "first.fp1", "first.fp2"), "alike")
    touched = common.marks(gone.select("doc_id").unionByName(alike.select("doc_id")))
    rows = common.packed(documents, doc_id=F.col("doc_id").cast("bigint"), text=F.col("text"))
    clear = common.with_mark(rows, ["doc_id"], touched, False).select("row")
    rest = _with_prints(common.with_mark(rows, ["doc_id"], touched, True), similarity.words).join(gone, ["doc_id", "fp1", "fp2"], "left_anti")
    if not alike.isEmpty():
        several = rest.join(alike, ["doc_id", "fp1", "fp2"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
        rest = rest.join(alike, ["doc_id", "fp1", "fp2"], "left_anti").unionByName(several)
    return common.unpacked(clear.unionByName(rest.select("row")), documents)


def _with_prints(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` of (row, doc_id, text) with the fingerprints of their sets in place of the text."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, _, _, fp1, fp2 in _each_slice(batches, words, 2):
            here = batch.slice(flat.first, flat.n)
            yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(fp1), pa.array(fp2)], ["row", "doc_id", "fp1", "fp2"])

    fields = [*rows.select("row", "doc_id").schema.fields, T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType())]
    return common.map_arrow(rows.select("row", "doc_id", "text"), per_task, T.StructType(fields))
