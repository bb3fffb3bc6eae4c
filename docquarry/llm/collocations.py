"""Phrase collocations: frequent word n-grams of each language, scored by their weakest cut, without those that a longer one holds.

1. Count-min sketches. Every task counts the hashed n-grams of its texts in two rows of cells; sketches are kept as the cells that
   aren't empty, in chunks, and merged chunk by chunk. A cell never holds less than any of its n-grams occurs, so an n-gram with a cell
   below the threshold isn't frequent. Words and pairs come first; n-grams of three to five words are only counted where all their
   pairs passed.
2. A second pass counts the n-grams that passed by their own words, exactly, and drops those below the threshold.
3. Cuts get their parts' counts by joins (parts of a frequent phrase are frequent), longer phrases tell their parts whether they
   subsume them.

The cells grow with the input, as they are rows of a table; what the driver holds is PASS_BITS bits for each sketch row, whatever the input.
Beyond some ten million frequent n-grams these let more n-grams through to the exact count, which stays right.

Edge cases: a null text counts as empty, a null lang is ``und``; repeated rows count each time; an empty table gives no rows; only
text and lang are read, other columns don't matter; texts of any length are counted whole, in slices. Ties of score and count go by the phrase's bytes. Scores
need 1000 * a * n to have at most 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textarrays import Flat, mix, slices, spread

#: Bytes of text whose n-grams are put together before rows are made of them, and n-grams that a task counts before it gives a sketch.
GATHER_BYTES, FLUSH = 4_000_000, 6_000_000
#: Bytes of text for each cell of a sketch row, cells of a chunk, and bits at most of the filters that the tasks get.
BYTES_A_CELL, CHUNK, PASS_BITS = 24, 1 << 14, 1 << 26
#: Phrases that a task holds before it adds them up, and cells of a sketch row for each part that phrases are dealt in.
HELD, CELLS_A_BUCKET = 1_000_000, 1 << 18
_ROW_KEYS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes that end a piece, and bytes that separate words in it.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))
_INSIDE = ~np.isin(np.arange(256), np.frombuffer(ENDS + SPACES, np.uint8))
#: Splits of a language's phrases before its best ones are taken.
SALTS = 64


@dataclass(frozen=True)
class Frequent:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more, and how many of the best are wanted in each language."""

    least: int = 100
    longest: int = 5
    best: int = 2000


class _Words:
    """The words of a slice: where they are, their language, and whether the next words belong to the same piece."""

    def __init__(self, flat: Flat, langs: pa.DictionaryArray):
        self.flat = flat.lower()
        self.starts, self.ends = self.flat.runs(_INSIDE[self.flat.data])
        doc = self.flat.doc_of(self.starts)
        broken = np.concatenate(([0], np.cumsum(_ENDS[self.flat.data])))
        self.piece = broken[self.starts] + doc
        self.names = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[flat.first + doc].astype(np.int64)

    def within(self, k: int) -> np.ndarray:
        """Whether a piece has k words from each place on; shorter by k - 1 than the words."""
        m = max(len(self.piece) - k + 1, 0)
        return self.piece[:m] == self.piece[k - 1 : k - 1 + m]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Hashes of language and k words from each place on, for k from 1 on."""
        word = self.flat.hashes(self.starts, self.ends)
        names = [x.encode() for x in self.names]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64)
        of_lang = Flat(np.frombuffer(b"".join(names), np.uint8), offs, 0).hashes(offs[:-1], offs[1:])
        out = [mix(of_lang[self.lang] + word)]
        for k in range(2, longest + 1):
            m = max(len(word) - k + 1, 0)
            out.append(mix(out[-1][:m] * np.uint64(3) + word[k - 1 : k - 1 + m]))
        return out


class Passed:
    """Which hashes have both cells at the threshold: bitmaps of the merged sketch's full cells, folded to PASS_BITS at most."""

    def __init__(self, bits: list[np.ndarray], cells: int):
        self.bits, self.cells = bits, cells

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, bits in enumerate(self.bits):
            slot = _cells(h, row, self.cells) & (len(bits) * 64 - 1)
            out &= ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(h ^ _ROW_KEYS[row]) & np.uint64(cells - 1)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        langs = batch.column(1)
        langs = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        for flat in slices(batch.column(0), GATHER_BYTES):
            yield _Words(flat, langs)


def _survivors(words: _Words, h: list[np.ndarray], pairs: Passed | None, longer: Passed | None, longest: int) -> list[np.ndarray]:
    """For k from 1 on, whether the k words from each place on can be frequent: they and all shorter n-grams inside them passed."""
    out = [pairs(h[0]) if pairs else np.ones(len(h[0]), bool)]
    for k in range(2, longest + 1):
        before = out[-1]
        can = words.within(k) & before[:-1] & before[1:]
        passed = pairs if k == 2 else longer
        at = np.flatnonzero(can)
        if passed and len(at):
            can[at] = passed(h[k - 1][at])
        out.append(can)
    return out


def _sketch(texts: DataFrame, sizes: range, cells: int, least: int, pairs: Passed | None) -> DataFrame:
    """(row, chunk, at, n): the cells that aren't empty in each task's sketches of n-grams of ``sizes`` words."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)  # two bitmaps of PASS_BITS at most

    def rows(hashes: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for row in range(len(_ROW_KEYS)):
            cell, n = np.unique(_cells(hashes, row, cells), return_counts=True)
            n = np.minimum(n, least).astype("<u4")  # more makes no difference
            edge = np.flatnonzero(np.diff(cell // CHUNK, prepend=-1))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(cell)]):
                out.append((row, int(cell[a]) // CHUNK, (cell[a:b] % CHUNK).astype("<u2").tobytes(), n[a:b].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["row", "chunk", "at", "n"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for words in _slices(batches):
            h = words.hashes(sizes[-1])
            can = _survivors(words, h, shared.value, None, sizes[-1])
            held += [h[k - 1][can[k - 1]] for k in sizes]
            if sum(map(len, held)) >= FLUSH:
                yield rows(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield rows(np.concatenate(held))

    return common.map_arrow(texts, per_task, "row int, chunk bigint, at binary, n binary")


def _merged(sketches: DataFrame, cells: int, least: int) -> Passed:
    """Sum the tasks' sketches chunk by chunk and mark the cells that reach ``least``."""
    bits = min(cells, PASS_BITS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(CHUNK, np.int64)

        def full() -> pa.RecordBatch:
            at = np.flatnonzero(total >= least)
            slot = (key[1] * CHUNK + at) & (bits - 1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0], np.int32)), pa.array(slot)], ["row", "slot"])

        for batch in batches:
            for row, chunk, at, n in zip(*(column.to_pylist() for column in batch.columns)):
                if (row, chunk) != key:
                    if key is not None:
                        yield full()
                    key, total = (row, chunk), np.zeros(CHUNK, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        if key is not None:
            yield full()

    dealt = sketches.repartition("row", "chunk").sortWithinPartitions("row", "chunk")
    slots = common.map_arrow(dealt, sums, "row int, slot bigint")
    # One row for each 64 bits of the filter at most.
    words = slots.groupBy("row", F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("b")).toArrow()
    out = [np.zeros(max(bits // 64, 1), np.uint64) for _ in _ROW_KEYS]
    row = words.column("row").to_numpy()
    for k, target in enumerate(out):
        target[words.column("w").to_numpy()[row == k]] = words.column("b").to_numpy()[row == k].astype(np.uint64)
    return Passed(out, cells)


def _phrases(words: _Words, first: np.ndarray, k: int) -> pa.Array:
    """The k words from each place on, joined by single spaces."""
    which = (first[:, None] + np.arange(k)).ravel()
    starts, lengths = words.starts[which], words.ends[which] - words.starts[which]
    spaced = np.tile(np.arange(k) < k - 1, len(first))
    data = np.concatenate((words.flat.data, np.zeros(1, np.uint8)))[spread(starts, lengths + spaced)]
    ends = np.cumsum(lengths + spaced)
    data[ends[spaced] - 1] = 32
    offsets = np.concatenate(([0], ends[k - 1 :: k])).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _added(parts: list[pa.Table]) -> pa.Table:
    """(lang, phrase, n) with the counts of equal phrases added."""
    return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])


def _exact(texts: DataFrame, pairs: Passed, longer: Passed, longest: int, buckets: int) -> DataFrame:
    """(lang, phrase, k, n): how often each n-gram that passed occurs; k is 0 in the rows of all words of a language.

    A task adds up what it has found and gives it in rows of many phrases, by language and hash; these meet in one task each.
    """
    shared = texts.sparkSession.sparkContext.broadcast((pairs, longer))  # four bitmaps of PASS_BITS at most

    def found(words: _Words) -> Iterator[pa.Table]:
        pairs, longer = shared.value
        can = _survivors(words, words.hashes(longest), pairs, longer, longest)
        number = words.lang * len(words.starts) + words.flat.numbers(words.starts, words.ends)
        names = pa.array(words.names, pa.string())
        lang, n = np.unique(words.lang, return_counts=True)
        yield pa.table({"lang": names.take(pa.array(lang)), "phrase": pa.array([""] * len(lang), pa.string()), "n": pa.array(n, pa.int64())})
        for k in range(1, longest + 1):
            at = np.flatnonzero(can[k - 1])
            if not len(at):
                break
            # Equal numbers of k words: equal numbers of the first and of the last k - 1, which passed too.
            own = number[at] * len(words.starts) + number[at + 1] if k > 1 else number[at]
            _, first, same, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            yield pa.table({"lang": names.take(pa.array(words.lang[at[first]])), "phrase": _phrases(words, at[first], k), "n": pa.array(n, pa.int64())})
            number = np.zeros(len(words.starts), np.int64)
            number[at] = same

    def in_rows(table: pa.Table) -> pa.RecordBatch:
        phrases = table.column("phrase").combine_chunks()
        bucket = np.concatenate([f.hashes(f.offs[:-1], f.offs[1:]) for f in slices(phrases)]) % np.uint64(buckets)
        lang = table.column("lang").combine_chunks().dictionary_encode()
        code = lang.indices.to_numpy()
        order = np.lexsort((bucket, code))
        bucket, code = bucket[order], code[order]
        edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1]))))
        offsets, taken = pa.array(np.append(edge, len(order)).astype(np.int32)), pa.array(order)
        lists = [pa.ListArray.from_arrays(offsets, column.take(taken)) for column in (phrases, table.column("n").combine_chunks())]
        return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code[edge])), pa.array(bucket[edge].astype(np.int64)), *lists], ["lang", "bucket", "phrases", "n"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for words in _slices(batches):
            if len(words.starts):
                held += found(words)
                if sum(map(len, held)) >= HELD:
                    held = [_added(held)]
                    if len(held[0]) >= HELD // 2:
                        yield in_rows(held.pop())
        if held:
            yield in_rows(_added(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def whole() -> Iterator[pa.RecordBatch]:
            table = _added(held)
            k = pc.add(pc.count_substring(table.column("phrase"), " "), pc.not_equal(table.column("phrase"), "").cast(pa.int32()))
            yield from table.add_column(2, "k", k).to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                new = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != new and size >= HELD // 4:
                    yield from whole()
                    held, size = [], 0
                elif size >= HELD:
                    held = [_added(held)]
                    size = len(held[0])
                key = new
                phrases, n = batch.column(2)[i].values, batch.column(3)[i].values
                held.append(pa.table({"lang": pa.repeat(pa.scalar(key[0], pa.string()), len(n)), "phrase": phrases, "n": n}))
                size += len(n)
        if held:
            yield from whole()

    rows = common.map_arrow(texts, per_task, "lang string, bucket bigint, phrases array<string>, n array<bigint>")
    return common.map_arrow(rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket"), merged, "lang string, phrase string, k int, n bigint")


def counts(documents: DataFrame, frequent: Frequent = Frequent()) -> DataFrame:
    """(lang, phrase, k, n) of all n-grams of 1 to ``longest`` words that occur ``least`` times or more in their language, and of all its words (k 0)."""
    texts = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    held = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << max(16, (held // BYTES_A_CELL).bit_length())
    pairs = _merged(_sketch(texts, range(1, 3), cells, frequent.least, None), cells, frequent.least)
    longer = _merged(_sketch(texts, range(3, frequent.longest + 1), cells, frequent.least, pairs), cells, frequent.least)
    found = _exact(texts, pairs, longer, frequent.longest, max(16, cells // CELLS_A_BUCKET)).where((F.col("n") >= frequent.least) | (F.col("k") == 0))
    return common.stage(found, "n-grams")


def scored(counted: DataFrame) -> DataFrame:
    """Candidates of ``counts`` with n, the parts' counts and the score of their weakest cut."""
    known = counted.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    # As many rows as languages; hinted only where they are few.
    totals = counted.where("k = 0").select("lang", F.col("n").alias("all_words"))
    totals = common.broadcast_if_small(totals, totals.count(), 1000)
    cut = counted.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("right"))
    cut = cut.join(known.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "all_words", "l", "r")}
    score = F.expr(f"(cast(1000 * {wide['a']} as decimal(22,0)) * cast(all_words as decimal(16,0))) div ({wide['l']} * {wide['r']})")
    cut = cut.join(totals, "lang").select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r", F.col("all_words").alias("n")).alias("at"))
    return cut.groupBy("lang", "phrase", "a").agg(F.min("at").alias("at")).select("lang", "phrase", "a", "at.l", "at.r", "at.n", "at.score")


def unsubsumed(scored_phrases: DataFrame) -> DataFrame:
    """Without the phrases whose words lie inside a longer one that occurs as often."""
    words = scored_phrases.select("lang", F.col("a").alias("whole"), F.split("phrase", " ").alias("w")).where("size(w) > 2")
    inside = words.select("lang", "whole", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    return scored_phrases.join(inside, ["lang", "phrase"], "left").where("whole IS NULL OR 100 * whole < 100 * a").drop("whole")


def best(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language; each of SALTS parts of a language gives its own first ones before."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(documents: DataFrame, frequent: Frequent = Frequent()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    return best(unsubsumed(common.stage(scored(counts(documents, frequent)), "scored-phrases")), frequent.best)


#: The same rows by plain counting.
SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM placed, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE n >= 100),
cuts AS (SELECT lang, g, n AS a, unnest(range(1, len(g))) AS c FROM often WHERE len(g) > 1),
scores AS (
    SELECT cuts.lang, cuts.g, cuts.a, c, x.n AS l, y.n AS r, totals.n AS n, (1000 * cuts.a::HUGEINT * totals.n::HUGEINT) // (x.n::HUGEINT * y.n::HUGEINT) AS s
    FROM cuts JOIN often x ON x.lang = cuts.lang AND x.g = cuts.g[:c] JOIN often y ON y.lang = cuts.lang AND y.g = cuts.g[c + 1:] JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY s, c) = 1),
free AS (
    SELECT * FROM weakest w WHERE NOT EXISTS (
        SELECT 1 FROM often o WHERE o.lang = w.lang AND len(o.g) > len(w.g) AND 100 * o.n >= 100 * w.a
        AND contains(' ' || array_to_string(o.g, ' ') || ' ', ' ' || array_to_string(w.g, ' ') || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, s::BIGINT AS score FROM free)
SELECT * FROM ranked WHERE rank <= 2000
"""
