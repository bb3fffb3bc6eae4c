"""Spelling variants: words that differ by one letter inserted, deleted or replaced, each led to the much more frequent form.

The near pairs come from an errata trie over all words, whose nodes are rows. Every node's heavy edge leads to the child with most words; all
other edges are light, so a word passes a light edge at most log2(words) times. At each light edge, and only there, the light subtree
is merged into the node's other subtrees with one letter skipped or replaced:

* the letter replaced by the heavy one, the letter skipped, the heavy one put before it: the merged terminal is a word of all words or none;
* the letter replaced by another light one: terminals of the node's light subtrees that coincide behind the letter;
* a word that ends at a node meets the one that goes on with the heavy letter alone.

Two words one edit apart part at one node; at least one of them goes on by a light edge there or ends, so each pair is found, once. No
node's words are gathered: terminals coincide in groups no larger than the alphabet. A node is known by a hash of its letters; that decides
which edge counts as heavy, so a collision only moves cost. Nodes nearest to the root, which hold most words, are at most 8,191 and are broadcast;
joins with deeper ones leave uneven keys to the engine's splitting.

Edge cases: a null text has no words, a null doc_id counts as an empty string; repeated rows count each time; an empty table gives no rows; only
doc_id and text are read; words of any length are compared whole. Forms with equal counts go by code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textarrays import Flat, mix, slices, spread

GATHER_BYTES = 4_000_000
#: Nodes of fewer letters than this are few: 1 + 90 + 90 * 90 with the 90 letters that words can have.
BROADCAST_DEPTH = 3
#: Runs longer than this are hashed one by one.
LONG = 256
_LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


@dataclass(frozen=True)
class Variants:
    """Words of ``letters`` code points and ``least`` occurrences at least; a form is ``ratio`` times as frequent as its variants."""

    letters: int = 7
    least: int = 2
    ratio: int = 10
    #: One occurrence of this many loses a letter, chosen by its hash: planted misspellings.
    damaged: int = 31


def _crc_after(flat: Flat, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each range of bytes, going on from the crc32 ``before`` it."""
    order = np.argsort(starts - ends, kind="stable")
    at, lengths = starts[order], (ends - starts)[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    short = int(np.searchsorted(-lengths, -LONG))
    for i in range(short):
        piece = flat.data[at[i] : at[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(piece, int(before[order[i]])) ^ 0xFFFFFFFF
    for j in range(min(int(lengths[short]), LONG) if short < len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -j))
        state[short:m] = _CRC[(state[short:m] ^ flat.data[at[short:m] + j]) & np.uint32(255)] ^ (state[short:m] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words(documents: DataFrame, how: Variants = Variants()) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for flat in slices(batch.column(1), GATHER_BYTES):
                flat, raw = flat.lower(), flat.data
                lead = raw == 0xC3  # of U+00C0 to U+00FF, and of no other code point
                starts, ends = flat.runs(_LETTER[raw] | lead | np.concatenate(([False], lead[:-1])))
                chars = flat.chars()
                long = chars[ends] - chars[starts] >= how.letters
                starts, ends = starts[long], ends[long]
                length = chars[ends] - chars[starts]
                of_id = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[flat.first : flat.first + flat.n]], np.uint32)
                h = _crc_after(flat, starts, ends, of_id[flat.doc_of(starts)])
                hit = h % how.damaged == 0
                damaged: Counter[str] = Counter()
                for a, b, at in zip(starts[hit].tolist(), ends[hit].tolist(), (h[hit] % length[hit]).tolist()):
                    word = flat.data[a:b].tobytes().decode()
                    if len(word) > how.letters:
                        damaged[word[:at] + word[at + 1 :]] += 1
                starts, ends = starts[~hit], ends[~hit]
                _, first, n = np.unique(flat.numbers(starts, ends), return_index=True, return_counts=True)
                lengths = (ends - starts)[first]
                data = flat.data[spread(starts[first], lengths)]
                found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(damaged), pa.string()), pa.array(list(damaged.values()), pa.int64())], ["word", "n"])

    counted = common.map_arrow(documents.select("doc_id", "text"), per_task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return common.stage(counted.where(F.col("n") >= how.least), "words")


def _steps(vocabulary: DataFrame) -> DataFrame:
    """(id, depth, node, letter): each word's way through the trie, by hashes of what it has passed; the letter is -1 where it ends."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for flat in slices(batch.column(1)):
                # Code points of all words as numbers, with a place for each word's end.
                lead = flat.data == 0xC3
                keep = np.flatnonzero(~np.concatenate(([False], lead[:-1])))
                letter = flat.data[keep].astype(np.int64)
                two = lead[keep]
                letter[two] = 0xC0 + (flat.data[keep[two] + 1].astype(np.int64) & 0x3F)
                length = np.bincount(flat.doc_of(keep), minlength=flat.n)
                begin = np.cumsum(length + 1) - length - 1
                total = int(length.sum()) + flat.n
                all_letters = np.full(total, -1, np.int64)
                all_letters[spread(begin, length)] = letter
                depth = np.arange(total) - np.repeat(begin, length + 1)
                # A node's hash is the sum of its letters' hashes, each mixed with its place.
                value = mix(all_letters.astype(np.uint64) + mix(depth.astype(np.uint64)))
                before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)[:-1]))
                node = mix(before - np.repeat(before[begin], length + 1) + depth.astype(np.uint64))
                own = ids.take(pa.array(np.repeat(np.arange(flat.n) + flat.first, length + 1)))
                yield pa.RecordBatch.from_arrays([own, pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(all_letters.astype(np.int32))], ["id", "depth", "node", "letter"])

    return common.map_arrow(vocabulary, per_task, "id struct<a: bigint, b: bigint>, depth int, node bigint, letter int")


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, near): each pair of ``counted`` (word, n) that is one edit apart, once."""
    named = counted.select(F.struct(F.xxhash64("word").alias("a"), F.xxhash64(F.lit(7), "word").alias("b")).alias("id"), "word")
    steps = common.stage(_steps(named), "trie-steps")
    edges = steps.where("letter >= 0").groupBy("depth", "node", "letter").agg(F.count("*").alias("c"))
    heavy = edges.groupBy("depth", "node").agg(F.max_by("letter", F.struct("c", "letter")).alias("heavy"))
    heavy = common.stage(heavy, "trie-nodes")
    top, rest = F.col("depth") < BROADCAST_DEPTH, F.col("depth") >= BROADCAST_DEPTH
    light = [steps.where(part).join(nodes, ["depth", "node"]).where("letter <> heavy").select("id", "depth", "heavy") for part, nodes in ((top, F.broadcast(heavy.where(top))), (rest, heavy.where(rest)))]
    light = light[0].unionByName(light[1]).join(named, "id").drop("id")
    # substring counts from 1; ``depth`` letters lie before the edge.
    parts = light.select("word", F.expr("substring(word, 1, depth)").alias("p"), F.expr("substring(word, depth + 1, 1)").alias("c"), F.expr("substring(word, depth + 2)").alias("s"), F.char("heavy").alias("h"))
    parts = common.stage(parts, "light-edges")
    made = F.expr("""filter(array(
        if(c <> '', concat(p, h, s), null),
        if(c <> '' and substring(s, 1, 1) <> c, concat(p, s), null),
        concat(p, h, c, s)), x -> x is not null)""")
    to_all = parts.select("word", F.explode(made).alias("near")).join(counted.select(F.col("word").alias("near")), "near")
    # Light subtrees of one node, their letters left out: as many terminals coincide as there are letters, at most.
    groups = parts.where("c <> ''").groupBy("p", "s").agg(F.collect_list("c").alias("cs")).where("size(cs) > 1")
    pairs = groups.select("p", "s", "cs", F.explode("cs").alias("c")).select("p", "s", "c", F.explode(F.expr("filter(cs, x -> x > c)")).alias("d"))
    among = pairs.select(F.concat("p", "c", "s").alias("word"), F.concat("p", "d", "s").alias("near"))
    return to_all.select("word", "near").unionByName(among)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) end. Each round doubles the way; counts grow tenfold a step, so ways are short."""
    ends = common.stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.stage(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.discard(ends)
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        ends = common.stage(moved.drop("moved"), "forms")
        common.discard(moved)


def groups(counted: DataFrame, how: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``counted`` (word, n)."""
    pairs = near_pairs(counted)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    known = counted.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = both.join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    found = counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.rank")).alias("best_n"), F.col("best.form").alias("form"))
    better = F.col("best_n") >= how.ratio * F.col("n")
    found = common.stage(found.select("word", F.when(better, F.col("form")).alias("form"), "n", "n_near", F.when(better, F.col("best_n")).alias("form_n")), "variants")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(documents: DataFrame, how: Variants = Variants()) -> DataFrame:
    return groups(words(documents, how), how)


#: The same rows by words with each of their letters left out, and crc32 as a fold over bytes.
SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
    SELECT doc_id, run, n, xor(list_reduce(list_transform(range(1, length(digits), 2), lambda i: ('0x' || digits[i:i + 1])::BIGINT),
        lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT), 4294967295) AS h FROM long),
made AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[1:i - 1] AS p, word[i + 1:] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON words.word = cut.p || cut.s),
pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.p = y.p AND x.s = y.s AND x.word <> y.word
          UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-words.n, b)) AS best, max(words.n) AS best_n FROM pairs JOIN words ON words.word = b GROUP BY a),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
way AS (SELECT word, word AS last, 0 AS steps FROM found UNION ALL SELECT way.word, found.form, steps + 1 FROM way JOIN found ON found.word = way.last WHERE found.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, steps) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""
