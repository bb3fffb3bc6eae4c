"""Body texts cut to chunks: by sentences under a budget of tokens, by windows of tokens, and where the subject changes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import semantic_breaks

#: Tokens of a chunk and of the overlap with the one before.
BUDGET, OVERLAP = 600, 40
#: Sentences before and behind that are embedded with each one, and the share of a document's distances above which it is cut.
BUFFER, BREAK_SHARE = 1, 0.95
#: A word, and a sentence: up to marks that white space follows, or a line's end.
WORD = r"[^ \t\n\r\f\x0B]+"
SENTENCE = r"(?:[^.!?\n]|[.!?]+[^.!? \t\n\r\f\x0B])+[.!?]*[ \t\n\r\f\x0B]*|[.!?\n]+[ \t\n\r\f\x0B]*"
_WORD, _SENTENCE = re.compile(WORD), re.compile(SENTENCE)

Spans = Callable[[str], list[tuple[int, int]]]
Embedder = Callable[[list[str]], np.ndarray]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word begins and ends: a stand-in for a tokenizer's offsets."""
    return [m.span() for m in _WORD.finditer(text)]


def windows(n: int, budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, end) of windows over ``n`` tokens; the last one ends with the last token."""
    step = max(1, budget - overlap)
    for first in range(0, max(n, 1), step):
        yield first, min(first + budget, n)
        if first + budget >= n:
            return


def body_chunks(text: str, budget: int = BUDGET, overlap: int = OVERLAP, spans: Spans = word_spans) -> Iterator[tuple[str, int, str]]:
    """(kind, tokens, text) of a text's chunks.

    A text within the budget stays whole. Sentences are put together while they fit; the next chunk begins with the last sentences of
    this one that together have no more tokens than the overlap, where the sentence after them still fits. A sentence over the
    budget alone is cut by windows.
    """
    whole = len(spans(text))
    if whole <= budget:
        yield "whole", whole, text
        return
    sentences = _SENTENCE.findall(text)
    sizes = [len(spans(s)) for s in sentences]
    first = 0
    while first < len(sentences):
        if sizes[first] > budget:
            tokens = spans(sentences[first])
            for a, b in windows(len(tokens), budget, overlap):
                yield "window", b - a, sentences[first][tokens[a][0] : tokens[b - 1][1]]
            first += 1
            continue
        end, total = first, 0
        while end < len(sentences) and total + sizes[end] <= budget:
            total, end = total + sizes[end], end + 1
        yield "sentences", total, "".join(sentences[first:end]).strip(" \t\n\r\f\x0b")
        if end == len(sentences):
            return
        begin, shared = end, 0
        while begin - 1 > first and shared + sizes[begin - 1] <= overlap and shared + sizes[begin - 1] + sizes[end] <= budget:
            begin, shared = begin - 1, shared + sizes[begin - 1]
        first = begin


def sentence_chunks(rows: DataFrame, key: str, text: str, budget: int = BUDGET, overlap: int = OVERLAP, spans: Spans = word_spans) -> DataFrame:
    """(key, chunk_no, kind, tokens, body) of each text; no shuffle. A null text counts as empty and is one whole chunk of no tokens."""
    source = rows.select(key, text)
    schema = T.StructType([source.schema[key], *T._parse_datatype_string("chunk_no bigint, kind string, tokens bigint, body string").fields])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1).to_pylist()):
                made = list(body_chunks(value or "", budget, overlap, spans))
                kind, tokens, body = zip(*made)
                columns = [batch.column(0).take(pa.array([i] * len(made))), pa.array(range(len(made)), pa.int64()), pa.array(kind, pa.string()), pa.array(tokens, pa.int64()), pa.array(body, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(per_task, schema)


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` words of a text as they stand, without white space behind them; shorter texts as they are."""
    space = r"[ \t\n\r\f\x0B]"
    cut = F.regexp_extract(text, rf"^(?:{space}*+[^ \t\n\r\f\x0B]++){{{most}}}", 0)
    return F.when(F.lit(most <= 0) | text.isNull(), "").when(F.regexp_count(text, F.lit(WORD)) <= most, text).otherwise(cut)


def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in for an embedding model: how often each letter of a to z occurs, in either case."""
    out = np.zeros((len(texts), 26))
    for i, text in enumerate(texts):
        n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
        out[i] = n[65:91] + n[97:123]
    return out


def sentence_distances(rows: DataFrame, key: str, text: str, embed: Embedder = letter_counts, buffer: int = BUFFER) -> DataFrame:
    """(key, sentence_no, sentence, distance): each sentence of a text and how far it, with its neighbours, is from the one before.

    Sentences are embedded text by text with ``buffer`` of them on each side; the distance is 1 less the cosine (1 where a vector is
    0), null for the first. Texts without a sentence give no row.
    """
    source = rows.select(key, text)
    schema = T.StructType([source.schema[key], *T._parse_datatype_string("sentence_no bigint, sentence string, distance double").fields])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1).to_pylist()):
                own = _SENTENCE.findall(value or "")
                if not own:
                    continue
                vectors = np.asarray(embed(["".join(own[max(k - buffer, 0) : k + buffer + 1]) for k in range(len(own))]), np.float64)
                lengths = np.sqrt((vectors**2).sum(1))
                scale = lengths[:-1] * lengths[1:]
                distance = 1 - np.where(scale > 0, (vectors[:-1] * vectors[1:]).sum(1) / np.where(scale > 0, scale, 1), 0)
                columns = [batch.column(0).take(pa.array([i] * len(own))), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string()), pa.array([None, *np.round(distance, 9).tolist()], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(per_task, schema)


def semantic_chunks(rows: DataFrame, key: str, text: str, embed: Embedder = letter_counts, share: float = BREAK_SHARE) -> DataFrame:
    """(key, part, sentences, body): a text's sentences, a new part where the subject moves more than at ``share`` of its sentences."""
    parts = semantic_breaks(sentence_distances(rows, key, text, embed), [key], "sentence_no", "distance", share)
    made = parts.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s"))
    return made.select(key, F.col("part").cast("bigint").alias("part"), F.size("s").cast("bigint").alias("sentences"), F.array_join(F.transform("s", lambda x: x["sentence"]), "").alias("body"))
