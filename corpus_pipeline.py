"""A corpus pipeline of five stages: quality rules, exact and near duplicates, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives documents' columns; the last one
gives the pieces of the packed sequences.

A null text counts as empty. All columns pass through the stages untouched, whatever their names, up to packing, which reads doc_id and
text only. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import common, exact_dedup, mixing, ngram_join, packing, quality_rules
from docquarry.llm.tokens import vocabulary

#: Near duplicates are texts whose shingles of five words have a similarity of 0.8 or more.
NEAR = ngram_join.Similarity(words=5, percent=80)
#: No source is repeated more than twice, within the tokens that the stage was given.
MIX = mixing.Target(repetitions=2.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; repeated rows share a verdict; a text is judged whole
    at any length; without labels only the base rule rejects."""
    return quality_rules.kept_rows(docs, *quality_rules.fit(docs, common.read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then the smallest doc_id. All null and empty
    texts are one group; of rows alike in doc_id and text one stays; a null doc_id counts as larger than all others."""
    return exact_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id. Texts without words and rows without a doc_id
    stay; rows that share a doc_id are judged each by its own text."""
    return ngram_join.one_of_each(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is one of its own; texts without words go with their
    block; of a source without words no document is taken."""
    return mixing.mixed(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null or empty text is its end id alone; each repeated row is packed; a long text fills sequences
    of its own."""
    return packing.report(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL can't express the models, tokens and trees of these stages; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each one's result written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
