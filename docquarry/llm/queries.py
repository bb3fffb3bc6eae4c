"""Queries of this subpackage's operators over the given tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    collocations,
    exact_dedup,
    fingerprints,
    license_scan,
    mixing,
    ngram_join,
    packing,
    pii_scan,
    quality_rules,
    secret_scan,
    spelling_variants,
    token_files,
    url_filters,
)
from .common import read
from .tokens import vocabulary


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"), mixing.Target(repetitions=2.0))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    samples = secret_scan.ordinary_samples(documents, labels).unionByName(secret_scan.random_samples(documents))
    return secret_scan.digest(secret_scan.scan(documents, secret_scan.train(samples)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality_rules.score(documents, *quality_rules.fit(documents, read(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read(spark, sf_dir, "documents"), ngram_join.Similarity(words=3, percent=90))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.verdicts(read(spark, sf_dir, "pages"))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.digest(pii_scan.scan(read(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(read(spark, sf_dir, "documents"), collocations.Frequent(least=100, longest=5, best=2000))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.report(read(spark, sf_dir, "documents"), spelling_variants.Variants(letters=7, least=2, ratio=10, damaged=31))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filters": op7_url_filters,
    "op8_pii_scan": op8_pii_scan,
    "op9_token_files": op9_token_files,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.SQL, "op11_collocations": collocations.SQL, "op12_spelling_variants": spelling_variants.SQL}
