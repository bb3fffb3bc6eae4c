"""what the near-duplicate join leaves on disk."""

import glob
import os
import time

import pyarrow.parquet as pq

from docquarry.llm import common, ngram_join


def test_keys_are_not_written_one_by_one(spark, tmp_path, monkeypatch):
    """Staged tables have a few rows for each document, however many keys its shingles give."""
    texts = [" ".join(f"w{400 * i + k}" for k in range(300)) + f" end{j}" for i in range(40) for j in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    rows = ngram_join.components(docs, ngram_join.Similarity(words=5, percent=80)).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 3 for r in rows)
    largest = max(sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/*.parquet")) for folder in glob.glob(f"{tmp_path}/docquarry-*"))
    assert largest <= 12 * len(texts)


def test_shuffle_files_go_with_the_staged_query(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for folder in local for f in glob.glob(f"{folder}/*/shuffle_*")}
    before = held()
    staged = [common.stage(spark.range(1000).repartition(7, "id"), "shuffled") for _ in range(5)]
    assert sum(s.count() for s in staged) == 5000
    until = time.monotonic() + 20
    while len(held() - before) > 10 and time.monotonic() < until:
        time.sleep(0.2)
    # Counting shuffles one row of each task; those files stay until the driver collects its garbage.
    data = [f for f in held() - before if f.endswith(".data") and os.path.getsize(f) > 1000]
    assert not data
