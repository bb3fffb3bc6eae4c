"""Each stage of the pipeline against brute force on its own input; the registered queries."""

import re
import zlib
from collections import Counter

import numpy as np
from test_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm import common, quality_rules, queries
from docquarry.llm.tokens import vocabulary


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas().set_index("doc_id")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stage(stage(spark, docs, small), name.replace(" ", "-"))
        assert after.columns == columns
        if name == "mixing":
            tokens, taken = Counter(), Counter()
            for r in docs.collect():
                tokens[r.source] += len(r.text.split())
            for r in after.collect():
                taken[r.source] += len(r.text.split())
            assert max(taken[k] / n for k, n in tokens.items()) < 2.1 and abs(sum(taken.values()) / sum(tokens.values()) - 1) < 0.05
        docs = after
        seen.append(docs.toPandas().set_index("doc_id", drop=False))
    start, good, exact, near, mixed = seen

    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = quality_rules.score(spark.read.parquet(f"{small}/documents.parquet"), *quality_rules.fit(spark.read.parquet(f"{small}/documents.parquet"), labels)).toPandas()
    assert set(good.index) == set(scored[scored.kept].doc_id) and 0 < len(good) < len(start)

    groups = {}
    for i, text in good.text.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    assert sorted(exact.index) == sorted(min(g)[1] for g in groups.values())

    ids = sorted(exact.index)
    found = brute_components([exact.text[i] for i in ids], 5, 80)
    assert sorted(near.index) == sorted({ids[root] for _, root in found.values()})
    assert set(mixed.index) <= set(near.index)

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).toPandas()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    times = Counter(mixed.index)
    for i, n in times.items():
        tokens = np.array(library.encode(mixed.text[i] if n == 1 else mixed.text[i].iloc[0], add_special_tokens=False).ids + [1], "<u4")
        mine = pieces[pieces.doc_id == i]
        assert mine.length.sum() == n * len(tokens) and set(mine.doc_tokens) == {len(tokens)}
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(tokens[p.start : p.start + p.length].tobytes())
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_stage_edges(spark, small):
    """Null, empty, repeated and very long texts and clashing names through all stages; then no row at all."""
    prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars > 400").orderBy("doc_id").limit(12).collect()]
    texts = [None, "", *prose, prose[0], prose[1] + " x", " ".join(prose) * 40]
    names = ["row", "slot", "_slot", "a.b", "digest", "fp1", "source_key", "copies"]
    rows = [(i, t, None if i % 3 else "s", *names) for i, t in enumerate(texts)] + [(2, texts[2], "s", *names), (None, prose[3], "s", *names)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for docs in (made, made.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.collect()
            docs = common.stage(stage(spark, docs, small), name.replace(" ", "-"))
            after = docs.collect()
            assert docs.columns == made.columns and {*after} <= {*before}, name
            if name != "mixing":
                assert bool(after) == bool(before), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).agg({"length": "sum"}).first()[0] or not after


def test_registered():
    assert len(queries.QUERIES) == 13 and set(queries.ORACLES) <= set(queries.QUERIES)
