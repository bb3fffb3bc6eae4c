"""Approximate search by its recall, routes by their branches, collections by what they refuse, keep and leave untouched."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import cells, retrieval, routing
from docquarry.plans import search
from docquarry.sources import collections as C


def recall(got, want):
    exact = {}
    for r in want:
        exact.setdefault(r.qid, set()).add(r.node_id)
    found = {}
    for r in got:
        found.setdefault(r.qid, set()).add(r.node_id)
    return sum(len(found.get(q, set()) & w) for q, w in exact.items()) / sum(map(len, exact.values()))


def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.1"
    assert recall(search.cells_topk(spark, d).collect(), search.dense_topk(spark, d).collect()) >= 0.95


def test_recall_and_probes_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 16))
    made = [(i, (middle[i % 40 if i % 3 else 0] + 0.3 * rng.normal(size=16)).tolist()) for i in range(4000)]  # a third in one cluster
    held = spark.createDataFrame([*made, (9999, None)], "node_id bigint, embedding array<float>")
    asked = held.where("node_id % 50 = 0").withColumnRenamed("node_id", "qid")
    fitted = cells.fit(held, 10, sample=1000)
    assert len(fitted.centres) == 63 and fitted.probes < 32
    indexed = cells.index(held, fitted)
    assert indexed.count() == 4000  # every vector is in a cell
    exact = retrieval.dense_topk(asked, held, 10).collect()
    for sizes in ({}, {"query_block": 7, "vector_block": 50}):
        got = cells.search(asked, indexed, fitted, 10, **sizes).collect()
        assert recall(got, exact) >= 0.95 and {(r.qid, r.rank) for r in got} == {(r.qid, r.rank) for r in exact}
    whole = cells.Cells(fitted.centres, len(fitted.centres))
    assert recall(cells.search(asked, indexed, whole, 10).collect(), exact) == 1.0


def test_cells_of_nothing(spark):
    held = spark.createDataFrame([(1, None)], "node_id bigint, embedding array<float>")
    fitted = cells.fit(held)
    assert cells.search(held.withColumnRenamed("node_id", "qid"), cells.index(held, fitted), fitted, 3).collect() == []


def test_routes_take_the_next_branch(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "alpha gamma")], "node_id bigint, text string")
    rows = [
        (1, "alpha and gamma", "decomposed", ["beta", "delta", "BETA ", " "], ["x"]),
        (2, "alpha", "decomposed", ["nowhere"], ["delta"]),
        (3, "alpha", "decomposed", None, None),
        (4, "alpha", "expanded", ["beta"], ["gamma", "Alpha"]),
        (5, "delta", "direct", ["beta"], ["gamma"]),
        (6, "nothing", "expanded", ["no"], ["none"]),
    ]
    asked = spark.createDataFrame(rows, "qid int, question string, strategy string, parts array<string>, rewrites array<string>")
    got = {}
    for r in routing.routed(asked, chunks).collect():
        got.setdefault(r.qid, []).append((r.rank, r.node_id, r.strategy, r.fallback, r.origins))
    assert [x[1:] for x in sorted(got[1])] == [(1, "decomposed", None, "0"), (2, "decomposed", None, "1")]
    assert {x[2:4] for x in got[2]} == {("expanded", "empty")} and {x[1] for x in got[2]} == {1, 2, 3}
    assert {x[2:4] for x in got[3]} == {("direct", "failed")} and {x[1] for x in got[3]} == {1, 3}
    assert {x[2:4] for x in got[4]} == {("expanded", None)} and dict((x[1], x[4]) for x in got[4])[3] == "0,1"
    assert [x[1:] for x in got[5]] == [(2, "direct", None, "0")] and 6 not in got


def points(spark, ids, size=3):
    return spark.createDataFrame([(f"c{i % 5}", i, [float(i)] * size, {"t": 1.0}, json.dumps({"document_id": f"d{i}", "odd": {"é": [1, None]}})) for i in ids], "client_id string, point_id bigint, dense array<float>, sparse map<string,double>, payload string")


def test_collections_refuse_other_sizes_and_append_once(spark, tmp_path):
    path = f"{tmp_path}/c"
    made = C.Collection.open(spark, path, 3)
    assert made.index(points(spark, range(20))) == 20 and made.index(points(spark, range(10, 30))) == 10 and made.index(points(spark, range(30))) == 0
    assert made.points().count() == 30 and {r.point_id for r in made.points("c2").collect()} == set(range(2, 30, 5))
    with pytest.raises(ValueError):
        made.index(points(spark, [100]).unionByName(points(spark, [101], 4)))
    assert made.points().count() == 30  # nothing of a refused batch is there
    with pytest.raises(ValueError):
        C.Collection.open(spark, path, 4)
    again = C.Collection.open(spark, path, 3, hybrid=False)
    assert again.hybrid and again.points("c9").count() == 0
    plan = made.points("c2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    dense_only = C.Collection.open(spark, f"{tmp_path}/d", 3, hybrid=False)
    dense_only.index(points(spark, range(3)))
    assert dense_only.points().where("sparse IS NOT NULL").count() == 0 and dense_only.registry("m").count() == 3


def test_patches_rewrite_touched_buckets_only(spark, tmp_path):
    made = C.Collection.open(spark, f"{tmp_path}/c", 3)
    made.index(points(spark, range(40)))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path).glob("c/points/bucket=*/*.parquet")}
    before = files()
    patch = spark.createDataFrame([("c1", 6, "screenshot", '{"path": "a.png"}'), ("c1", 11, "page", "7"), ("c1", 999, "page", "7")], "client_id string, point_id bigint, field string, value string")
    assert made.patch(patch) == 2
    after = files()
    bucket = made.spark.range(1).select(C.bucket_of(F.lit("c1")).alias("b")).first().b
    changed = {p for p in before if p not in after or before[p] != after[p]}
    assert changed and all(f"bucket={bucket}/" in p for p in changed) and made.points().count() == 40
    got = {r.point_id: json.loads(r.payload) for r in made.points("c1").collect()}
    assert got[6] == {"document_id": "d6", "odd": {"é": [1, None]}, "screenshot": {"path": "a.png"}} and got[11]["page"] == 7 and "page" not in got[1]
    assert made.patch(patch) == 0 and files() == after  # a second run changes nothing
