"""Plug-ins, files and the series of evidence rules."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.operators import evidence, models
from docquarry.sources import files


def ranked(spark, groups, labels, cap):
    rows = [(1, n, n, labels, cap, g, f"p{n}", f"v{n % 2}") for n, g in enumerate(groups, 1)]
    return spark.createDataFrame(rows, "qid bigint, node_id bigint, rank bigint, labels string, cap int, document string, page string, version string")


def chosen(df):
    return [r.node_id for r in evidence.select_evidence(df).orderBy("place").collect()]


def test_evidence(spark):
    assert chosen(ranked(spark, "aaaaab", "", 4)) == [1, 2, 3, 4]
    assert chosen(ranked(spark, "aaaaabb", "outlook_scope", 4)) == [1, 2, 7, 6] or set(chosen(ranked(spark, "aaaaabb", "outlook_scope", 4))) == {1, 2, 6, 7}
    assert set(chosen(ranked(spark, "aaabc", "corpus_wide_scope", 3))) == {1, 4, 5}
    many = chosen(ranked(spark, "abcdefgh" * 4, "corpus_wide_scope,balanced_scope,temporal_delta", 6))
    assert len(many) == len(set(many)) == 6


@pytest.mark.parametrize(
    "question, labels, cap, rows, want",
    [
        ("compare alpha and beta", "", 3, [{"document_name": f"{n} report.pdf"} for n in ("alpha",) * 3 + ("beta",) * 2], [1, 2, 4]),
        ("", "outlook_scope", 3, [{"text": t} for t in ("a", "b", "c", "Pro forma", "a merger", "combined")], [6, 5, 4]),
        ("customers caveat", "caveat_inconsistency", 2, [{"text": t} for t in ("5,000 customers", "x", "y", "5,500 customers")], [1, 4]),
        ("show the table", "", 2, [{"chunk_type": t} for t in ("body_text",) * 3 + ("full_table",)], [1, 4]),
        ("how many customers", "", 2, [{"text": t, "version_rank": n} for n, t in enumerate(("x", "y", "900 customers", "950 customers"))], [1, 4]),
        ("how many customers", "", 4, [{"text": t, "version_rank": n} for n, t in enumerate(("x", "y", "900 customers", "950 customers"))], [4, 1, 2, 3]),
        ("show the image", "", 3, [{"images": n > 2} for n in range(5)], [1, 5, 4]),
        ("", "", 4, [{"version": v} for v in "aaaabb"], [1, 2, 6, 5]),
        ("alpha yield", "", 6, [{"version": v, "document_name": n} for v, n, k in (("1", "gamma.pdf", 2), ("2", "delta.pdf", 2), ("3", "alpha north.pdf", 3), ("4", "alpha south.pdf", 3)) for _ in range(k)], [10, 9, 8, 7, 5, 6]),
        ("", "", 8, [{"document": v} for v in "a" * 8 + "b" * 4], [1, 2, 3, 4, 12, 11, 10, 9]),
        ("", "", 8, [{"document": v} for v in "a" * 8 + "bbbc"], [1, 2, 3, 4, 5, 6, 7, 8]),
        ("is there a conflict", "", 1, [{"text": t} for t in ("none", "5 units")], [2]),
        ("yield", "", 1, [{"chunk_type": t} for t in ("reasoning_page", "body_text")], [2]),
        ("", "caveat_inconsistency", 2, [{"page": "1", "document": "d"}] * 3 + [{"page": "2"}], [1, 4]),
    ],
)
def test_each_evidence_rule(spark, question, labels, cap, rows, want):
    usual = {"document": "d", "page": "1", "version": "v", "text": "", "document_name": "", "chunk_type": "body_text", "version_rank": 1, "images": False}
    made = [(1, n, n, labels, cap, question, 1.0 / n, *(usual | r).values()) for n, r in enumerate(rows, 1)]
    schema = "qid bigint, node_id bigint, rank bigint, labels string, cap int, question string, score double, document string, page string, version string, text string, document_name string, chunk_type string, version_rank bigint, images boolean"
    assert chosen(spark.createDataFrame(made, schema)) == want


def test_blend_and_variants(spark):
    rows = spark.createDataFrame([(1, "red fox", "the red fox", 0.1, 1), (1, "red fox", "blue", 0.9, 2), (1, "red fox", "red", 0.5, 3)], "qid bigint, question string, text string, score double, node_id bigint")
    assert [r.node_id for r in models.blended(rows, ["qid"]).orderBy("rank").collect()] == [2, 3, 1]
    made = models.variants(spark.createDataFrame([(1, "Red  fox")], "qid bigint, question string"), lambda qs: [["red fox", "a fox", "b fox", "c"] for _ in qs])
    assert [r.query for r in made.orderBy("variant_no").collect()] == ["Red fox", "a fox", "b fox"]
    v = rows.select(models.embed(F.col("text")).alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_agent_loop(spark):
    questions = spark.createDataFrame([(1,), (2,)], "qid bigint")

    def search(open_, k):
        return open_.select("qid", (F.col("qid") * 10 + k).alias("node_id"), F.lit(1.0).alias("score")).unionByName(open_.select("qid", F.lit(99).cast("bigint").alias("node_id"), F.lit(0.5).alias("score")))

    enough = lambda seen: seen.groupBy("qid").agg(F.count("*").alias("n")).where((F.col("n") >= 3) | (F.col("qid") == 1))
    got = sorted((r.qid, r.node_id, r.pass_no) for r in models.agent_loop(questions, search, enough).collect())
    assert got == [(1, 10, 0), (1, 99, 0), (2, 20, 0), (2, 21, 1), (2, 99, 0)]


def test_files(spark, tmp_path):
    for name, body in (("a.txt", b"hello"), ("b.md", b"# x"), ("c.exe", b"x"), ("d.txt", b""), ("e.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.md", "e.pdf"} and got["a.txt"].text == "hello" and got["e.pdf"].error.startswith("plain")
    with pytest.raises(ValueError):
        files.read_documents(spark, str(tmp_path), "none such")


def test_questions(spark, tmp_path):
    lines = [json.dumps({"id": 2, "question": "b"}), "", "{bad", json.dumps({"question": "x"}), json.dumps({"id": 1, "question": " "})]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    rows, stats = files.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [r.id for r in rows.collect()] == [2] and tuple(stats.first()) == (4, 1, 1, 1)
    files.write_sorted(rows.unionByName(rows.withColumn("id", F.lit(1).cast("bigint"))), str(tmp_path / "out"), "id")
    assert [r.id for r in files.read_strict(spark, str(tmp_path / "out"), files.QUESTION).orderBy("id").collect()] == [1, 2]
