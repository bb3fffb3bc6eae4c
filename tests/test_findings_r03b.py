"""Cases of the third round's findings that were still open."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import facts


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def _nodes(spark, seed):
    r = random.Random(seed)
    words = ["rent", "lease", "yield", "debt", "margin", "units", "tenants", "growth"]
    value = lambda: r.choice(["12%", "13 percent", "$4,500", "7 bn", "88", "40 bps", "90 bps"])
    said = lambda: " ".join(r.sample(words, 4)) + " was " + value() + " of " + " ".join(r.sample(words, 3))
    rows = []
    for k in range(160):
        text = r.choice([None, "no figure"]) if r.random() < 0.05 else ". ".join(said() for _ in range(r.randint(1, 3)))
        if k % 40 == 7:
            text += " Apart from that much more was said of units." * 20 if text else ""
        rows.append((k, r.choice(["a", "b", "big", "big", "big", None]), r.choice([f"d{k % 9}", f"d{k}", ""]), r.choice(["One  file", "two", None]), r.choice(["v1", "v2", " ", None]), r.choice([0, 1, 2, None]), text))
    return spark.createDataFrame(rows, "node bigint, version_group string, document_id string, document_name string, version_label string, page_num int, text string").repartition(3)


@pytest.mark.parametrize("few, short", [(256, 500), (0, 500), (10**6, 10**6), (20, 500)])
def test_families_meet_alike_whole_and_by_words(spark, monkeypatch, few, short):
    monkeypatch.setattr(facts, "FEW_FIGURES", few)
    monkeypatch.setattr(facts, "SHORT_TEXT", short)
    nodes = _nodes(spark, 5)
    columns = ["family", "unit", "l_node", "r_node", "l_segment_no", "l_match_no", "r_segment_no", "r_match_no", "l_raw", "r_raw", "overlap", "shared_topics", "signature"]
    listed = lambda rows: sorted(map(repr, map(tuple, rows.select(*columns).collect())))
    want = listed(facts.conflicts(facts.node_facts(nodes, ["node"]), facts.node_topics(nodes), [], "node"))
    assert len(want) > 100 and listed(facts.family_conflicts(nodes, "node")) == want


def test_facts_of_small_families_are_shuffled_once(spark, small):
    from docquarry.plans import ranking

    nodes = ranking.statements(spark, small).where("version_group LIKE 'order %'")
    assert facts.crowded_families(nodes).count() == 0
    made = facts.family_conflicts(nodes, "node_id")
    # Facts aren't dealt by each of their words before they meet, and pairs aren't shuffled to learn their topics.
    few = _plan(made).split("Union")[1].split("Join Inner")
    first = few[1][: few[1].index("MapInArrow")]
    assert "explode" not in first and "l_text_1" not in first
    assert facts.crowded_families(nodes.withColumn("version_group", F.lit("one"))).count() == 1


def test_branches_taken_are_settled_once(spark, small):
    from docquarry.operators import routing
    from docquarry.plans import routed
    from docquarry.sources import tables

    asked, chunks = routed._routed_questions(spark, small), tables.chunks(spark, small)
    made, lazy = routing.routed(asked, chunks), routing.routed(asked, chunks, query_block=1)
    listed = lambda rows: sorted(map(repr, map(tuple, rows.collect())))
    assert listed(made) == listed(lazy) and made.schema == lazy.schema
    # Texts are read for the scores alone once it is known which branch each question takes.
    assert _plan(made).count("regexp_extract_all(lower(coalesce(text") == 1 < _plan(lazy).count("regexp_extract_all(lower(coalesce(text")
