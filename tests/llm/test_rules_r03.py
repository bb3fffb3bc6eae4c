"""Cases of the third round's findings on corpus operators."""

from docquarry.llm import url_filters


def test_each_rule_has_the_word_of_its_contract(spark):
    hosts = {"a.com/en/1": ("com/en/", "block"), "a.example.com/en/70": ("example.com/en/7", "allow"), "a.net/de/1": ("net/de/", "allow"), "b.example.net/de/80": ("example.net/de/8", "block"), "a.org/es/1": ("org/es/", "block")}
    pages = [(k, f"http://{place}", "") for k, place in enumerate(hosts)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.verdicts(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == dict(enumerate(hosts.values()))
