"""URL filter: rules of host and path, and trust that spreads over links between hosts.

Hosts are nodes; the links in the pages are edges (absolute, protocol-relative, relative to the page or to its ``<base>``; a link
within a host keeps its score there), and so is the tie between a host and the host it is a subdomain of. Trust
starts at hosts with pages that a rule allows and follows links; distrust starts at hosts with blocked pages and goes
against them (a host that links to bad ones is suspect). Both are personalised PageRanks, iterated until no kind's scores
move by more than TOLERANCE in all. A page without a rule gets its host's verdict: blocked when the host's distrust is more
than its trust and more than THRESHOLD times its share of pages.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and is allowed (the empty host is no
node); repeated rows give equal results; without seeds or edges all scores are 0 and all such pages allowed; an empty table
gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values: (verdict, host, path) of each rule.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING, THRESHOLD = 0.85, 1.5
#: Change of all scores of a kind at which iteration stops, and rounds at most: the change is below DAMPING ** MOST_ROUNDS by then.
TOLERANCE, MOST_ROUNDS = 1e-3, 60
#: Rounds between written tables, which cut the lineage.
WRITE_EVERY = 4
#: Links and base addresses as they stand in a page.
LINK = r"""(?i)<(?:a|area|link)\b[^<>]*?\bhref\s*=\s*["']?\s*([^\s"'<>]*)"""
BASE = r"""(?i)<base\b[^<>]*?\bhref\s*=\s*["']?\s*([^\s"'<>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and its verdict; the longest rule wins."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(at + begin)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def link_host(link: Column, own: Column) -> Column:
    """The host that a link leads to from a page of host ``own``; empty for what is no place, such as mail addresses."""
    return (
        F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*://"), host_of(link))
        .when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link)))
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(""))
        .otherwise(own)
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links by host, and one tie each way between a host and its parent host."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = pages.select(host_of(F.col("url")).alias("src"), F.regexp_extract(html, BASE, 1).alias("base"), F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("links"))
    found = found.select("src", link_host(F.col("base"), F.col("src")).alias("base"), F.explode("links").alias("link"))
    links = found.select("src", link_host(F.col("link"), F.col("base")).alias("dst")).where("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))
    hosts = pages.select(host_of(F.col("url")).alias("src")).distinct()
    parents = hosts.select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst")).where("src <> '' AND instr(dst, '.') > 0")
    ties = parents.unionByName(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(ties.withColumn("links", F.lit(1).cast("bigint"))).groupBy("src", "dst").agg(F.sum("links").alias("links"))


@dataclass(frozen=True)
class Ranks:
    """``scores`` (host, trust, distrust), the rounds taken, and by how much the scores of a kind still moved in the last."""

    scores: DataFrame
    rounds: int
    residual: float

    @property
    def error(self) -> float:
        """Bound on the sum of all errors of a kind's scores."""
        return self.residual * DAMPING / (1 - DAMPING)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> Ranks:
    """Personalised PageRank of both kinds. ``seeds`` has host, trust, distrust: how much of each starts there."""
    kinds = F.array(F.lit("trust"), F.lit("distrust"))
    both = edges.select(F.explode(kinds).alias("kind"), "src", "dst", "links")
    forward = F.col("kind") == "trust"
    both = both.select("kind", F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"), "links")
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    weighted = common.stage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all_links")).alias("share")), "host-edges")

    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("amount")) for k in ("trust", "distrust")))).alias("s"))
    start = start.select("host", "s.kind", "s.amount").where("amount > 0")
    total = start.groupBy("kind").agg(F.sum("amount").alias("whole"))
    start = common.stage(start.join(total, "kind").select("kind", "host", (F.col("amount") / F.col("whole")).alias("seed")), "host-seeds")

    ranks = start.select("kind", "host", F.col("seed").alias("score"))
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), F.lit(0.0).alias("before"))
    rounds, residual, staged = 0, 1.0, None
    while rounds < most_rounds and residual > tolerance:
        for _ in range(min(WRITE_EVERY, most_rounds - rounds)):
            moved = weighted.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
            moved = moved.select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"), F.lit(0.0).alias("before"))
            earlier = ranks.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
            changed = moved.unionByName(base).unionByName(earlier).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
            ranks = changed.select("kind", "host", "score")
            rounds += 1
        written = common.stage(changed, "host-ranks")
        moved_by = written.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("d")).agg(F.max("d")).first()[0]
        residual, ranks = moved_by or 0.0, written.select("kind", "host", "score")
        common.discard(staged)
        staged = written
    pick = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)), 9).alias(kind)
    return Ranks(ranks.groupBy("host").agg(pick("trust"), pick("distrust")), rounds, residual)


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and its host's trust and distrust."""
    judged = ruled(pages, rules)
    amount = lambda what: F.sum(F.when(F.col("verdict") == what, 1).otherwise(0))
    seeds = judged.where("rule IS NOT NULL").groupBy("host").agg(amount("allow").alias("trust"), amount("block").alias("distrust"))
    sizes = judged.groupBy("host").agg(F.count("*").alias("pages"))
    whole = pages.count()
    scores = sizes.join(propagate(host_edges(pages), seeds).scores, "host").withColumn("share", F.col("pages") / F.lit(float(max(whole, 1))))
    scores = common.stage(scores.drop("pages"), "host-scores")
    hosts = scores.count()
    scored = judged.join(common.broadcast_if_small(scores, hosts), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when((distrust > trust) & (distrust > threshold * F.col("share")), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
