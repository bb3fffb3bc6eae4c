"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order models over the characters that keys are made of, one of random strings and one of ordinary identifiers,
are trained from labelled samples: random strings in the writings of keys, against words, identifiers, paths, dates, numbers and
addresses formed from labelled documents. A part of both is held out; it sets the threshold and gives precision and recall. A long
unbroken run whose log-likelihood ratio per transition is above the threshold
is a span of kind ``random``. Everything runs as DataFrame functions; only the two tables of bigram counts, whose size the
alphabet fixes, reach the driver.

Edge cases: a null text counts as empty and gives zero counts and an empty span list; repeated rows give repeated results;
an empty table gives an empty result; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import spans as S

#: Characters of key-like strings; the base patterns.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

#: Shortest run that the models judge.
MIN_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+"
#: Labelled documents whose words train the model of ordinary identifiers, and random strings drawn, at most.
MAX_LABELLED, RANDOM_STRINGS = 4_000, 6_000
#: Words of a labelled document that identifiers are formed from.
WORDS_EACH = 12
#: Share of held-out random strings that the threshold may miss.
MISSED = 0.005


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio of each bigram (row-major over ALPHABET) and the least ratio per transition of a secret."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a string's transitions."""
        n = len(ALPHABET)
        # Long runs are judged by all their transitions; the literal table is folded once, not per row.
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")
        code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - F.lit(1))
        code = F.filter(code, lambda x: x >= 0)
        pairs = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: a * F.lit(n) + b)
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, k: acc + F.get(table, k))
        return total / F.greatest(F.size(pairs), F.lit(1))


def random_samples(documents: DataFrame, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled random strings in the writings that keys use: hexadecimal, base 64 and its URL form, upper-case base 36."""
    spark = documents.sparkSession
    base = spark.range(n).select("id", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512).alias("h"))
    b64 = F.base64(F.unhex("h"))
    token = (
        F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40))
        .when(F.col("id") % 4 == 1, F.regexp_replace(F.substring(b64, 1, 44), "[^A-Za-z0-9+/=]", ""))
        .when(F.col("id") % 4 == 2, F.translate(F.substring(b64, 1, 40), "+/", "-_"))
        .otherwise(F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 36)))
    )
    return base.select(token.alias("token"), F.lit(1).alias("random"))


def ordinary_samples(documents: DataFrame, labels: DataFrame, n: int = MAX_LABELLED) -> DataFrame:
    """Labelled ordinary strings from at most ``n`` labelled documents, those of the smallest hashes: long runs of their texts, less
    what the fixed patterns find, and identifiers, paths, numbers and addresses formed from neighbouring words."""
    chosen = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # n rows at most
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    texts = common.stage(texts.select("doc_id", plain.alias("text")), "ordinary-texts")
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"), F.lit(0))).alias("token"))
    words = texts.select("doc_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{3,12}\b"), F.lit(0)), 1, WORDS_EACH)).alias("at", "a"))
    following = Window.partitionBy("doc_id").orderBy("at")
    words = words.select("doc_id", "at", F.lower("a").alias("a"), F.lower(F.lead("a").over(following)).alias("b"), F.lower(F.lead("a", 2).over(following)).alias("c")).where("c IS NOT NULL")
    number = F.pmod(F.xxhash64("doc_id", "at", F.lit(3)), F.lit(10**18)).cast("string")
    few = lambda k: F.substring(number, 1, k)
    forms = [
        F.concat_ws("_", "a", "b", "c"),
        F.concat_ws("/", "a", "b", F.initcap("c")),
        F.concat(F.lit("/"), F.concat_ws("/", "a", "b"), F.lit("/"), few(4)),
        F.concat("a", F.initcap("b"), F.initcap("c"), few(1)),
        F.concat(F.lit("get"), F.initcap("a"), F.initcap("b")),
        F.concat_ws("-", "a", "b", few(3)),
        F.concat(F.col("a"), F.lit("_id_"), number),
        F.concat_ws("_", F.upper("a"), F.upper("b"), F.upper("c")),
        F.concat(number, F.reverse(few(6))),
        F.concat(F.lit("20"), few(2), F.lit("-0"), few(1), F.lit("-1"), few(1), F.lit("_"), F.col("a"), F.lit("_v"), few(1)),
        F.concat(F.lit("//www-"), F.col("a"), F.lit("/"), F.col("b"), F.lit("/"), few(6)),
        F.concat(F.lit("12345678901234567890"), few(2)),
        # Rules and runs of one character, the alphabet, and times.
        F.repeat(F.substring(F.lit("-=_+/-=_-=" + ALPHABET), F.pmod(F.xxhash64("a"), F.lit(len(ALPHABET) + 10)).cast("int") + 1, F.lit(1)), MIN_RUN + F.pmod(F.xxhash64("b"), F.lit(60)).cast("int")),
        F.substring(F.when(F.length("a") % 2 == 0, F.lit(ALPHABET)).otherwise(F.lit(ALPHABET[26:52] + ALPHABET[:26])), F.pmod(F.xxhash64("b"), F.lit(9)).cast("int") + 1, F.lit(26)),
        F.concat(F.lit("20"), few(2), F.lit("-0"), few(1), F.lit("-1"), few(1), F.lit("T1"), few(1), F.lit("-"), few(2), F.lit("-"), few(2), F.lit("Z")),
        F.concat_ws("_", F.upper("a"), F.initcap("b"), F.upper("c"), few(2)),
    ]
    formed = words.select(F.get(F.array(*forms), F.pmod(F.xxhash64("a", "b", "c"), F.lit(len(forms))).cast("int")).alias("token"))
    return runs.unionByName(formed).select("token", F.lit(0).alias("random"))


def held_out() -> Column:
    """Whether a sample is kept from training: a fifth of all strings, by their hash."""
    return F.pmod(F.xxhash64("token"), F.lit(5)) == 0


def train(samples: DataFrame, smoothing: float = 0.5, false_share: float = 0.0005, least: float = 0.3) -> MarkovPair:
    """Fit both models. ``samples`` has ``token`` and ``random`` (1 random, 0 ordinary).

    The threshold is the score that ``false_share`` of the held-out ordinary strings exceed, at least ``least`` and at most what all
    but MISSED of the held-out random strings exceed. Without samples of one kind its model is uniform.
    """
    n = len(ALPHABET)
    samples = samples.where(F.col("token").isNotNull() & (F.length("token") >= 2))
    # Most samples are words that come again and again: each is taken apart once.
    samples = common.stage(samples.groupBy("token", "random").agg(F.count("*").alias("n")), "samples")
    learnt = samples.where(~held_out())
    grams = learnt.select("random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("gram"))
    counts = {(r["random"], r["gram"]): r["n"] for r in grams.groupBy("random", "gram").agg(F.sum("n").alias("n")).collect()}  # alphabet size squared, twice

    def logs(kind: int) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get((kind, a + b), 0) + smoothing for b in ALPHABET]
            total = sum(row)
            out += [log(x / total) for x in row]
        return out

    ratios = tuple(r - o for r, o in zip(logs(1), logs(0), strict=True))
    pair = MarkovPair(ratios, least)
    scored = samples.where(held_out() & (F.length("token") >= MIN_RUN)).select("random", "n", pair.score(F.col("token")).alias("s"))
    scored = scored.select("random", "s", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    of = lambda kind, share: F.percentile_approx(F.when(F.col("random") == kind, F.col("s")), share, 10_000)
    high, most = scored.agg(of(0, 1 - false_share), of(1, MISSED)).first()
    high = least if high is None else high
    return MarkovPair(ratios, max(least, high if most is None else min(high, most)))


def measure(samples: DataFrame, models: MarkovPair) -> dict[str, float]:
    """Counts of held-out strings of MIN_RUN characters or more, and the models' precision and recall on them."""
    judged = samples.where(held_out() & (F.length("token") >= MIN_RUN)).select("random", (models.score(F.col("token")) > F.lit(models.threshold)).cast("int").alias("said"))
    row = judged.agg(
        F.count(F.when(F.col("random") == 1, 1)).alias("n_random"),
        F.count(F.when(F.col("random") == 0, 1)).alias("n_ordinary"),
        F.coalesce(F.sum(F.when(F.col("random") == 1, F.col("said"))), F.lit(0)).alias("right"),
        F.coalesce(F.sum("said"), F.lit(0)).alias("said"),
    ).first()
    return {"random": row["n_random"], "ordinary": row["n_ordinary"], "precision": row["right"] / max(row["said"], 1), "recall": row["right"] / max(row["n_random"], 1)}


def scan(documents: DataFrame, models: MarkovPair) -> DataFrame:
    """doc_id and ``spans``: an array of (at, kind_no, until, kind, value) by start, then kind; base kinds, then ``random`` where no base span lies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(S.find(text, "assign", 0, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    step1 = documents.select(
        "doc_id",
        F.concat(assign, S.find(text, "access", 1, ACCESS, "AKIA"), S.find(text, "hex", 2, HEX)).alias("base"),
        S.find(text, "random", 3, RUN).alias("runs"),
    )
    judged = F.filter("runs", lambda s: ~S.overlaps(s, F.col("base")) & (models.score(s["value"]) > F.lit(models.threshold)))
    return step1.select("doc_id", F.array_sort(F.concat("base", judged)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select(
        "doc_id",
        *(S.count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
