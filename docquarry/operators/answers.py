"""What prompts and answers are made of: budgets, summaries, tags, and how well evidence covers a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a prompt for history, summary, other sessions, conflicts and notes; least tokens of all parts and of evidence.
SHARES = {"history": 0.35, "summary": 0.10, "cross_session": 0.15, "conflict": 0.10, "notes": 0.10}
LEAST_REST, LEAST_EVIDENCE = 256, 128
#: Turns and characters of a session's summary.
SUMMARY_TURNS, TURN_CHARS = 8, 180
#: Signs of a comparison, capitalised words that name nothing, words without a topic, and how often a side must be named.
COMPARISON = ("vs", "versus", "compare", "compared", "differ", "difference", "both", "and", "between")
NO_NAMES = ("How", "What", "Both", "Their", "The", "Are", "Do", "Does", "Which", "And")
NO_TOPIC = ("what", "their", "both", "does", "have", "from", "with", "that", "this")
LEAST_HITS, TOPIC_WORDS = 3, 4


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_reasoning(said: Column) -> tuple[Column, Column]:
    """(answer, reasoning): what stands between tags of answer and thought. Without an answer's tags it is all but the thought; a
    thought that is never closed is cut off, unless an answer opens after it. Without tags all is answer and reasoning null."""
    text, tags = _trim(F.coalesce(said, F.lit(""))), lambda t: F.regexp_replace(t, "(?i)</?answer>", "")
    thought, answered, opened = r"(?is)<thinking>(.*?)</thinking>", r"(?is)<answer>(.*?)</answer>", r"(?is)<answer\b[^>]*>(.*)$"
    closed, open_thought = text.rlike(thought), text.rlike(r"(?i)<thinking\b[^>]*>")
    cut = F.when(text.rlike(opened), F.regexp_extract(text, opened, 1)).otherwise(F.regexp_replace(text, r"(?is)<thinking\b[^>]*>.*$", ""))
    answer = (
        F.when(text.rlike(answered), _trim(F.regexp_extract(text, answered, 1)))
        .when(closed, _trim(tags(_trim(F.regexp_replace(text, thought, "")))))
        .when(open_thought, _trim(tags(_trim(cut))))
        .otherwise(text)
    )
    return answer, F.when(closed, _trim(F.regexp_extract(text, thought, 1)))


def budgets(whole: Column, base: Column) -> dict[str, Column]:
    """Tokens of each part of a prompt of ``whole`` tokens of which the frame takes ``base``; evidence gets the rest."""
    rest = F.greatest(F.lit(LEAST_REST), whole - base)
    parts = {k: F.floor(rest * share).cast("bigint") for k, share in SHARES.items()}
    left = rest
    for part in parts.values():
        left = left - part
    return parts | {"evidence": F.greatest(F.lit(LEAST_EVIDENCE), left).cast("bigint")}


def session_summary(messages: DataFrame, key: str) -> DataFrame:
    """(key, turns, summary): the last turns of each session, a line each, long ones cut with dots. A session gives SUMMARY_TURNS lines at most."""
    newest = Window.partitionBy(key).orderBy(F.desc("turn"), F.desc("role"))
    last = messages.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= SUMMARY_TURNS)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    short = F.when(F.length(text) > TURN_CHARS, F.concat(F.rtrim(F.substring(text, 1, TURN_CHARS - 3)), F.lit("..."))).otherwise(text)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), short)
    made = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("r"))
    return made.select(key, F.size("r").cast("bigint").alias("turns"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("summary"))


def entities(question: Column) -> Column:
    """Runs of capitalised words of a question that may name a side of a comparison."""
    found = F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*\b"), F.lit(0))
    return F.filter(found, lambda e: ~e.isin(*NO_NAMES) & (F.length(e) >= 3))


def entity_coverage(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """For each comparison (qid, question) of two named sides or more: the side that fewest rows (qid, text in lower case) name, how many
    do, whether that is enough, and else a query for it: its name and words of the question's topic."""
    low = F.lower("question")
    signs = "|".join(s.replace(".", r"\.") for s in COMPARISON)
    asked = questions.withColumn("names", entities(F.col("question"))).where(low.rlike(signs) & (F.size("names") >= 2))
    own = F.flatten(F.transform("names", lambda e: F.split(F.lower(e), r"\s+")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"\b[a-z]{4,}\b"), F.lit(0)), lambda w: ~w.isin(*NO_TOPIC))
    asked = asked.withColumn("own", own).withColumn("topic", F.array_join(F.slice(F.filter(words, lambda w: ~F.array_contains("own", w)), 1, TOPIC_WORDS), " "))
    sides = asked.select("qid", "topic", F.posexplode("names").alias("pos", "name"))
    hits = sides.join(rows.select("qid", "text"), "qid", "left").groupBy("qid", "topic", "pos", "name").agg(F.count_if(F.col("text").contains(F.lower("name"))).alias("hits"))
    weakest = hits.groupBy("qid", "topic").agg(F.min_by("name", F.struct("hits", "pos")).alias("weakest"), F.min("hits").alias("hits"))
    topic = F.when(F.col("topic") != "", F.col("topic")).otherwise(F.lit("portfolio details"))
    return weakest.select("qid", "weakest", "hits", (F.col("hits") >= LEAST_HITS).alias("sufficient"), F.when(F.col("hits") < LEAST_HITS, F.concat_ws(" ", "weakest", topic)).alias("gap"))


def attribution(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """For each question: 1 where a row has the expected version (0 where none is expected), 1 where no conflict is expected or a row has
    one, and how many versions and documents the rows are of, by their labels or else their groups."""
    label = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    document = F.coalesce(F.nullif("document_label", F.lit("")), F.concat(F.lit("group "), F.col("version_group")))
    joined = rows.join(expected, "qid")
    made = joined.groupBy("qid", "expected_version", "expect_conflict").agg(
        F.max(F.coalesce(label("version_label") == label("expected_version"), F.lit(False))).alias("right"), F.max(F.col("conflict_type").isNotNull()).alias("conflict"),
        F.count_distinct(label("version_label")).alias("versions"), F.count_distinct(document).alias("documents"),
    )
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    return made.select("qid", one(F.col("right")).alias("version_attribution"), one(~F.col("expect_conflict") | F.col("conflict")).alias("conflict_attribution"), "versions", "documents")


def evaluator_sample(rows: DataFrame, key: str, rank: str, best: int = 2, spread: int = 3) -> DataFrame:
    """The ``best`` first rows of each key, and of the rest ``spread`` at even distances (all where there are no more)."""
    n = F.count("*").over(Window.partitionBy(key)) - best
    step = F.greatest(F.lit(1), F.floor(n / spread))
    place = F.col(rank) - best - 1
    chosen = (F.col(rank) <= best) | (n <= spread) | ((place % step == 0) & (F.floor(place / step) < spread))
    return rows.withColumn("_chosen", chosen).where("_chosen").drop("_chosen")


#: Endings of images that may be evidence, and how many are taken.
IMAGE_TYPES, MOST_IMAGES = ("png", "jpg", "jpeg", "webp", "gif", "bmp"), 8


def image_evidence(citations: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """(qid, nth, path) of each question's first images, in the order of its citations (rank) and their references.

    ``citations`` has qid, rank and assets (an array of path, digest); an image that can't be read has no digest and is left out, as is
    one of another type, one whose path was taken, and one of the same content as one taken. A question's citations are its
    evidence, which is bounded, so they are put together and gone through once.
    """
    ending = lambda a: F.lower(F.regexp_extract(a["path"], r"\.([^.]+)$", 1)).isin(*IMAGE_TYPES)
    usable = F.filter("assets", lambda a: a["path"].isNotNull() & a["digest"].isNotNull() & ending(a))
    refs = citations.select("qid", F.struct("rank", usable.alias("refs")).alias("c")).groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    every = F.flatten(F.transform("cs", lambda c: F.transform(c["refs"], lambda a: F.struct(a["path"].alias("path"), a["digest"].alias("digest")))))

    def take(kept: Column, a: Column) -> Column:
        known = (F.size(kept) >= most) | F.exists(kept, lambda k: (k["path"] == a["path"]) | (k["digest"] == a["digest"]))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(a)))

    kept = F.aggregate(every, F.array().cast("array<struct<path:string,digest:string>>"), take)
    made = refs.select("qid", F.posexplode(kept).alias("nth", "a"))
    return made.select("qid", (F.col("nth") + 1).cast("bigint").alias("nth"), "a.path")
