"""Labels of what a question asks for, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

#: Terms of each label; terms are substrings unless the name says WORDS (whole words).
DELTA = ("what changed", "what's changed", "change between", "changed between", "between", "versus", " vs ", "compare")
TIME_ANCHORS = ("q4", "q1", "q2", "q3", "quarterly", "quarterly update", "annual", "update", "older", "newer", "previous", "latest", "prior")
YEAR = r"\b(?:19|20)\d{2}\b"
PROJECTION = ("projected", "forecast", "expected")
IMPACT = ("impact", "contribution", "effect")
COMMUNITY = ("communities", "community", "jobs", "employment", "tax", "local", "regional")
CAVEAT = (
    "inconsistency", "inconsistent", "contradict", "conflict", "caveat", "footnote", "changed between", "change between",
    "changed from", "how has", "methodology", "basis changed", "actual market",
)
AS_OF_METRICS = ("yield", "margin", "occupancy", "customers", "countries", "portfolio", "square feet", "rent", "noi")
SHARE_ASKED = ("what percentage", "what share")
SHARE_SUBJECTS = ("portfolio", "rent", "noi", "markets", "square feet", "base rent")
BIG_SUBJECTS = ("portfolio", "square feet", "owned")
COUNT_ASKED = ("how many", "number of", "count")
COUNT_SUBJECTS = ("customers", "countries", "properties", "markets", "assets", "locations", "tenants", "units")
OUTLOOK = ("outlook", "guidance", "forecast", "projection", "projected")
BREADTH = (" between ", " vs ", " versus ", "compare", "difference", "each company", "each reit", "among ", "across ", " in the corpus")
LOOKUP = ("what is", "what are", "what was", "what does", "what did", "what percentage", "what share")
VERSIONED = (
    "dividend yield", "dividend", "strategy", "key strategy", "investment thesis", "noi margin", "occupancy", "capacity",
    "it capacity", "key facts", "quick facts", "fast facts", "headline stats", "key statistics", "portfolio", "cbd", "yield",
    "market share", "geographic mix",
)
VISUAL = (
    "ranked by", "ranked", "asset list", "property list", "named assets", "named properties", "property names", "which markets",
    "u.s. region", "us region", "regions vs", "region vs",
)
WHICH = ("which company", "which companies", "which document", "which documents", "which reit", "who has", "who appears")
SUPERLATIVES = ("most directly", "most dependent", "most geographically", "most explicitly", "most global", "strongest case", "best positioned")
SCANS = ("in these documents", "in the documents", "across the uploaded", "in the uploaded", "represented in these", "in the corpus", "the uploaded materials")
BALANCED = (
    "different", "both", "each", "across", "sectors", "represented", "for each", "each company", "each issuer", "per company",
    "per issuer", "all companies", "all issuers",
)
EXPANSION = (
    "compare", "comparison", "difference", "differences", "change", "changed", "changes", "current version", "older version",
    "previous version", "latest", "conflict", "conflicting", "contradict", "trend", "trends", "summarize", "summary", "across",
    "over time", "chart", "charts", "graph", "graphs", "map", "maps", "table", "tables", "figure", "figures", "diagram", "image",
    "screenshot", "largest", "ranked", "ranking", "tenant", "markets", "regions", "asset list", "property list", "named assets",
    "named properties", "property names",
)
FOLLOW_UP_PHRASES = (
    "what about", "how about", "compare that", "compare it", "vs that", "versus that", "previous one", "earlier one", "same one",
    "that one",
)
FOLLOW_UP_WORDS = (
    "it", "its", "that", "those", "this", "these", "they", "them", "previous", "earlier", "prior", "same", "above", "latter", "former",
)
NO_ENTITY = (
    "investor", "presentation", "update", "report", "annual", "supplemental", "earnings", "results", "slides", "deck", "summary",
    "overview", "analysis", "merger", "acquisition", "pro", "forma", "combined", "session", "morning", "appendix", "roadshow", "web",
    "vf", "resize", "final", "company", "q1", "q2", "q3", "q4", "fy", "ytd", "h1", "h2", "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august", "september",
    "october", "november", "december", "the", "and", "for", "of", "in", "a", "an", "to", "by", "at", "with", "inc", "llc", "corp",
    "ltd", "co", "plc", "trust", "fund", "reit", "group", "properties", "capital", "impact", "brick", "mortar", "shopping",
)
#: A file's ending, what stands in brackets, and what parts the words of its name.
FILE_TYPE, BRACKETS, SEPARATORS = r"\.[a-zA-Z0-9]{2,5}$", r"\([^)]*\)", r"[_\-.\s]+"
LABELS = ("temporal_delta", "stale_source", "caveat_inconsistency", "outlook_scope", "balanced_scope", "multi_version_lookup", "visual_detail", "corpus_wide_scope")


#: Whole words that tie a question to a time, and years.
TIME_WORDS = rf"\b(?:{'|'.join(TIME_ANCHORS)})\b|{YEAR}"
CORPUS = WHICH + SUPERLATIVES + SCANS


def normalised(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " "))


def tests(question: Column) -> dict[str, Column]:
    """A boolean column for each label."""
    q = normalised(question)
    has = lambda terms: contains_any(q, terms)
    anchored = q.rlike(TIME_WORDS)
    return {
        "temporal_delta": anchored & (has(DELTA) | has(PROJECTION)),
        "stale_source": has(IMPACT) & has(COMMUNITY),
        "caveat_inconsistency": has(CAVEAT)
        | (q.contains("as of") & has(AS_OF_METRICS))
        | (has(SHARE_ASKED) & has(SHARE_SUBJECTS))
        | (q.contains("how big") & has(BIG_SUBJECTS))
        | (has(COUNT_ASKED) & has(COUNT_SUBJECTS)),
        "outlook_scope": has(OUTLOOK),
        "balanced_scope": has(BALANCED),
        "multi_version_lookup": ~has(BREADTH) & has(LOOKUP) & has(VERSIONED),
        "visual_detail": has(VISUAL),
        "corpus_wide_scope": has(CORPUS),
    }


def labels(question: Column) -> Column:
    """Names of the labels that apply, in order."""
    found = tests(question)
    return F.filter(F.array(*(F.when(found[name], F.lit(name)) for name in LABELS)), lambda x: x.isNotNull())


def expands(question: Column, has_history: Column | None = None) -> Column:
    """Whether a question is broad enough to be rewritten, or follows up on one before it."""
    q = F.lower(F.coalesce(question, F.lit("")))
    words = F.regexp_extract_all(q, F.lit("[a-z0-9']+"), F.lit(0))
    follows = contains_any(q, FOLLOW_UP_PHRASES) | ((F.size(words) <= 10) & F.arrays_overlap(words, F.array(*map(F.lit, FOLLOW_UP_WORDS))))
    return contains_any(q, EXPANSION) | (F.coalesce(has_history, F.lit(False)) & follows if has_history is not None else F.lit(False))


def entity_words(name: Column) -> Column:
    """The first three words of a file's name that may name its issuer."""
    stem = F.regexp_replace(F.regexp_replace(name, FILE_TYPE, ""), BRACKETS, " ")
    words = F.split(F.trim(F.lower(F.regexp_replace(stem, SEPARATORS, " "))), " ")
    return F.slice(F.filter(words, lambda w: w.rlike("[a-z]") & ~w.isin(*NO_ENTITY)), 1, 3)


#: Further queries by label, in order; ``topic`` is the question without its comparing frame.
COMPANIONS = (
    ("temporal_delta", "{topic} investor day baseline presentation"),
    ("temporal_delta", "{topic} quarterly update current guidance"),
    ("caveat_inconsistency", "{question} footnote as of date caveat inconsistency"),
    ("caveat_inconsistency", "{question} headline appendix table same metric"),
    ("caveat_inconsistency", "{question} definition scope qualifier basis"),
    ("outlook_scope", "{question} guidance outlook pro forma merger acquisition"),
    ("outlook_scope", "{question} neutral accretive stabilization standalone"),
    ("outlook_scope", "{question} prior year presentation historical baseline estimate"),
    ("visual_detail", "{question} map figure table labels percentages"),
    ("visual_detail", "{question} ranked list portfolio breakdown"),
    ("corpus_wide_scope", "investor presentation overview highlights: {question}"),
    ("corpus_wide_scope", "financial metrics key statistics strategy: {question}"),
)
#: What frames a comparison over time, before and behind its topic, and how long a topic is at least.
FRAME_BEFORE, FRAME_BEHIND = r"(?i)\bwhat(?:'s)?\s+changed\b.*?\bbetween\b\s*", r"(?i)\bbetween\s+the\s+.*?\band\s+the\b.*$"
LEAST_TOPIC, MOST_COMPANIONS = 11, 6


def topic_phrase(question: Column) -> Column:
    """A question without its ``what changed between`` frame; as it is where hardly anything is left."""
    rest = F.regexp_replace(F.regexp_replace(question, FRAME_BEFORE, ""), FRAME_BEHIND, "")
    rest = F.regexp_replace(rest, r"^\s+|\s+$", "")
    return F.when(F.length(rest) >= LEAST_TOPIC, rest).otherwise(question)


def companions(question: Column) -> Column:
    """Further queries for the labels that apply, in order, MOST_COMPANIONS at most; none repeats the question or another in
    whatever case and spacing."""
    found, words = tests(question), {"question": question, "topic": topic_phrase(question)}
    made = []
    for label, form in COMPANIONS:
        before, name, after = re.fullmatch(r"(.*)\{(\w+)\}(.*)", form).groups()
        text = F.trim(F.regexp_replace(F.concat(F.lit(before), words[name], F.lit(after)), r"\s+", " "))
        made.append(F.when(found[label], text))
    apply = F.filter(F.array(*made), lambda x: x.isNotNull() & (F.lower(x) != normalised(question)))
    # Of texts alike but for case the first stays.
    add = lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.slice(F.aggregate(apply, F.array().cast("array<string>"), add), 1, MOST_COMPANIONS)
