"""Body chunks, cut texts and semantic parts by literal cases and plain Python."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from docquarry.operators import splitting as P


def test_windows_keep_the_budget_where_no_sentence_ends():
    text = " ".join(["Revenue grew 12 percent year over year"] * 40)
    made = list(P.body_chunks(text, 24, 6))
    assert len(made) > 1 and all(kind == "window" and n <= 24 and len(t.split()) == n for kind, n, t in made)
    assert made[1][2].split()[:6] == made[0][2].split()[-6:] and made[-1][2].split()[-1] == "year"


def test_sentences_are_put_together_under_the_budget():
    text = " ".join(["Revenue grew 12 percent year over year."] * 40)
    made = list(P.body_chunks(text, 24, 7))
    assert all(kind == "sentences" and n <= 24 for kind, n, _ in made)
    assert made[0][1] == 21 and [n for _, n, _ in made[1:-1]] == [21] * (len(made) - 2)  # one sentence of each is the last of the one before
    assert list(P.body_chunks("short text. ", 24, 6)) == [("whole", 2, "short text. ")] and list(P.body_chunks("", 24, 6)) == [("whole", 0, "")]


def test_chunks_lose_no_word_and_no_sentence_is_split():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word", "3.5", "a.b", "x!", "end.", "why?", "...", "\n"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(400)))
        made = list(P.body_chunks(text, 20, 5))
        words = text.split()
        seen = 0
        for kind, n, body in made:
            own = body.split()
            assert len(own) == n and (n <= 20 or kind == "whole")
            back = next(k for k in range(min(n, 6) + 1) if words[seen - k : seen - k + n] == own) if kind != "whole" else 0
            seen += n - back
        assert seen == len(words)


def test_chunks_of_rows(spark):
    rows = [(1, None), (2, "one. two. " * 20), (3, "z " * 100)]
    got = P.sentence_chunks(spark.createDataFrame(rows, "id int, t string"), "id", "t", 10, 2).collect()
    assert [(r.chunk_no, r.kind, r.tokens, r.body) for r in got if r.id == 1] == [(0, "whole", 0, "")]
    assert {r.kind for r in got if r.id == 2} == {"sentences"} and {r.kind for r in got if r.id == 3} == {"window"}
    assert P.sentence_chunks(spark.createDataFrame(rows, "id int, t string").limit(0), "id", "t").collect() == []


def test_truncated(spark):
    cut = lambda t, n: spark.range(1).select(P.truncated(F.lit(t), n).alias("c")).first().c
    assert [cut("  a b\tc  d ", n) for n in (0, 2, 3, 4)] == ["", "  a b", "  a b\tc", "  a b\tc  d "]
    assert cut(None, 3) == "" and cut("x " * 50_000, 700) == ("x " * 700)[:-1]


def test_semantic_parts_begin_where_the_subject_moves(spark):
    text = "aaa aab. aba aaa. aab aaa. zzz zzy. zyz zzz. zzy zzz."
    got = P.semantic_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one sentence")], "id int, t string"), "id", "t", share=0.8).collect()
    parts = [r.body.strip() for r in sorted(got, key=lambda r: r.part) if r.id == 1]
    assert len(parts) == 2 and "".join(r.body for r in sorted(got, key=lambda r: r.part) if r.id == 1) == text and parts[1].endswith("zzy zzz.")
    assert [(r.part, r.sentences) for r in got if r.id == 4] == [(0, 1)] and {r.id for r in got} == {1, 4}


def test_semantic_parts_against_plain_python(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcxyz ") for _ in range(rng.randrange(1, 40))) + "." for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    got = {}
    for r in P.semantic_chunks(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect():
        got.setdefault(r.id, []).append((r.part, r.body))
    for i, text in enumerate(texts):
        own = re.findall(P.SENTENCE, text)
        v = P.letter_counts(["".join(own[max(k - 1, 0) : k + 2]) for k in range(len(own))])
        n = np.linalg.norm(v, axis=1)
        d = [round(1 - (a @ b / (x * y) if x * y else 0), 9) for a, b, x, y in zip(v, v[1:], n, n[1:])]
        limit = np.percentile(d, 95) if d else 0
        parts, now = [own[0]], 0
        for s, distance in zip(own[1:], d):
            parts = [*parts, s] if distance > limit else [*parts[:-1], parts[-1] + s]
        assert [b for _, b in sorted(got[i])] == parts
