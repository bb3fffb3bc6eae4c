"""Collocations, spelling variants and fingerprints against plain Python and SQL, and at their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import oracle
import pytest

from docquarry.llm import collocations, fingerprints, spelling_variants
from docquarry.llm.queries import ORACLES, QUERIES

COLUMNS = "doc_id bigint, text string, lang string, n bigint, row string, phrase string, word string, slot int"


def table(spark, rows, parts=3):
    """(doc_id, text, lang) rows as documents with columns whose names clash with those the operators make."""
    made = [(i, t, g, 1, "x", "x", "x", 1) for i, t, g in rows]
    return spark.createDataFrame(made, COLUMNS).repartition(parts)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_spelling_variants"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries_equal_sql(spark, name, size):
    assert oracle.differences(QUERIES[name](spark, f"/root/testdata/{size}"), ORACLES[name], oracle.connect(f"/root/testdata/{size}")) == []


# Collocations


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, longest, best):
    f = {}
    for _, text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(v for g, v in own.items() if len(g) == 1)
        often = {g: v for g, v in own.items() if v >= least}
        kept = []
        for g, a in often.items():
            holds = lambda o: len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))
            if len(g) > 1 and not any(v >= a and holds(o) for o, v in often.items()):
                score, k = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "a", "é", "naïve", "x-1", "b c", "日本"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
        rows.append((i, text + rng.choice(["", "new york times of the day"]), rng.choice(["en", "de", None])))
    return rows + rows[:5] + [(None, None, "en"), (5, "", None), (6, "a " * 4000, "de"), (7, ". , !", "fr"), (8, "solo", "fr"), (9, "w" * 70_000 + " b", "en")]


@pytest.mark.parametrize("seed", range(2))
def test_collocations_against_counting(spark, seed, monkeypatch):
    rows = phrase_rows(seed)
    monkeypatch.setattr(collocations, "FLUSH", 500)  # many sketches a task
    monkeypatch.setattr(collocations, "GATHER_BYTES", 2000)
    how = collocations.Frequent(least=4, longest=5, best=40)
    got = sorted(map(tuple, collocations.report(table(spark, rows), how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain_collocations(rows, 4, 5, 40)


def test_sketch_lets_all_frequent_ones_pass_however_full_it_is(spark, monkeypatch):
    rows = phrase_rows(5)
    whole = sorted(map(tuple, collocations.report(table(spark, rows), collocations.Frequent(4, 5, 10_000)).collect()))
    monkeypatch.setattr(collocations, "PASS_BITS", 64)
    assert sorted(map(tuple, collocations.report(table(spark, rows), collocations.Frequent(4, 5, 10_000)).collect())) == whole == plain_collocations(rows, 4, 5, 10_000)


def test_sketch_leaves_rare_phrases_out(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang")
    cells, least = 1 << 20, 100
    pairs = collocations._merged(collocations._sketch(texts, range(1, 3), cells, least, None), cells, least)
    set_bits = [sum(int(x).bit_count() for x in bits) for bits in pairs.bits]
    assert all(0 < n < 400 for n in set_bits)  # of some 60,000 words and pairs


def test_collocations_of_products_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "", 0, 10**15), ("en", "a", 1, 4 * 10**9), ("en", "b", 1, 3 * 10**9 + 1), ("en", "a b", 2, 2 * 10**9 + 7)], "lang string, phrase string, k int, n bigint")
    assert [x.score for x in collocations.scored(counted).collect()] == [1000 * (2 * 10**9 + 7) * 10**15 // (4 * 10**9 * (3 * 10**9 + 1))]


def test_collocations_of_nothing(spark):
    assert collocations.report(table(spark, [(1, "a b", "en")]).limit(0)).collect() == []
    assert collocations.report(table(spark, [(1, None, None), (2, "", "en")])).collect() == []


# Spelling variants


def plain_words(rows, letters=7, least=2, damaged=31):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    return {w: v for w, v in n.items() if v >= least}


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    p = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x != y and (x[p + 1 :] == y[p + 1 :] if len(x) == len(y) else len(y) == len(x) + 1 and x[p:] == y[p + 1 :])


def plain_variants(words, ratio=10):
    form, out = {}, []
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(((-words[v], v) for v in found), default=(0, None))
        form[w] = best[1] if found and -best[0] >= ratio * n else None
        out.append((w, form[w], n, len(found), -best[0] if form[w] else None))
    rows = []
    for w, f, n, k, fn in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, n, k, fn))
    return sorted(rows)


def variant_rows(seed):
    rng = random.Random(seed)
    bases = ["Straßenbahn", "überlegen", "necessary", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "ÀÉÎõü×÷ÿ", "x" * 300, "committee"]
    letters = "abx÷é"
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(25)):
            w = rng.choice(bases)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])
            words.append(w + rng.choice([" ", "-", "1", "Ā", "日"]))
        rows.append((rng.choice([i, i, i, None]), "".join(words), "en"))
    return rows + rows[:9] + [(1, None, None), (2, "", "en"), (3, "short", "en"), (4, "y" * 9000, "en"), (5, "y" * 9001, "en"), (6, "y" * 9000, "en"), (7, "y" * 9001, "en")]


@pytest.mark.parametrize("seed", range(2))
def test_variants_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling_variants, "GATHER_BYTES", 3000)
    rows = variant_rows(seed)
    got = spelling_variants.report(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_variants(plain_words(rows))
    assert sorted(map(tuple, got)) == want and sum(x[1] is not None for x in want) > 20


def test_each_near_pair_once(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(600)})
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = [tuple(sorted(x)) for x in spelling_variants.near_pairs(counted).collect()]
    want = {(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if near(x, y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_roots_follow_chains(spark):
    chain = [("w" * 7 + "abcdefgh"[:k], 10**k * 2) for k in range(7)]
    counted = spark.createDataFrame(chain, "word string, n bigint")
    got = {x.word: (x.form, x.root) for x in spelling_variants.groups(counted).collect()}
    assert all(got[w] == (chain[k + 1][0] if k < 6 else None, chain[-1][0]) for k, (w, _) in enumerate(chain))


def test_variants_of_nothing(spark):
    assert spelling_variants.report(table(spark, [(1, "word", "en")]).limit(0)).collect() == []
    assert spelling_variants.report(table(spark, [(1, None, None), (None, "", "en")])).collect() == []


# Fingerprints


def shingle_set(text):
    words = re.findall("[^ \t-\r]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def document_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé日") for _ in range(6)) for _ in range(3000)]
    rows = [(i * 7 - 100, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 300]))), "en") for i in range(200)]
    rows += [(50_000, None, None), (50_001, "", "de"), (50_002, "abc", "de"), (50_003, " \n ", "de"), (60_000, " ".join(rng.choice(words) for _ in range(20_000)), "en")]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_of_edited_and_next_texts(spark, parts, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(fingerprints, "WORK_BYTES", 5000)
    rows = sorted(document_rows(1), key=lambda x: x[0])
    got = {x.doc_id: x for x in fingerprints.report(table(spark, rows, parts)).collect()}
    assert len(got) == len(rows)
    prints = {x.doc_id: x.fingerprint for x in fingerprints.fingerprints(table(spark, rows)).collect()}
    for k, (i, text, _) in enumerate(rows):
        text, after, r = text or "", rows[(k + 1) % len(rows)][1] or "", got[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == prints[i]
        for other, near, inside in ((edited, r.near_edited, r.in_edited), (after, r.near_next, r.in_next)):
            a, b = shingle_set(text), shingle_set(other)
            exact = len(a) <= fingerprints.FLOOR and len(b) <= fingerprints.FLOOR
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) <= (1e-9 if exact else 0.3)
            assert abs(inside - (len(a & b) / len(a) if a else not b)) <= (1e-9 if exact else 0.3)


def test_fingerprints_of_rows_that_share_or_lack_an_id(spark):
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (1, "other words", "en"), (None, "last one", "en"), (None, "last one", "en"), (0, "first text", "en")]
    got = fingerprints.report(table(spark, rows)).collect()
    assert len(got) == 6 and len({x.fingerprint for x in got if x.n_chars == 5}) == 1
    last = [x.edited_sha256 for x in got if x.doc_id is None]
    assert sorted(last) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("last ola", "last ofi"))
    single = fingerprints.report(table(spark, [(9, "one two three four five six", "en")])).collect()
    assert single[0].near_next == 1 and single[0].edited_sha256 == hashlib.sha256(b"one two three four fione tw").hexdigest()
    assert fingerprints.report(table(spark, rows).limit(0)).collect() == []


def test_sketches_merge_and_tell_containment(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(10**9)) for _ in range(60_000)]
    long, part = " ".join(words), " ".join(words[1000:3000])
    halves = [" ".join(words[:30_004]), " ".join(words[30_000:])]  # the seam's shingles are in both
    import pyarrow as pa

    own = fingerprints.Sketches.of(pa.array([long, part, *halves])).strings()
    assert fingerprints.merged(own[2:]) == own[0]
    a, b = fingerprints.parsed([own[1]]), fingerprints.parsed([own[0]])
    near, inside = fingerprints.likeness(a, b)
    assert inside[0] == 1.0 and abs(near[0] - 1996 / 59_996) < 0.01
    shared, n = len(own[0]) // 16 - 1, 59_996
    assert abs(shared - n / fingerprints.SCALE) < 300  # the fraction that is kept
