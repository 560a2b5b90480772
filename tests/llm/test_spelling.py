"""Spelling variants against all pairs of words."""
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from corvid.llm import queries, spelling

DOC = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs, min_chars=6, min_count=5):
    c = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(words):
    by = {}
    for w in words:                       # words one edit apart share a word or a word without one code point
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by.setdefault(k, set()).add(w)
    near = {w: {v for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in by[k] if one_edit(w, v)} for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counts(docs))
    assert got(queries.QUERIES["op11_spelling_variants"](spark, sf)) == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want) or len(want) > 1000


def test_random_words(spark):
    rng = random.Random(4)
    for letters, size in (("ab", 9), ("abcé", 11)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, size))): rng.choice([5, 6, 30, 200, 1100]) for _ in range(300)}
        words |= {"a" * n: 7 ** (n - 4) for n in range(6, 13)} | {"x" * 3000: 5, "x" * 3001: 25, "x" * 1500 + "y" + "x" * 1499: 6}
        df = spark.createDataFrame(sorted(words.items()), "word string, n long")
        assert got(spelling.variants(df)) == brute(words)


def test_odd_rows_and_clashing_columns(spark):
    docs = [(i, "Straße École étranger ÉCOLES colour colours color's zzzzzz") for i in range(400)] + [
        (1, None), (2, ""), (None, "colour colour école écoles"), (None, None), (400, "colors " * 9), (401, "q" * 100_000 + " "), (3, "same same"), (3, "same same"),
        (402, "wordword " * 300_000)]
    want = brute(counts(docs))
    df = spark.createDataFrame(docs, DOC)
    assert got(spelling.spelling_variants(df)) == want and ("wordword", None, "wordword", 300_000, 0, None) in want or zlib.crc32(b"402:wordword") % 199 == 0
    clash = df.select("*", *[F.lit("theirs").alias(c) for c in ("word", "n", "node", "_text", "form", "root")])
    assert got(spelling.spelling_variants(clash)) == want


def test_empty_tables(spark):
    assert got(spelling.spelling_variants(spark.createDataFrame([], DOC))) == set()
    assert got(spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "tiny")], DOC))) == set()
