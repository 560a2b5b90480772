"""The queries against SQL, brute force, exact round trips and held-out labels."""
import hashlib
import math
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvid.llm import html_text, linededup, lmscore, pack, queries, simhash, tokencount, toxicity, warc
from corvid.llm.pretokens import SPLIT, Vocabulary, load

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def table(name, cols, sf=SF):
    return duckdb.sql(f"SELECT {cols} FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, key):
    df = queries.QUERIES[key](spark, SF)
    res = duck.execute(queries.ORACLES[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)

    def norm(rs):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rs), key=repr)
    assert norm(rows(df.select(*names))) == norm(res.fetchall())


def test_every_operator_has_its_query():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))


def test_op1_equals_the_article(spark):
    want = {i: brute.article(h) for i, h in table("pages", "page_id, html")}
    got = rows(queries.QUERIES["op1_main_text"](spark, SF))
    assert {r[0]: r[2] for r in got} == want and all(r[3] == len(r[2]) for r in got)


def test_op1_leaves_out_what_is_not_the_article():
    page = """<html><head><title>T</title></head><body><header>Site</header><div class="site-header">The name of this site and a slogan</div><div class="side-bar">aside words</div><nav><a href=x>Home</a></nav>
    <div id="main-content"><h1>Head &amp; line</h1><p>First <b>para</b>graph of many words here, long enough to win.
    <div class="ad-box">buy now</div><p>Second   paragraph<br>goes on &eacute;t cetera.</p><form>sign up<input></form>
    <ul><li>one<li>two</ul><script>if (a < b) { x("<p>no</p>") }</script><!-- <p>hidden</p> -->
    <p>Last words &lt;here&gt;.</div><section class="comments"><p>A reader wrote a very long comment about it all.</p></section>
    <aside>side</aside><footer>foot</footer></body></html>"""
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS).split("\n\n") == [
        "Head & line", "First paragraph of many words here, long enough to win.", "Second paragraph goes on ét cetera.",
        "one", "two", "Last words <here>."]
    assert html_text.extract("plain words only", html_text.DEFAULT_WEIGHTS) == "plain words only"
    assert html_text.extract("<p>" * 5, html_text.DEFAULT_WEIGHTS) == "" == html_text.extract(None, html_text.DEFAULT_WEIGHTS)


def test_op1_is_linear_in_hostile_pages():
    import time
    weights = html_text.DEFAULT_WEIGHTS
    for page in ("<div>" * 200_000 + "x", "<p " * 350_000, "<div>" * 100_000 + "</b>" * 100_000, "<div>a " * 100_000, '<p " ' * 200_000 + ">", "<" * 1_000_000):
        began = time.process_time()
        html_text.extract(page, weights)
        assert time.process_time() - began < 8.0          # a second or less here; minutes if it were quadratic
    assert html_text.extract("<div>" * 5000 + "x", weights) == "x"
    assert html_text.extract("<p>kept words</p><!-- open > comment <p>no", weights) == "kept words"
    assert html_text.extract("<p>kept words<script>if (a > b) x", weights) == "kept words"


def test_op1_keeps_paragraphs_with_weak_labels():
    page = "<article><p>first words of a text</p><p class='social'>a paragraph about social life</p><p class='advert'>buy</p><div class='social'>share</div></article>"
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS) == "first words of a text\n\na paragraph about social life"


def test_op1_weights_come_from_marked_pages(spark):
    plain = [(i, f"<div><p>page {i}</p></div>") for i in range(300)]
    marked = [(1000 + i, "<nav><a>Home</a></nav><main><p>many words of content stand here</p></main>") for i in range(3)]
    df = spark.createDataFrame(plain + marked, "page_id long, html string")
    few = html_text.fit_weights(df, sample_pages=3)
    assert few == html_text.fit_weights(spark.createDataFrame(marked, "page_id long, html string")) != html_text.DEFAULT_WEIGHTS
    assert html_text.fit_weights(spark.createDataFrame(plain, "page_id long, html string")) == html_text.DEFAULT_WEIGHTS


def test_samples_are_dealt_by_64_bits(spark):
    from corvid.llm.common import dealt
    ids = spark.range(200_000)
    for share in (0.5, 0.01, 1.0):
        n = ids.where(dealt(share, "id")).count()
        assert abs(n - share * 200_000) <= 5 * (share * 200_000) ** 0.5 and (share < 1 or n == 200_000)
    assert ids.where(dealt(1e-12, "id")).count() == 0 and "-92233720368" in str(dealt(1e-12, "id"))


def test_op1_best_run_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(0, 12))]
        i, j = html_text.best_run(np.array(s))
        best = max([0.0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a, len(s) + 1)])
        assert sum(s[i:j]) == best


def test_op2_finds_toxic_texts_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit("half")) % 2 == 0
    chain = toxicity.corpus_chain(docs, labels.where(half))
    assert chain.categories == ["low_quality", "toxic"] and len(chain.weights[1]) == len(chain.weights[0]) + 1
    insults = ("idiot", "loser", "scum", "clown", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash")
    seen = F.arrays_overlap(F.split(F.lower("text"), r"[^a-z]+"), F.array(*map(F.lit, insults)))
    got = rows(toxicity.score(docs.join(labels.where(~half), "doc_id"), chain, keep_text=True).select(
        "toxic", seen, F.col("p_toxic") >= toxicity.THRESHOLD))
    toxic = [p for y, s, p in got if y and s]
    clean = [p for y, s, p in got if not y]
    assert len(toxic) > 10 and sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_op2_equals_a_plain_chain(spark):
    """Features, chain and scores against dense matrices and plain Newton steps."""
    rng = random.Random(8)
    mild, rude, plain = ["boring", "dull", "empty"], ["fooled", "horrid", "nasty"], ["river", "stone", "cloud", "paper", "green", "seven", "ocean"]
    docs, labels = [], []
    for i in range(240):
        low, bad = rng.random() < 0.4, rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(6)] + [rng.choice(mild)] * (low and rng.random() < 0.9) + [rng.choice(rude)] * (bad and rng.random() < 0.9)
        docs.append((i, " ".join(words)))
        labels.append((i, int(low), int(bad)))
    d, y_table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low int, bad int")
    chain = toxicity.train(d, y_table, ["low", "bad"])
    folds = {r.doc_id: r.f for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}

    def features(text):
        out = set()
        for w in set(text.split()):
            out |= {"=" + w} | {"^" + w[:k] for k in range(3, 7) if len(w) >= k} | {"$" + w[-k:] for k in range(3, 6) if len(w) >= k}
        return out
    x = np.array([[float(f in features(t)) for f in chain.features] for _, t in docs])

    def newton(x, y):
        x = np.column_stack([x, np.ones(len(x))])
        w, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))

    def logit(p):
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))[:, None]
    y = np.array([lab[1:] for lab in labels], float)
    fold = np.array([folds[i] for i, _ in docs])
    first = newton(x, y[:, 0])
    out_of_fold = np.zeros(len(docs))
    for f in range(toxicity.FOLDS):
        out_of_fold[fold == f] = newton(x[fold != f], y[fold != f, 0])(x[fold == f])
    second = newton(np.column_stack([x, logit(out_of_fold)]), y[:, 1])
    p0 = first(x)
    want = np.column_stack([p0, second(np.column_stack([x, logit(p0)]))])
    got = {r.doc_id: (r.p_low, r.p_bad) for r in toxicity.score(d, chain).collect()}
    assert np.abs(np.array([got[i] for i, _ in docs]) - want).max() < 0.01
    assert any("fooled" in f for f in chain.features) and len(chain.features) > 5


def test_op2_chain_feeds_earlier_probabilities_out_of_fold():
    rng = np.random.default_rng(0)
    y0 = rng.integers(0, 2, 400)
    x = [np.array([0] if v else [1]) for v in y0]
    y = np.column_stack([y0, y0]).astype(float)
    chain = toxicity.fit_chain(["a", "b"], ["f0", "f1"], x, y, np.arange(400) % 5)
    assert ((chain.scores(x)[:, 1] > 0.5) == y0).all() and chain.weights[1][2] > 0
    one = toxicity.fit_chain(["a"], ["f0", "f1"], x, np.ones((400, 1)), np.arange(400) % 5)
    assert (one.scores(x) > 0.99).all()


def test_op3_equals_brute_force_over_several_tables(spark):
    rng = random.Random(5)
    vocab = ["Ab", "c", "é", "ß1", "x", "-", "yy", "YY"]

    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", ".."]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(3, "c c"), (None, "ß1 ß1"), (77, None)]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(150)] + [(500, items[5][1] * 3), (501, None), (502, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: r for r in brute.contamination(docs, items)}
    from corvid.llm import decontaminate
    for size in (decontaminate.TABLE_BYTES, 64):     # 64 bytes: many tables, one after the other
        got = rows(decontaminate.mark_contamination(d, b, table_bytes=size).select(
            "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated"))
        assert {r[0]: r for r in got} == want


def test_op3_cuts_a_very_long_item_without_losing_windows(spark, monkeypatch):
    from corvid.llm import decontaminate
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(k, " ".join(f"w{i}" for i in range(k, k + 10))) for k in range(31)]
    got = rows(decontaminate.mark_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).select("n_hit"))
    assert {r[0] for r in got} == {10}


def test_op4_round_trip(spark):
    docs = table("documents", "doc_id, text")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: e.ids + [0] for (d, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False))}
    got = queries.QUERIES["op4_pack"](spark, SF).collect()
    length, bins = dict.fromkeys(ids, 0), {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and (r.length == 2048 or r.piece == 0)
        length[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert length == {d: len(v) for d, v in ids.items()}
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    least = math.ceil(sum(length.values()) / 2048)
    assert least <= len(bins) <= 1.05 * least + 1


def test_op4_each_piece_goes_where_the_squares_are_least():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 20, 300)
    bins, offsets = pack.sum_of_squares(sizes, 20)
    level = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        assert o == level.get(b, 0) and o + s <= 20

        def squares(levels):
            gaps = [20 - v for v in levels.values() if v < 20]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        choices = [level | {k: v + s} for k, v in level.items() if v + s <= 20] + [level | {max(level, default=-1) + 1: s}]
        level[b] = o + s
        assert squares(level) == min(map(squares, choices))


def test_op4_odd_texts_take_the_slow_way_to_the_same_ids():
    enc = pack.Encoder(load(None))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("", "a<|endoftext|> b", "x" * 5000, " " * 5000 + "y", "日本語 😀 don't  \n\n x", "plain words"):
        assert enc(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert enc.fast is not None and enc.is_plain("plain words") and not enc.is_plain("x" * 5000)


def test_op5_equals_brute_force_with_many_blocks(spark):
    docs = [(d, t) for d, t in table("documents", "doc_id, text")] + [(9000, None), (9001, ""), (9002, "One one ONE"), (9003, "zzq")]
    want = brute.lm_scores(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for kw in ({}, {"block_bytes": 20_000, "table_grams": 20_000}):
        got = {r.doc_id: r for r in lmscore.score_documents(df, **kw).collect()}
        assert set(got) == set(want)
        for d, (n, unseen, s) in want.items():
            assert (got[d].n_words, got[d].n_unseen) == (n, unseen) and abs(got[d].log10_score - s) < 1e-6
        assert got[9000].score is None and got[9001].n_words == 0


def test_op6_equals_brute_force(spark):
    docs = table("documents", "doc_id, text")[:150]
    base = docs[3][1]
    docs += [(1000 + i, base.replace(" ", "  ", i)) for i in range(4)] + [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(simhash.near_groups(df))) == brute.simhash_groups(docs)


def test_op6_anchors_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for blocks in ([simhash.GOLAY, simhash.GOLAY], [simhash.GOLAY, simhash.GOLAY, simhash.HAMMING]):
        for flips in (0, 1, 2):
            other = base.copy()
            for _ in range(flips):
                other ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
            row, key, excess = simhash.anchors(base, blocks, 2)
            assert (np.bincount(row[excess == 0], minlength=300) == 1).all()
            home = dict(zip(row[excess == 0].tolist(), key[excess == 0].tolist()))
            row2, key2, _ = simhash.anchors(other, blocks, 2)
            visits = set(zip(row2.tolist(), key2.tolist()))
            assert all((i, home[i]) in visits for i in range(300))


def test_op6_links_equal_brute_force_and_chains_join(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.links(df, 2, [simhash.GOLAY, simhash.GOLAY]).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert got == want
    from corvid.llm.graph import components
    edges = spark.createDataFrame(sorted(want), "a long, b long")
    assert dict(rows(components(edges))) == {k: v for k, v in brute.components(want, {x for e in want for x in e}).items()}


def test_op7_keeps_one_of_repeated_rows_and_separates_nothing_else(spark):
    from corvid.llm.exactdup import exact_groups
    data = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (None, "b"), (5, "A")]
    got = sorted(rows(exact_groups(spark.createDataFrame(data, "doc_id long, text string"), keep="largest").drop("text_sha256")), key=repr)
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True),
                          (None, None, 2, True), (None, None, 2, False), (5, 5, 1, True)], key=repr)
    small = rows(exact_groups(spark.createDataFrame(data[:2], "doc_id long, text string")))
    assert {(r[0], r[1], r[3], r[4]) for r in small} == {(i, 1, i == 1, hashlib.sha256(b"a").hexdigest()) for i in (1, 2)}


def test_op8_equals_the_library(spark):
    docs = table("documents", "doc_id, text") + [(9000, None), (9001, ""), (9002, "a<|endoftext|>b" * 3), (9003, "a" * 3000 + "!" * 999),
                                               (9004, "日本語 😀😀   x\n\n  y"), (9005, "I'll don't 're")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in tokencount.count_tokens(spark.createDataFrame(docs, "doc_id long, text string"))
           .select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    for d, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 1024)


def test_op8_merger_equals_the_library_on_random_bytes(monkeypatch):
    assert SPLIT == public_tokenizers.PATTERN
    vocab = Vocabulary(load(None))
    merger = tokencount.RankMerger(vocab)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    words = ["".join(rng.choice("aabehinorst") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    assert merger.counts([w.encode() for w in words]).tolist() == [len(tok.encode(w).ids) for w in words]


@pytest.mark.parametrize("segment_lines", [linededup.SEGMENT_LINES, 2])
def test_op9_equals_brute_force(spark, monkeypatch, segment_lines):
    monkeypatch.setattr(linededup, "SEGMENT_LINES", segment_lines)     # 2: most groups are large ones
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 60))) for _ in range(30)]

    def changed(s, k):
        for _ in range(k):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1:], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1:]])
        return s
    docs = [(i, "\n".join(rng.choice([changed(rng.choice(base), rng.randrange(0, 5)), rng.choice(base), "", "short", " "])
                          for _ in range(rng.randrange(1, 6)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n\n")]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.text) for r in got.collect()} == brute.near_lines(docs)


@pytest.mark.parametrize("segment_lines", [linededup.SEGMENT_LINES, 2])
def test_op9_edits_grow_with_the_line(spark, monkeypatch, segment_lines):
    monkeypatch.setattr(linededup, "SEGMENT_LINES", segment_lines)
    rng = random.Random(11)
    lines = []
    for n in (30, 57, 60, 79, 120, 199, 200, 205, 260, 400, 700):
        base = "".join(rng.choice("abcdeé nor") for _ in range(n))
        lines.append(base)
        for k in sorted({1, 2, 3, n // 20, n // 20 + 1, n // 20 + 2}):
            s = list(base)
            # evenly spread edits leave the shortest runs
            for j in range(k):
                i = (2 * j + 1) * n // (2 * k)
                s[i] = rng.choice(["", s[i] + "X", "Y", "é"])
            lines.append("".join(s))
        for k in (n // 20, n // 20 + 1):
            i = rng.randrange(n - k)                                       # many edits in one place
            lines.append(base[:i] + "Z" * k + base[i + k:])
    rng.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    docs = [(i + 1, x) for i, x in enumerate(lines)]
    links = []
    want = brute.near_lines(docs, per=20, links=links)
    within = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 30
              and brute.edits(a, b) <= brute.limit(max(len(a), len(b)), 2, 20)]
    # all pairs within a class's own threshold are linked, and some far beyond it
    sure = [p for p in within if brute.edits(*p) <= (2 if max(map(len, p)) < 60 else 3)]
    assert len(sure) < len(links) <= len(within) and any(brute.edits(*p) > 15 for p in within)
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.text)
           for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), chars_per_edit=20).collect()}
    assert got == want


@pytest.mark.parametrize(("segment_lines", "pass_keys"), [(linededup.SEGMENT_LINES, linededup.PASS_KEYS), (2, 1)])
def test_op9_links_all_lines_within_the_limit(spark, monkeypatch, segment_lines, pass_keys):
    """Edits by length that leave no long run in place, all of them shifting what follows, are found."""
    monkeypatch.setattr(linededup, "SEGMENT_LINES", segment_lines)
    monkeypatch.setattr(linededup, "PASS_KEYS", pass_keys)             # one pass and several
    rng = random.Random(23)
    docs = []
    for n in (24, 41, 60, 80, 83, 100, 139, 140, 200, 299, 300, 431, 559, 600, 777, 1250, 2500):
        base = "".join(rng.choice("abcdefghiklmnop ") for _ in range(n))
        k = brute.limit(n, 2, 20)
        for kind in ("insert", "delete", "both", "replace", "one more"):
            s, many = list(base), k + (kind == "one more")
            for j in range(many):
                i = min(n - 1, (2 * j + 1) * n // (2 * many) + rng.randrange(-2, 3))
                s[i] = {"insert": s[i] + "X", "delete": "", "both": (s[i] + "X", "")[j < many // 2], "replace": "Y", "one more": "Z"}[kind]
            line = "".join(s)
            docs += [(len(docs), base), (len(docs) + 1, line)] if kind == "insert" else [(len(docs), line)]
    links = []
    want = brute.near_lines(docs, per=20, links=links)
    assert len(links) > 60
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.text)
           for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), chars_per_edit=20).collect()}
    assert got == want


def test_op9_orders_negative_ids_and_separates_null_ids(spark):
    a, b = "a line of more than twenty-four characters", "another line, as long as the one before it"
    docs = [(-5, f"{a}\n{b}\n{a}"), (-2, b), (3, a), (None, f"{a}\nfirst null"), (None, f"{b}\nsecond null")]
    got = {(r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(-5, f"{a}\n{b}"), (-2, ""), (3, ""), (None, "first null"), (None, "second null")}


def test_op9_links_nearly_all_lines_within_the_limit(spark):
    """Recall against all pairs of whole lines within the limit by length: rows with ids divisible by 50 against all."""
    docs = table("documents", "doc_id, text")
    lines = dict.fromkeys(ln for _, t in docs for ln in (t or "").split("\n") if len(ln) >= 24)
    queries_ = {ln for d, t in docs if d % 5 == 0 for ln in (t or "").split("\n")}
    classes = linededup.segment_classes(2, 24, 20)
    parts = {ln: brute.segments(ln, classes) for ln in lines}
    counts = {ln: np.bincount(np.frombuffer(ln.encode("utf-32-le"), "<u4") % 61, minlength=61) for ln in lines}
    found = every = 0
    for a in lines:
        if a not in queries_:
            continue
        for b in lines:
            most = brute.limit(max(len(a), len(b)), 2, 20)
            if a != b and abs(len(a) - len(b)) <= most and np.abs(counts[a] - counts[b]).sum() <= 2 * most and brute.edits(a, b) <= most:
                every += 1
                found += bool(parts[a][0] & parts[b][1] or parts[b][0] & parts[a][1])
    assert every >= 5 and found >= 0.9 * every


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_op9_band_equals_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(4, 25)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(b))
            b[i:i + rng.randrange(0, 2)] = rng.choice(["", "a", "é"])
            b = b or ["a"]
        pairs.append((a, "".join(b) + "bbbb"[:rng.randrange(0, 3)]))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) > k]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert sorted(rows(linededup.verified(df, "a", "b", k))) == sorted(p for p in pairs if brute.edits(*p) <= k)


def test_op9_plan_has_no_python(spark):
    df = queries.QUERIES["op9_line_dedup"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_op10_archives_read_back_byte_for_byte(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    data = [(7, "http://a", body), (3, "http://b", body), (5, "http://c\r\nd", "tiny"), (6, None, "tiny"), (8, "u", None), (None, "n", body),
            (9, "u", "é" * 80)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    path = str(tmp_path / "arc")
    warc.write_archives(df, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert (got["7"].record_type, got["7"].refers_to, bytes(got["7"].payload)) == ("revisit", "3", b"")
    assert got["3"].record_type == "response" and bytes(got["3"].payload) == body.encode() and got[None].record_type == "response"
    assert {got[k].record_type for k in ("5", "6", "8", "9")} == {"response"} and got["9"].payload_bytes == 160
    assert got["7"].payload_digest == hashlib.sha256(body.encode()).hexdigest() and got["7"].payload_bytes == len(body)
    # any Zstandard reader that knows the dictionary frame can read the file
    import struct

    import zstandard
    files = [p for p in (tmp_path / "arc").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    text = b""
    for p in files:
        raw = p.read_bytes()
        magic, n = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + n])).stream_reader(raw[8 + n:], read_across_frames=True)
        text += reader.read()
    assert text.count(b"WARC/1.1\r\n") == len(data) and text.count(b"WARC-Type: revisit") == 1


def test_op10_damaged_archives_raise(spark, tmp_path):
    body = "<p>" + "x" * 300 + "</p>"
    df = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", body + "y")], "page_id long, url string, html string")
    path = str(tmp_path / "arc")
    warc.write_archives(df, path)
    sound = warc.read_archives(spark, path)
    warc.check_revisits(sound)
    with pytest.raises(ValueError):
        warc.check_revisits(sound.where("page_id <> '1'"))
    with pytest.raises(ValueError):
        warc.check_revisits(sound.withColumn("payload_bytes", F.col("payload_bytes") + (F.col("record_type") == "revisit").cast("long")))
    # a record whose body is cut, or swapped for another, in a frame that decompresses well
    good = warc._record(1, "u", body.encode(), hashlib.sha256(body.encode()).hexdigest(), None)
    for bad in (good.replace(b"xxx", b"xyx", 1), warc._record(1, "u", body.encode()[:-1], hashlib.sha256(body.encode()).hexdigest(), None)):
        fields, payload = warc._parse(bad)
        with pytest.raises(ValueError):
            warc._check(fields, payload)
    warc._check(*warc._parse(good))
    files = [p for p in (tmp_path / "arc").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[:len(whole) * 2 // 3])
    (tmp_path / "arc" / f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        warc.read_archives(spark, path).collect()


def test_hot_keys_join_by_broadcast(spark, monkeypatch):
    from corvid.llm import common
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows_ = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(100)], "i long, k long")
    keyed = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 4 = 0")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows_.join(keyed, "k", how).select("i", "k", "n").collect()))
        assert sorted(map(tuple, common.join_by_share(rows_, keyed, ["k"], "n", 100, how).select("i", "k", "n").collect())) == want
