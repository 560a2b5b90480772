"""Key ranges, staged builds that are run again, table-function sources, the interleave by prefix counts."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corvid.operators import corpus as C
from corvid.plans import corpus_build as B
from corvid.plans.ordering import KeyRanges, key_ranges
from corvid.sources.registry import REGISTRY, register_table_function


@pytest.fixture()
def pairs(spark):
    rows = [(i * i * 7919 - 10**12, f"question {i}", None if i % 9 == 0 else f"answer {i}") for i in range(300)]
    return spark.createDataFrame(rows, "raw_id long, query string, answer string").repartition(6)


@pytest.mark.parametrize("rows", [1, 7, 50, 1000])
def test_sparse_keys_rank_like_a_sort(spark, rows):
    rng = random.Random(rows)
    keys = [rng.randrange(-2**62, -300) if i % 2 else rng.randrange(300, 2**62) for i in range(700)] + list(range(300))
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").repartition(7)
    ranges = key_ranges({"a": (df, "k"), "b": (df.where("k > 0"), "k"), "none": (df.limit(0), "k")}, rows)
    assert sum(ranges["a"].counts) == 1000 and ranges["none"].counts in ((0,), tuple([0] * len(ranges["none"].counts)))
    if rows > 1:
        assert max(ranges["a"].counts) <= 3 * rows and len(ranges["a"].counts) >= 1000 // (2 * rows)
    got = {r.k: r.i for r in C.with_raw_index(df, "k", ranges["a"], "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_random_keys_leave_one_row_per_range_to_order(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    ranges = key_ranges({"t": (df, "k")}, 1000)["t"]
    assert 150 <= len(ranges.counts) <= 250 and sum(ranges.counts) == 200_000 and max(ranges.counts) < 2000
    assert ranges.through(0) == 0 and ranges.through(1) == 1 and ranges.through(200_000) == len(ranges.counts)
    top = C.with_raw_index(df, "k", ranges).agg(F.max("raw_idx"), F.count_distinct("raw_idx")).first()
    assert tuple(top) == (199_999, 200_000)
    many = KeyRanges(tuple(range(0, 3000, 3)), ())
    got = [r.b for r in spark.range(-2, 3100, 1, 1).select(many.bucket(F.col("id")).alias("b")).collect()]
    assert got == [sum(b <= k for b in many.bounds) for k in range(-2, 3100)]


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_a_build_goes_on_where_it_stopped(spark, pairs, monkeypatch):
    path = tempfile.mkdtemp(prefix="corvid-stage-", dir="/tmp") + "/build"

    def build(stage_path=None):
        return B.build_corpus(spark, [B.CorpusSource("code_feedback", 1.0, pairs)], 200, context_length=512, first_rows=20, stage_path=stage_path)
    want = _rows(build().mixed, "split", "mix_idx", "source", "raw_idx")
    made, once = [], B.Stage.once

    def failing(self, name, made_from, make):
        def counted():
            made.append(name)
            if name == "samples-00002" and made.count(name) == 1:
                raise OSError("lost")
            return make()
        return once(self, name, made_from, counted)
    monkeypatch.setattr(B.Stage, "once", failing)
    with pytest.raises(OSError):
        build(path).mixed.count()
    first = list(made)
    assert first[:2] == ["samples-00000", "samples-00001"]
    res = build(path)
    assert _rows(res.mixed, "split", "mix_idx", "source", "raw_idx") == want
    # finished rounds are read, not made again; another mix does not trust them
    assert made[len(first)] == "samples-00002" and made.count("samples-00000") == 1
    n = len(made)
    assert _rows(build(path).mixed, "split", "mix_idx", "source", "raw_idx") == want and len(made) == n
    other = B.build_corpus(spark, [B.CorpusSource("code_feedback", 1.0, pairs)], 100, context_length=512, first_rows=20, stage_path=path)
    assert other.samples.count() > 0 and made.count("samples-00000") == 2
    other.close()
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/samples-00000").count()


def test_diagnostics_read_no_token_arrays(spark, pairs):
    res = B.build_corpus(spark, [B.CorpusSource("code_feedback", 1.0, pairs)], 200, context_length=512)
    d = res.diagnostics
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.first().samples_collected == 200 and "ReadSchema" in plan and "input_ids" not in plan
    assert "input_ids" not in res.split_keys.columns


def test_table_function_source_counts_its_reasons(spark, pairs):
    class Shape:
        def eval(self, query, answer):
            if answer is None:
                yield None, "no answer"
            elif query.endswith("5"):
                return
            else:
                yield [[("user", query), ("assistant", answer)]], None

    register_table_function("own_pairs", Shape, ("query", "answer"))
    try:
        res = B.build_corpus(spark, [B.CorpusSource("own_pairs", 1.0, pairs)], 1000, context_length=512)
        got = {r.reject_reason: r.n_rows for r in res.reject_reasons.collect()}
        n_none = sum(i % 9 == 0 for i in range(300))
        n_five = sum(i % 9 != 0 and str(i).endswith("5") for i in range(300))
        assert got == {"no answer": n_none, None: n_five}
        d = res.diagnostics.first()
        assert d.format_rejected == n_none + n_five and d.samples_collected == 300 - n_none - n_five and d.exhausted
    finally:
        del REGISTRY["own_pairs"]


def serial_mix(rows, names, weights, seed, label):
    import hashlib
    queue = {s: sorted(k for src, k in rows if src == s) for s in names}
    taken, out = {s: 0 for s in names}, []
    for k in range(len(rows)):
        u = int(hashlib.md5(f"{seed}-draw-{label}-{k}".encode()).hexdigest()[:8], 16) / 2**32
        s, cum = names[-1], 0.0
        for name, w in zip(names[:-1], weights[:-1]):
            cum += w
            if u < cum:
                s = name
                break
        if taken[s] == len(queue[s]):
            return out
        out.append((label, k, s, queue[s][taken[s]]))
        taken[s] += 1
        if taken[s] == len(queue[s]):
            return out
    return out


@pytest.mark.parametrize("width", [3, 64, 4096])
def test_interleave_equals_serial_draws(spark, width):
    rng = random.Random(width)
    names, weights = ["a", "b", "c"], [0.5, 0.3, 0.2]
    rows = {"train": [(rng.choice(names), f"{rng.random():.9f}") for _ in range(400)], "eval": [(rng.choice("ab"), f"{rng.random():.9f}") for _ in range(30)]}
    import hashlib
    keyed = [(label, s, hashlib.md5(k.encode()).hexdigest()) for label, own in rows.items() for s, k in own]
    df = spark.createDataFrame(keyed, "split string, source string, shuffle_key string")
    got = sorted(tuple(r) for r in C.interleave_splits(df, names, weights, 42, ("train", "eval"), width).select("split", "mix_idx", "source", "shuffle_key").collect())
    want = [x for label in rows for x in serial_mix([(s, k) for split, s, k in keyed if split == label], names, weights, 42, label)]
    assert got == sorted(want) and len(want) > 100
