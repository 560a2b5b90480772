"""The conversation trie against a plain trie, with odd rows, one hot beginning and clashing columns."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corvid.llm import convtrie

CONV = "conv_id long, turn int, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, heads=6):
    """Node by node: dictionaries of paths to members."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + v[h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for path, own_members in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below)]
        ends = ",".join(str(c) for c in sorted(own_members) if len(built[c]) == len(path))
        out.append((min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), len(kids), len(leaves),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in convtrie.shared_prefixes(df).drop("path", "parent_path").collect()), key=repr)


@pytest.mark.parametrize("shard, segment", [(convtrie.SHARD, convtrie.SEGMENT), (7, 2), (1000, 1), (100, 3)])
def test_equals_a_plain_trie(spark, monkeypatch, shard, segment):
    monkeypatch.setattr(convtrie, "SHARD", shard)
    monkeypatch.setattr(convtrie, "SEGMENT", segment)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), "same first turn" if t == 0 and c % 3 else rng.choice(["a", "bb", "", "é日"]))
            for c in rng.sample(range(-150, 420), 260) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, CONV)
    assert got(df) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "a", "b"), (None, 0, "user", "no id"), (2, 5, "", ""),
            (2, -1, "user", "y" * 50_000), (100, 0, "user", "base"), (100, 1, "user", "base"), (103, 0, "user", "own"), (-7, 0, "u", "neg"),
            *[(300, t, "user", "long") for t in range(3000)], *[(301, t, "user", "long") for t in range(3000)]]
    df = spark.createDataFrame(rows, CONV)
    some = [r for r in rows if r[0] not in (300, 301)]
    assert got(df.where("conv_id is null or conv_id not in (300, 301)")) == brute(some)
    clash = df.select("*", *[F.lit("theirs").alias(c) for c in ("c", "pos", "n", "h", "base", "shard", "depth", "key", "n_convs")])
    whole = got(df)
    assert whole == got(clash) and max(r[1] for r in whole) >= 2999
    root = next(r for r in whole if r[1] == 0)
    assert root[2] is None and root[3] == 7


def test_empty_table_and_missing_base(spark):
    assert got(spark.createDataFrame([], CONV)) == []
    rows = [(c, 0, "user", "only") for c in range(201, 260)]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, CONV)) == want and any(r[1] == 0 and r[3] == 59 for r in want)


def test_long_conversations_in_segments(spark, monkeypatch):
    """Many segments give what one walk gives; a conversation with most of the rows is many groups."""
    rows = spark.range(12_000).select(F.lit(700).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 97).cast("string").alias("text"))
    other = rows.where("turn < 9000").withColumn("conv_id", F.lit(701))
    third = rows.where("turn < 8000").withColumn("conv_id", F.lit(703)).withColumn("text", F.when(F.col("turn") == 5000, "else").otherwise(F.col("text")))
    df = rows.unionAll(other).unionAll(third).unionAll(rows.limit(0)).withColumn("conv_id", F.col("conv_id").cast("long"))
    monkeypatch.setattr(convtrie, "SEGMENT", 10**6)
    whole = got(df)
    monkeypatch.setattr(convtrie, "SEGMENT", 1000)
    assert got(df) == whole and max(r[1] for r in whole) >= 11_990
    _, turn_rows = convtrie.rebuilt(convtrie.turns(df))
    assert turn_rows.select("c", "pos").distinct().count() == turn_rows.count()
