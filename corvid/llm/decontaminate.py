"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of every benchmark
item (an item of fewer words is one window).  Patterns of one length form a
group with the tables of Wu and Manber, whose alphabet is words here:

* a *shift table* over hashed blocks of two words says how far the window may
  move because no pattern has that block nearer to its end;
* a zero shift opens the *bucket* of patterns that end in the same block;
* patterns whose first block agrees are *compared directly*: word by word, and
  each word's bytes once, so that a hash collision never counts.

Many texts are searched at once: each text is cut into lanes of window ends that
advance together by their own shifts.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import bound_batches, cut, ragged, row_ranges, text_buffer

#: Words of a benchmark window.
WINDOW = 10
#: Benchmark text per pattern table; a larger benchmark is searched table by table.
TABLE_BYTES = 8 << 20
#: Tables that one pass of tasks holds; then the documents are written and read again.
PASS_TABLES = 8
#: Words of one piece of a very long benchmark item (pieces overlap by a window less one word).
PIECE_WORDS = 50_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LANE = 256
_K = np.uint64(0x9E3779B97F4A7C15)


class Patterns:
    """Pattern tables of a list of ``(ids of the items that have it, text)``."""

    def __init__(self, items: list[tuple[list[str], str]], window: int):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        low, starts, ends, counts = wordhash.words(offsets, np.frombuffer(b"".join(raw), np.uint8))
        hashed = wordhash.hashes(low, starts, ends)
        # vocabulary of pattern words: hash -> id and bytes
        spelled = [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        ids: dict[bytes, int] = {}
        of_word = np.array([ids.setdefault(w, len(ids)) for w in spelled], np.int64)
        vocab = list(ids)
        self.word_len = np.array([len(w) for w in vocab], np.int64)
        self.word_at = np.cumsum(self.word_len) - self.word_len
        self.word_bytes = np.frombuffer(b"".join(vocab), np.uint8)
        by_id = np.zeros(len(vocab), np.uint64)
        by_id[of_word] = hashed
        order = np.argsort(by_id, kind="stable")
        self.vocab_hash, self.vocab_id = by_id[order], order
        # distinct windows and the items that hold each
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        at = 0
        for (ids_of, _), n in zip(items, counts, strict=True):
            own = of_word[at:at + n].tolist()
            at += n
            size = min(window, n)
            for i in range(n - size + 1 if n else 0):
                owners[size][tuple(own[i:i + size])].update(ids_of)
        self.groups = [Group(size, wins, by_id) for size, wins in sorted(owners.items())]

    def word_ids(self, low, starts, ends, hashed, at: np.ndarray) -> np.ndarray:
        """Vocabulary ids of the words at positions ``at`` (-1: none), bytes compared."""
        out = np.full(len(at), -1, np.int64)
        if not len(at) or not len(self.vocab_hash):
            return out
        h = hashed[at]
        lo = np.searchsorted(self.vocab_hash, h, "left")
        hi = np.searchsorted(self.vocab_hash, h, "right")
        while len(todo := np.flatnonzero((lo < hi) & (out < 0))):
            cand = self.vocab_id[lo[todo]]
            size = ends[at[todo]] - starts[at[todo]]
            same = self.word_len[cand] == size
            todo_same, cand, size = todo[same], cand[same], size[same]
            if len(todo_same):
                equal = low[ragged(starts[at[todo_same]], size)] == self.word_bytes[ragged(self.word_at[cand], size)]
                equal = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                out[todo_same[equal]] = cand[equal]
            lo[todo] += 1
        return out


class Group:
    """Wu-Manber tables of the distinct patterns of one length."""

    def __init__(self, size: int, windows: dict[tuple, set], word_hash: np.ndarray):
        self.size, self.block = size, min(2, size)
        self.words = np.array(list(windows), np.int64).reshape(len(windows), size)
        self.items = [sorted(x) for x in windows.values()]
        self.bits = max(12, int(np.ceil(np.log2(len(windows) * size + 1))) + 4)
        hashed = word_hash[self.words]
        self.shift = np.full(1 << self.bits, size - self.block + 1, np.int64)
        for j in range(self.block, size + 1):
            np.minimum.at(self.shift, self.slot(hashed[:, j - self.block], hashed[:, j - 1]), size - j)
        last = self.slot(hashed[:, size - self.block], hashed[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))
        self.first = self.code(hashed[:, 0], hashed[:, self.block - 1])

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * _K) ^ b if self.block == 2 else b

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.code(a, b) * _K) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, hashed: np.ndarray, first: np.ndarray, counts: np.ndarray):
        """Candidates ``(start word, pattern)``: equal first and last blocks."""
        ends = np.maximum(counts - self.size + 1, 0)
        lanes = -(-ends // _LANE)
        k = ragged(np.zeros(len(counts), np.int64), lanes)
        begin = np.repeat(first + self.size - 1, lanes) + k * _LANE
        stop = np.minimum(begin + _LANE, np.repeat(first + counts, lanes))
        hits = []
        while len(begin):
            jump = self.shift[self.slot(hashed[begin - self.block + 1], hashed[begin])]
            if (zero := jump == 0).any():
                hits.append(begin[zero])
            begin = begin + np.maximum(jump, 1)
            alive = begin < stop
            begin, stop = begin[alive], stop[alive]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        slot = self.slot(hashed[at - self.block + 1], hashed[at])
        many = self.bucket[slot + 1] - self.bucket[slot]
        start = np.repeat(at - self.size + 1, many)
        pattern = self.order[ragged(self.bucket[slot], many)]
        same = self.code(hashed[start], hashed[start + self.block - 1]) == self.first[pattern]
        return start[same], pattern[same]


def search(tables: Patterns, offsets: np.ndarray, raw: np.ndarray):
    """Per text: words, merged hit intervals ``[s0, e0, s1, e1, ...]``, sorted item ids."""
    low, starts, ends, counts = wordhash.words(offsets, raw)
    hashed = wordhash.hashes(low, starts, ends)
    first = np.cumsum(counts) - counts
    spans: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for group in tables.groups:
        start, pattern = group.search(hashed, first, counts)
        if not len(start):
            continue
        need = np.unique((start[:, None] + np.arange(group.size)).ravel())
        ids = tables.word_ids(low, starts, ends, hashed, need)
        found = ids[np.searchsorted(need, start[:, None] + np.arange(group.size))]
        real = (found == group.words[pattern]).all(axis=1)
        start, pattern = start[real], pattern[real]
        text = np.searchsorted(first, start, "right") - 1
        for t, s, p in zip(text.tolist(), (start - first[text]).tolist(), pattern.tolist(), strict=True):
            spans[t].append((s, s + group.size))
            items[t].update(group.items[p])
    return counts, spans, items


def _merged(spans) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _searcher(shared, text_col: str, keep_text: bool):
    def run(batches):
        tables = Patterns(*shared.value)
        for batch in batches:
            offsets, raw = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            old_hits = batch.column(batch.schema.get_field_index("_hits")).to_pylist()
            old_items = batch.column(batch.schema.get_field_index("_items")).to_pylist()
            n_words, hits, found = [], [], []
            for i, j in row_ranges(offsets, 1 << 20):
                own = offsets[i:j + 1] - offsets[i]
                counts, spans, items = search(tables, own, raw[offsets[i]:offsets[j]])
                n_words += counts.tolist()
                for k in range(j - i):
                    was = old_hits[i + k]
                    hits.append(_merged(spans.get(k, []) + list(zip(was[::2], was[1::2], strict=True))))
                    found.append(sorted(items.get(k, set()) | set(old_items[i + k])))
            new = {"_words": pa.array(n_words, pa.int64()), "_hits": pa.array(hits, pa.list_(pa.int64())),
                   "_items": pa.array(found, pa.list_(pa.string()))}
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)
                    if n not in new and (keep_text or n != text_col)}
            yield pa.RecordBatch.from_pydict(cols | new)
    return run


def item_pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, piece)``: each item's words joined by blanks; a very long item is cut
    into overlapping pieces, so that every window lies in one piece."""
    # lower() folds more than A-Z
    ascii_low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.regexp_extract_all(ascii_low, F.lit(f"({_WORD})"), F.lit(1))
    df = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), w.alias("w"))
    df = df.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS))
    return df.select("item", F.explode(F.transform(starts, lambda s: F.array_join(
        F.slice("w", s + 1, PIECE_WORDS + window - 1), " "))).alias("piece"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW,
                       table_bytes: int = TABLE_BYTES, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a
    benchmark window), ``n_items``, ``item_ids`` (ascending, as strings) and ``contaminated``.

    A null or empty text has no words and no hits.  A benchmark row without words has no
    windows; a null ``item_id`` reads as ``"null"``; rows that repeat an item count once.
    Repeated documents are searched one by one.  Columns of ``docs`` named like a result
    column are replaced.  ``keep_text`` carries the text through.

    The benchmark is measured first: each pattern table holds at most about ``table_bytes``
    of its distinct text, and a larger benchmark is searched table by table in narrow passes,
    without a shuffle of the documents; ``PASS_TABLES`` of them run as one chain."""
    spark = docs.sparkSession
    bound_batches(spark)
    results = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    docs = docs.drop(*results).withColumns({"_hits": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    # a text that many items share is one piece with their ids
    pieces = item_pieces(benchmark, window).groupBy("piece").agg(F.sort_array(F.collect_set("item")).alias("items"))
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n_tables = max(1, -(-total // table_bytes))
    part = F.pmod(F.xxhash64("piece"), F.lit(n_tables))
    for k in range(n_tables):
        own = [(r["items"], r["piece"]) for r in pieces.where(part == k).collect()]
        shared = spark.sparkContext.broadcast((own, window))
        last = k == n_tables - 1
        fields = [f for f in docs.schema.fields if f.name != "_words" and (f.name != text_col or keep_text or not last)]
        fields = [f for f in fields if f.name not in ("_hits", "_items")]
        schema = T.StructType(fields + [T.StructField("_words", T.LongType()),
                                        T.StructField("_hits", T.ArrayType(T.LongType())),
                                        T.StructField("_items", T.ArrayType(T.StringType()))])
        docs = docs.mapInArrow(_searcher(shared, text_col, keep_text or not last), schema)
        if not last and k % PASS_TABLES == PASS_TABLES - 1:
            docs = cut(docs)
    n_hit: Column = F.aggregate(F.transform("_hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                                F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select(*[c for c in docs.columns if c not in ("_words", "_hits", "_items")],
                       F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
                       F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("item_ids"),
                       (F.size("_hits") > 0).alias("contaminated"))
