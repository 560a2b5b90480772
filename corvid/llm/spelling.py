"""Spelling variants: words one edit apart, found by a frontier over a relational trie.

Words are counted over all documents, then kept in two tries, one of the words and one of
the words read backwards, as tables of edges ``(node, label, child)``.  A node is a prefix,
known by a hash; chains without a branch are one edge with a longer label.  A word's states
``(word, position, node, edits)`` are joined with the edges level by level: without an edit
a state goes down its own path and, where an edge leaves that path, takes the one edit that
the edge asks for (replaced, inserted or deleted code point, placed at the first
difference); with an edit it follows only the edge that spells what is left.  States that
reach a word's end with one edit are neighbours.

Two words one edit apart agree up to the edit and after it, so either what comes before
is at least half of the word or what comes after is.  The forward trie only takes edits in
the second half, the backward trie the others: states start half-way down their own path,
and no node near a root, where every word would meet, is ever joined.  A word enters the
tries only below the half of the shortest word that may visit it.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, row_ranges, text_buffer
from .wordhash import LOWER

LETTER = "[a-zÀ-ÿ]"
#: One in so many (document, run) pairs loses a code point.
DROP_ONE_IN = 199
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 400_000
#: A text's runs are counted this many at a time.
HELD_RUNS = 1 << 16
#: Modulus and base of the prefix hashes.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)`` of all words of at least ``min_chars`` code points with ``n >= min_count``.

    Words are maximal runs of Latin letters (A-Z lower-cased); where 199 divides the crc32 of
    ``<id>:<run>``, the code point ``crc32 % length`` is left out.  A null text has no words;
    a null id is written as nothing."""
    bound_batches(docs.sparkSession)
    # taking a code point out never makes a run longer, so shorter runs need not be looked at
    pattern = re.compile(f"{LETTER}{{{min_chars},}}")

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            offsets, raw = text_buffer(batch.column(1))
            low = LOWER[raw]
            for i, j in row_ranges(offsets, 1 << 20):
                for row in range(i, j):
                    text = low[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    begin = zlib.crc32(f"{'' if ids[row] is None else ids[row]}:".encode())
                    found = pattern.finditer(text) if len(text) > 1 << 20 else None
                    while True:
                        own = Counter(m.group() for m in islice(found, HELD_RUNS)) if found else Counter(pattern.findall(text))
                        for word, n in own.items():
                            h = zlib.crc32(word.encode(), begin)
                            if h % DROP_ONE_IN == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < min_chars:
                                    continue
                            held[word] += n
                        if len(held) >= HELD_WORDS:
                            yield _batch(held)
                            held = Counter()
                        if not found or not own:
                            break
        if held:
            yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counted = docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def start(length: int, back: bool) -> int:
    """Depth at which a word's own states begin; edits above it are left to the other trie."""
    return length // 2 if back else (length + 1) // 2


def prefix_hashes(text: str, back: bool) -> list[int]:
    """A hash of every prefix, the empty one first; the two tries do not share nodes."""
    h = 2 if back else 1
    out = [h]
    for c in text:
        h = (h * BASE + ord(c) + 7) % PRIME
        out.append(h)
    return out


def _spelled(batches, rows):
    """``rows(word, n, back, text)`` of every word in both directions, as batches of a bounded size."""
    out = []
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for row in rows(*values):
                out.append(row)
                if len(out) >= 1 << 16:
                    yield out
                    out = []
    if out:
        yield out


def _as_batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


_STEP = [("node", pa.int64()), ("next", pa.string()), ("id", pa.int64()), ("back", pa.bool_()), ("depth", pa.int32())]
_EDGE = [("node", pa.int64()), ("label", pa.string()), ("child", pa.int64()), ("word", pa.string()), ("n", pa.int64())]
_STATE = [("text", pa.string()), ("back", pa.bool_()), ("pos", pa.int32()), ("node", pa.int64()), ("edits", pa.int32()),
          ("near", pa.string()), ("near_n", pa.int64())]


def _schema(fields) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {kinds[k]}" for n, k in fields)


def trie(words: DataFrame) -> DataFrame:
    """The edges ``(node, label, child, word, n, ahead)`` of both tries: ``word`` where one ends at the
    child, ``ahead`` the code points that go on from the child."""
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")

    def steps(batches):
        def rows(key, word, _):
            for back in (False, True):
                text = word[::-1] if back else word
                hashes = prefix_hashes(text, back)
                for d in range(start(len(word) - 1, back), len(word) + 1):
                    yield hashes[d], text[d:d + 1], key, back, d
                # nodes where states begin and words end are kept
                yield hashes[start(len(word), back)], "^", None, None, None
                yield hashes[-1], "^", None, None, None
        for out in _spelled(batches, rows):
            yield _as_batch(out, _STEP)

    every = named.mapInArrow(steps, _schema(_STEP))
    kept = every.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a <> b").select("node")
    depths = (every.where("id is not null").join(kept, "node").groupBy("id", "back").agg(F.sort_array(F.collect_set("depth")).alias("depths")))

    def edges(batches):
        def rows(_, word, n, back, depths):
            text = word[::-1] if back else word
            hashes = prefix_hashes(text, back)
            for a, b in zip(depths, depths[1:]):
                last = b == len(word)
                yield hashes[a], text[a:b], hashes[b], word if last else None, n if last else None
        for out in _spelled(batches, rows):
            yield _as_batch(out, _EDGE)

    # an inner edge comes from every word below it; the exchange by node is the one the frontier needs
    found = named.join(depths, "id").select("id", "word", "n", "back", "depths").mapInArrow(edges, _schema(_EDGE))
    found = cut(found.groupBy("node", "label", "child").agg(F.max("word").alias("word"), F.max("n").alias("n")))
    ahead = found.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("ahead"))
    return found.join(ahead, "child", "left")


def advance(text: str, pos: int, edits: int, label: str):
    """Where a state can be after an edge: ``(position, edits)``."""
    size, left = len(label), len(text)
    if edits:
        return [(pos + size, 1)] if text[pos:pos + size] == label else []
    k = 0
    while k < size and pos + k < left and text[pos + k] == label[k]:
        k += 1
    if k == size:
        return [(pos + size, 0)]
    at, out = pos + k, []
    if at < left and pos + size <= left and text[at + 1:pos + size] == label[k + 1:]:
        out.append((pos + size, 1))                       # another code point
    if pos + size - 1 <= left and text[at:pos + size - 1] == label[k + 1:]:
        out.append((pos + size - 1, 1))                   # one more in the other word
    if at < left and pos + size + 1 <= left and text[at + 1:pos + size + 1] == label[k:]:
        out.append((pos + size + 1, 1))                   # one less in the other word
    return out


def _moves(batches):
    def rows(text, back, pos, edits, label, child, other, n, ahead):
        for p, e in advance(text, pos, edits, label):
            # the other word may end here, or with this word's last code point left out
            if other is not None and p == len(text) - (1 - e):
                yield text, back, p, child, e, other, n
            # with an edit taken, only what goes on with the next code point lives
            if ahead and (e == 0 or p < len(text) and text[p] in ahead):
                yield text, back, p, child, e, None, None
    for out in _spelled(batches, rows):
        yield _as_batch(out, _STATE)


def _may_move() -> Column:
    """What ``advance`` and the look-ahead leave of a joined state and edge, told from two code points of each."""
    def at(text: str, place, size=1):
        return F.substring(F.col(text), place, F.lit(size))
    c1, c2 = at("s.text", F.col("pos") + 1), at("s.text", F.col("pos") + 2)
    l1, l2 = at("label", F.lit(1)), at("label", F.lit(2))
    ahead = F.coalesce("ahead", F.lit(""))
    short = F.contains(ahead, c1) | F.contains(ahead, c2) | (l1 == c2) | F.col("e.word").isNotNull()
    fresh = (l1 == c1) | F.when(F.length("label") == 1, short).otherwise((l1 == c2) | (l2 == c1) | (l2 == c2))
    return F.when(F.col("edits") == 0, fresh).otherwise(F.substring(F.col("s.text"), F.col("pos") + 1, F.length("label")) == F.col("label"))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every pair of different ``words (word, n)`` that one inserted, deleted
    or replaced code point turns into each other, in both orders; ``near_n`` is the ``n`` of ``near``."""
    edges = cut(trie(words))

    def begin(batches):
        def rows(word):
            for back in (False, True):
                text, at = word[::-1] if back else word, start(len(word), back)
                yield text, back, at, prefix_hashes(text[:at], back)[at], 0, None, None
        for out in _spelled(batches, rows):
            yield _as_batch(out, _STATE)

    states, found = words.select("word").mapInArrow(begin, _schema(_STATE)), []
    while True:
        met = states.alias("s").join(edges.alias("e"), "node").where(_may_move())
        moved = cut(met.select("s.text", "back", "pos", "edits", "label", "child", F.col("e.word").alias("other"), F.col("e.n").alias("other_n"), "ahead")
                    .mapInArrow(_moves, _schema(_STATE)))
        word = F.when(F.col("back"), F.reverse("text")).otherwise(F.col("text"))
        found.append(moved.where("near is not null").select(word.alias("word"), "near", "near_n"))
        states = moved.where("near is null").drop("near", "near_n")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    # a pair may be found from both ends; hashes of prefixes are confirmed by the words themselves
    return pairs.distinct().where(F.levenshtein("word", "near", 1) == 1)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of ``words (word, n)``: ``form`` (its near word of largest ``n``, ties: the smallest, if that
    ``n`` is at least ``ratio`` times the word's; else null), ``root`` (the last of the forms from the
    word on; the word itself if none), ``n``, ``n_near`` and ``form_n``.  No words give no rows."""
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("top"))
    top = -F.col("top.n")
    formed = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(top >= ratio * F.col("n"), x).alias(c) for x, c in ((F.col("top.near"), "form"), (top, "form_n"))]))
    # every form is ratio times as frequent, so chains are short; each round doubles the steps taken
    jump = formed.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = jump.select(F.col("word").alias("to"), F.col("to").alias("then"))
        longer = cut(jump.join(further, "to", "left").select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        jump = longer.select("word", "to")
        if longer.where("moved").isEmpty():
            break
    return formed.join(jump, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **names) -> DataFrame:
    """``variants`` of the words of ``docs`` (see ``word_counts``); an empty table gives no rows."""
    return variants(cut(word_counts(docs, **names)))
