"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays of symbols, many at a time.  In each round
every sequence finds the lowest rank among its adjacent pairs and merges all
occurrences of that pair, left to right; all sequences do so at once.  A sequence
without a mergeable pair is done, and its surviving symbols are its token count.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches
from .pretokens import Vocabulary, byte_symbols, load

#: Distinct pre-tokens whose counts a worker remembers; beyond it starts afresh.
REMEMBERED = 300_000
#: Longest pre-token that is remembered.
_SHORT = 64
_NONE = np.iinfo(np.int64).max


class RankMerger:
    """Merge tables of a byte-level BPE vocabulary."""

    def __init__(self, vocab: Vocabulary):
        ids, symbols = vocab.ids, byte_symbols()
        self.byte_id = np.array([ids[s] for s in symbols], np.int64)
        self.size = max(ids.values()) + 1
        left = np.array([ids[a] for a, _ in vocab.merges], np.int64)
        right = np.array([ids[b] for _, b in vocab.merges], np.int64)
        made = np.array([ids[a + b] for a, b in vocab.merges], np.int64)
        code = left * self.size + right
        order = np.argsort(code, kind="stable")
        # an open hash table of the pair codes: one probe for most pairs
        self.bits = int(np.ceil(np.log2(len(code) + 1))) + 3
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int64)
        todo = order[np.unique(code[order], return_index=True)[1]]  # the first rank of a pair
        slot = self._slot(code[todo])
        while len(todo):
            free = self.keys[slot] < 0
            firsts = np.zeros(len(todo), bool)
            firsts[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = firsts & free
            self.keys[slot[put]], self.rank[slot[put]] = code[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
        self.made = made

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, code: np.ndarray) -> np.ndarray:
        slot = self._slot(code)
        out = np.full(len(code), _NONE, np.int64)
        todo = np.arange(len(code))
        while len(todo):
            key = self.keys[slot]
            same = key == code[todo]
            out[todo[same]] = self.rank[slot[same]]
            more = ~same & (key >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = size.copy()
        symbol = self.byte_id[np.frombuffer(b"".join(texts), np.uint8)]
        seq = np.repeat(np.arange(len(texts)), size)
        # rank of the pair that begins at each symbol
        rank = self._pair_ranks(symbol, seq)
        while len(symbol):
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(seq)))
            done = low == _NONE
            out[seq[first[done]]] = length[done]
            if done.all():
                break
            if done.any():
                live = np.repeat(~done, length)
                symbol, seq, rank = symbol[live], seq[live], rank[live]
                length, low = length[~done], low[~done]
            hit = rank == np.repeat(low, length)
            # of overlapping occurrences (aaa) merge the first, third, ... of each run
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]
            symbol[at] = self.made[rank[at]]
            alive = np.ones(len(symbol), bool)
            alive[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, seq, rank, changed = symbol[alive], seq[alive], rank[alive], changed[alive]
            redo = changed.copy()
            redo[:-1] |= changed[1:]
            where = np.flatnonzero(redo)
            rank[where] = self._pair_ranks(symbol, seq, where)
        return out

    def _pair_ranks(self, symbol, seq, where=None) -> np.ndarray:
        where = np.arange(len(symbol)) if where is None else where
        out = np.full(len(where), _NONE, np.int64)
        inside = np.flatnonzero(where + 1 < len(symbol))
        inside = inside[seq[where[inside]] == seq[where[inside] + 1]]
        i = where[inside]
        out[inside] = self.ranks(symbol[i] * self.size + symbol[i + 1])
        return out


def _counter(shared, text_col: str):
    def run(batches):
        vocab = Vocabulary(shared.value)
        merger = RankMerger(vocab)
        known: dict[str, int] = dict.fromkeys(vocab.special, 1)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            totals = []
            # a bounded run of texts at a time
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < 1 << 20):
                    n += len(texts[j] or "")
                    j += 1
                split = [vocab.pieces(t) if t else [] for t in texts[i:j]]
                new = list(set().union(*split).difference(known))
                counted = merger.counts([p.encode() for p in new])
                fresh = dict(zip(new, counted.tolist(), strict=True))
                if len(known) + len(fresh) > REMEMBERED:
                    known = dict.fromkeys(vocab.special, 1)
                    missing = set().union(*split).difference(known, fresh)
                    gone = list(missing)
                    fresh |= dict(zip(gone, merger.counts([p.encode() for p in gone]).tolist(), strict=True))
                look = known | fresh if len(fresh) * 4 > len(known) else _Both(known, fresh)
                get = look.__getitem__
                totals += [sum(map(get, pieces)) for pieces in split]
                known.update((p, c) for p, c in fresh.items() if len(p) <= _SHORT)
                i = j
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if k != at}
            yield pa.RecordBatch.from_pydict(cols | {"n_tokens": pa.array(totals, pa.int64())})
    return run


class _Both(dict):
    """``known`` with the few new entries before it, without a copy of ``known``."""

    def __init__(self, known, fresh):
        super().__init__(fresh)
        self._known = known

    def __missing__(self, key):
        return self._known[key]


def count_tokens(docs: DataFrame, *, text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null and empty texts have no bytes and no tokens.  Special strings inside a text are
    one token each, as in the tokenizer's default; none is added around it.  Texts are
    counted whole.  Rows that repeat are counted one by one; columns of ``docs`` named
    like a result column are replaced.  ``path`` names a byte-level BPE ``.json`` file."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    docs = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn(
        "n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_counter(shared, text_col), schema).withColumn("over_limit", F.col("n_tokens") > limit)
