"""Sequence packing by the sum-of-squares rule.

Texts become token ids followed by one end id; texts longer than a sequence are cut,
the shorter piece first.  Pieces are then placed one by one: a piece goes where the
sum over all residual gaps of (open bins with that gap) squared becomes smallest.
Full pieces fill a sequence alone, so each text brings at most one short piece.

Texts are dealt to shards by hash; a shard packs its pieces by itself.  The number of
shards follows the number of rows, so a shard stays small at any size, and what a
shard leaves open at its end (a few sequences) is all that sharding costs.
"""
from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches
from .pretokens import SPLIT, Vocabulary, byte_symbols, load

#: Tokens of a sequence.
CAPACITY = 2048
#: Texts of a shard, about.
SHARD_ROWS = 32_768
#: Share of a shard's pieces, the shortest, that are placed last.
_SMALL_SHARE = 0.3
#: Longest word, and white space beyond one blank a word, of a text that tiktoken encodes.
_LONG = 2000


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for its file.

    In a byte-level file whose ids are its merge ranks, tiktoken finds the same ids a few
    times faster, and the file's tables are handed to it.  Texts with special strings, and
    texts with very long words or runs of white space (which tiktoken merges in quadratic
    time), go to tokenizers itself, and so does everything for other files."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.vocab = vocab = Vocabulary(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.ids.items() if token not in vocab.special}
        ranked = all(vocab.ids[a + b] == 256 + i for i, (a, b) in enumerate(vocab.merges))
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def is_plain(self, text: str) -> bool:
        if any(s in text for s in self.vocab.special):
            return False
        words = list(map(len, text.split()))
        return max(words, default=0) <= _LONG and len(text) - sum(words) - len(words) <= _LONG

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and self.is_plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _encode(shared, text_col: str, end_id: int, capacity: int):
    def run(batches):
        encode = Encoder(shared.value)
        end = np.array([end_id], "<u4")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            n, crcs = [], []
            for text in batch.column(at).to_pylist():
                ids = np.concatenate([encode(text or "").astype("<u4", copy=False), end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            cols = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if k != at}
            yield pa.RecordBatch.from_pydict(cols | {"_n": pa.array(n, pa.int64()), "_crcs": pa.array(crcs, pa.list_(pa.int64()))})
    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 .. ``capacity`` - 1), placed in the given order.

    Ties go to the smallest gap left, a new bin last."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(sizes.tolist()):
        # change of the sum if a bin of gap size + left is used, for every left: N[left] grows, N[gap] shrinks
        change = np.where(count[size:] > 0, 2 * (count[:capacity - size + 1] - count[size:] + 1), far)
        if count[size]:
            change[0] = 1 - 2 * count[size]  # the bin closes
        left = int(change.argmin())
        if change[left] <= 2 * count[capacity - size] + 1:
            gap = left + size
            bins[k] = open_bins[gap].pop()
            offsets[k] = capacity - gap
            count[gap] -= 1
        else:
            left = capacity - size
            bins[k] = made
            made += 1
        if left:
            count[left] += 1
            open_bins[left].append(int(bins[k]))
    return bins, offsets


def _pack_shard(id_col: str, capacity: int):
    def run(key, table):
        shard = key[0].as_py()
        n = table.column("_n").to_numpy()
        crcs = table.column("_crcs").combine_chunks().flatten()
        ids = table.column(id_col)
        many = -(-n // capacity)
        short = n - (many - 1) * capacity
        row = np.repeat(np.arange(len(n)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.where(piece == 0, short[row], capacity)
        start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
        sequence = np.zeros(len(row), np.int64)
        offset = np.zeros(len(row), np.int64)
        head = np.cumsum(many) - many
        # long pieces from long to short; the shortest, in an order without pattern, fill what is left open
        big = short > np.quantile(short, _SMALL_SHARE)
        names = np.array([str(x) for x in ids.to_pylist()])
        order = np.lexsort((names, crcs.to_numpy()[head], np.where(big, -short, 0), ~big))
        partial = order[short[order] < capacity]
        bins, at = sum_of_squares(short[partial], capacity)
        sequence[head[partial]], offset[head[partial]] = bins, at
        alone = length == capacity
        sequence[alone] = (bins.max() + 1 if len(bins) else 0) + np.arange(alone.sum())
        return pa.table({id_col: ids.take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start,
                         "length": length, "ids_crc32": crcs,
                         "sequence_id": (np.int64(shard) << np.int64(36)) + sequence, "offset": offset})
    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY, end_id: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is the end id alone.  Every row is packed, repeated ids and texts
    too; other columns of ``docs`` are not read.  An empty table gives an empty result.
    Within a shard pieces are placed from long to short, the shortest share last by hash."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(load(path))
    src = docs.select(id_col, F.col(text_col).alias("_text"))
    shards = max(1, -(-src.count() // shard_rows))
    kind = src.schema[id_col]
    coded = src.mapInArrow(_encode(shared, "_text", end_id, capacity), T.StructType([
        kind, T.StructField("_n", T.LongType()), T.StructField("_crcs", T.ArrayType(T.LongType()))]))
    coded = coded.withColumn("_shard", F.pmod(F.xxhash64(id_col, "_crcs"), F.lit(shards)).cast("long"))
    out = T.StructType([kind, T.StructField("piece", T.IntegerType())] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")])
    return coded.groupBy("_shard").applyInArrow(_pack_shard(id_col, capacity), out)
