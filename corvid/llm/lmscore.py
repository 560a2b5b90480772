"""Stupid-backoff language-model scores of every document under all the others.

The n-grams of a document are exploded and joined to count tables that are partitioned
by n-gram hash; the scores are summed per document.  Counts cover the whole corpus; a
document is scored with its own occurrences taken off, so that it does not predict
itself.

An n-gram is a 64-bit hash.  One row per n-gram would move tens of bytes for each of
the corpus's n-grams, so they travel in arrays: documents are dealt to blocks, a block
explodes its distinct n-grams, sorts them and sends each hash partition one row with
its slice (differences of sorted hashes, by byte plane, compressed).  A partition adds
up the counts and answers every block with the totals, in the same order.  The block
joins them to its documents' n-grams by position.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import bound_batches, row_ranges, text_buffer

#: Longest n-gram.
ORDER = 3
#: Weight of one step back to a shorter n-gram.
ALPHA = 0.4
#: Text bytes of a block and n-grams of a hash partition, about.
BLOCK_BYTES = 6 << 20
TABLE_GRAMS = 3 << 20
_ROOT = np.uint64(0x5851F42D4C957F2D)


def _pack(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n or 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _squeeze(text_at: int):
    """Texts compressed one by one: they cross the shuffle at less than half their size."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).fill_null(b"")
            packed = pa.array([pack(t.as_buffer()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], packed], batch.schema.names)
    return run


def _texts(column) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t.as_buffer()) for t in column], pa.large_binary())


def grams(texts: pa.Array, order: int):
    """n-grams of consecutive texts: (document of each word, position in it, hashes by order).

    ``hashes[k][i]`` is the (k + 1)-gram that ends at word ``i``; it is only meaningful from
    position ``k`` on."""
    offsets, raw = text_buffer(texts)
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in row_ranges(offsets, 1 << 20):
        low, starts, ends, n = wordhash.words(offsets[i:j + 1] - offsets[i], raw[offsets[i]:offsets[j]])
        words.append(wordhash.hashes(low, starts, ends))
        counts.append(n)
    word, count = np.concatenate(words), np.concatenate(counts)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    hashes = [wordhash.mix(word + _ROOT)]
    for _ in range(1, order):
        longer = hashes[-1].copy()
        longer[1:] = wordhash.mix(hashes[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + _ROOT)
        hashes.append(longer)
    return doc, place, hashes, count


def _distinct(place, hashes, n_words: int):
    """All n-grams of a block in one array, the empty one (every word's context) first."""
    return np.concatenate([np.full(min(1, n_words), _ROOT), *[h[place >= k] for k, h in enumerate(hashes)]])


def _send(order: int, bits: int):
    def run(key, table):
        _, place, hashes, count = grams(_texts(table.column("_text")), order)
        n_words = int(count.sum())
        gram, n = np.unique(_distinct(place, hashes, n_words), return_counts=True)
        n = n.astype(np.uint64)
        n[gram == _ROOT] += np.uint64(max(0, n_words - 1))
        cut = np.searchsorted(gram, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
        cut = np.append(cut, len(gram))
        rows = [(b, _pack(np.diff(gram[i:j], prepend=np.uint64(0))), _pack(n[i:j]), int(j - i))
                for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "bucket": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[3] for r in rows], pa.int64()),
                         "grams": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})
    return run


def _add_up(key, table):
    size = table.column("n").to_numpy()
    gram = np.concatenate([np.cumsum(_unpack(g.as_py(), n), dtype=np.uint64) for g, n in zip(table.column("grams"), size, strict=True)])
    count = np.concatenate([_unpack(c.as_py(), n) for c, n in zip(table.column("counts"), size, strict=True)])
    order = np.argsort(gram, kind="stable")
    ranked = gram[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.add.reduceat(count[order], head)
    each = np.empty(len(gram), np.uint64)
    each[order] = np.repeat(total, np.diff(np.append(head, len(gram))))
    end = np.cumsum(size)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"),
                     "totals": pa.array([_pack(each[e - n:e]) for e, n in zip(end, size, strict=True)], pa.binary())})


def _score(id_col: str, order: int, alpha: float):
    def run(key, docs, answers):
        doc, place, hashes, count = grams(_texts(docs.column("_text")), order)
        n_docs, n_words = len(count), int(count.sum())
        sums, backed = np.zeros(n_docs), np.zeros(n_docs, np.int64)
        if n_words:
            every = _distinct(place, hashes, n_words)
            gram, number = np.unique(every, return_inverse=True)
            by = sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals"), answers.column("n").to_pylist(), strict=True),
                        key=lambda r: r[0])
            total = np.concatenate([_unpack(t.as_py(), n) for _, t, n in by]).astype(np.int64)
            assert len(total) == len(gram)
            # left[k][i]: count of the (k + 1)-gram ending at word i in all other documents
            at, left = 1, []
            for k in range(order):
                here = place >= k
                own_number = number[at:at + int(here.sum())]
                at += len(own_number)
                pair = doc[here] * np.int64(len(gram)) + own_number
                _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
                full = np.zeros(n_words, np.int64)
                full[here] = total[own_number] - own[back]
                left.append(full)
            others = total[number[0]] - count[doc]
            score = np.zeros(n_words)
            todo = np.ones(n_words, bool)
            for k in range(order - 1, -1, -1):
                seen = todo & (place >= k) & (left[k] > 0)
                i = np.flatnonzero(seen)
                context = others[i] if k == 0 else left[k - 1][i - 1]
                steps = np.minimum(order - 1, place[i]) - k
                score[i] = np.log10(left[k][i] / context) + steps * np.log10(alpha)
                todo &= ~seen
            i = np.flatnonzero(todo)
            score[i] = -np.log10(np.maximum(others[i], 1)) + (np.minimum(order - 1, place[i]) + 1) * np.log10(alpha)
            sums = np.bincount(doc, score, n_docs)
            backed = np.bincount(doc, todo, n_docs).astype(np.int64)
        return pa.table({id_col: docs.column(id_col), "n_words": pa.array(count, pa.int64()), "n_unseen": pa.array(backed, pa.int64()),
                         "log10_score": pa.array(sums)})
    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                    alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """Per row: id, ``n_words``, ``n_unseen`` (words that no other document has),
    ``log10_score`` (sum over words) and ``score`` (mean per word; null without words).

    A word's score is c(n-gram) / c(its first n - 1 words) for the longest n-gram up to
    ``order`` that other documents contain, times ``alpha`` for each step back; an unseen
    word counts as once among all words, one step further back.  Counts are those of the
    whole table less the row's own.  Null and empty texts have no words.  Rows that repeat
    are separate documents, each among the others' counts; other columns are not read."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, int(np.ceil(np.log2(max(1, size // 6 * order / table_grams)))))
    src = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("long").alias("block"),
                      F.col(id_col), F.col(text_col).alias("_text"))
    src = src.mapInArrow(_squeeze(2), T.StructType([*src.schema.fields[:2], T.StructField("_text", T.BinaryType())]))
    # as many partitions as groups, whatever the session's setting: a task holds a few at most
    src = src.repartition(blocks, "block")
    sent = src.groupBy("block").applyInArrow(_send(order, bits), "block long, bucket long, n long, grams binary, counts binary")
    answers = sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(
        _add_up, "block long, bucket long, n long, totals binary").repartition(blocks, "block")
    out = T.StructType([src.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_unseen", T.LongType()),
                        T.StructField("log10_score", T.DoubleType())])
    scored = src.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(id_col, order, alpha), out)
    return scored.withColumn("score", F.col("log10_score") / F.nullif(F.col("n_words"), F.lit(0)))
