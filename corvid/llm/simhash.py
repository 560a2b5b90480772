"""SimHash near-duplicates by covering with anchor points.

Fingerprints are compared at *anchors*, the words of a covering code.  The code is a
product of perfect codes over separate blocks of the 64 bits: binary Golay codes (23
bits, radius 3) and, for very large inputs, a Hamming code (15 bits, radius 1).  Every
fingerprint has one *home*, its nearest code word in each block, and *visits* every
anchor whose distance exceeds the covering radii by ``max_bits`` in all.  If two
fingerprints differ in at most ``max_bits`` bits, each visits the other's home, so the
comparison at homes finds every link, once per pair.

Only distinct fingerprints are compared: copies meet as one row.
"""
from __future__ import annotations

import re
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, join_by_share, ragged, row_ranges, text_buffer
from .graph import components
from .wordhash import LOWER

# Generator polynomials of the binary Golay (23, 12) and Hamming (15, 11) codes.
GOLAY = (23, 0b110001110101, 3)
HAMMING = (15, 0b10011, 1)
#: Distinct fingerprints above which the third block joins the anchors.
TWO_BLOCKS = 1 << 28
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def _fingerprints(texts, words: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text (bytes, ASCII letters in lower case)."""
    out = np.zeros(len(texts), np.uint64)
    hashed: list[int] = []
    rows, counts = [], []

    def flush():
        if not hashed:
            return
        h = np.array(hashed, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(counts)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        np.add.at(sums, rows, ones)
        hashed.clear(), rows.clear(), counts.clear()

    sums = np.zeros((len(texts), 64), np.int32)
    totals = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for row, text in enumerate(texts):
        parts = [w for w in _SPACE.split(text) if w]
        if not parts:
            continue
        n = max(1, len(parts) - words + 1)
        totals[row] = n
        joined = b" ".join(parts)
        size = list(map(len, parts))
        begin, end, stop = 0, 0, min(words, len(parts))
        end = sum(size[:stop]) + stop - 1
        own = 0
        for k in range(n):
            hashed.append(digest(joined[begin:end], seed))
            own += 1
            begin += size[k] + 1
            if k + 1 < n:
                end += size[k + words] + 1
            if len(hashed) >= 1 << 17:
                rows.append(row), counts.append(own)
                flush()
                own = 0
        if own:
            rows.append(row), counts.append(own)
    flush()
    out = np.packbits(sums * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 3, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """``(id, *carry, fp)`` per row; ``fp`` is the signed 64-bit SimHash of the word shingles.

    Words are split at ASCII white space after A-Z is lower-cased; a text of fewer words
    than a shingle is one shingle; no words, an empty or a null text give 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            offsets, raw = text_buffer(batch.column(batch.num_columns - 1))
            low = LOWER[raw]
            got = [np.zeros(0, np.uint64)]
            for i, j in row_ranges(offsets, 1 << 20):
                got.append(_fingerprints([low[offsets[k]:offsets[k + 1]].tobytes() for k in range(i, j)], words, seed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(got).view(np.int64))], names)

    src = docs.select(id_col, *(carry or []), F.col(text_col).alias("_text"))
    names = [*src.columns[:-1], "fp"]
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())]))


@cache
def _cosets(bits: int, generator: int, radius: int, extra: int):
    """Error patterns by syndrome: (first, how many within radius + 0, 1, .. ``extra``, patterns, excess)."""
    degree = generator.bit_length() - 1
    unit = np.zeros(bits, np.int64)
    for i in range(bits):
        v = 1 << i
        for k in range(bits - 1, degree - 1, -1):
            if v >> k & 1:
                v ^= generator << (k - degree)
        unit[i] = v
    patterns, syndromes, weight = [], [], []
    for w in range(radius + extra + 1):
        for at in combinations(range(bits), w):
            patterns.append(sum(1 << i for i in at))
            syndromes.append(np.bitwise_xor.reduce(unit[list(at)]) if at else 0)
            weight.append(max(0, w - radius))
    patterns, syndromes, weight = map(np.array, (patterns, syndromes, weight))
    order = np.lexsort((weight, syndromes))
    patterns, syndromes, weight = patterns[order], syndromes[order], weight[order]
    first = np.searchsorted(syndromes, np.arange(1 << degree))
    upto = np.stack([np.bincount(syndromes[weight <= e], minlength=1 << degree) for e in range(extra + 1)], 1)
    return unit, first, upto, patterns, weight


def anchors(fp: np.ndarray, blocks, extra: int):
    """Anchors within the covering radii plus ``extra`` bits: (row of ``fp``, anchor, excess)."""
    row = np.arange(len(fp))
    key = np.zeros(len(fp), np.int64)
    excess = np.zeros(len(fp), np.int64)
    shift = 0
    for bits, generator, radius in blocks:
        unit, first, upto, patterns, weight = _cosets(bits, generator, radius, extra)
        part = ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fp), np.int64)
        for i in range(bits):
            syndrome ^= np.where(part >> i & 1, unit[i], 0)
        many = upto[syndrome[row], extra - excess]
        pick = ragged(first[syndrome[row]], many)
        row, key, excess = np.repeat(row, many), np.repeat(key, many), np.repeat(excess, many) + weight[pick]
        key = (key << bits) | (part[row] ^ patterns[pick])
        shift += bits
    return row, key, excess


def links(distinct_fp: DataFrame, max_bits: int, blocks) -> DataFrame:
    """``(a, b)`` for every pair of distinct fingerprints at most ``max_bits`` bits apart."""
    def run(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at:at + 4096]
                row, key, excess = anchors(fp.view(np.uint64), blocks, max_bits)
                home = excess == 0
                # each block's code is perfect: exactly one anchor lies within every radius
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    at_anchor = distinct_fp.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")
    homes = at_anchor.where("home").select("anchor", F.col("fp").alias("a"))
    visits = at_anchor.select("anchor", F.col("fp").alias("b"))
    return (homes.join(visits, "anchor")
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                max_bits: int = 2, seed: int = 42, carry: list[str] | None = None, with_root: bool = False) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id reachable over links of at most ``max_bits`` bits, its own included; ``carry``
    names further columns to keep; ``with_root`` adds ``component_root``, a fingerprint that
    tells components apart whatever their ids are.

    Texts without words have fingerprint zero and link like any other.  Null ids are
    passed over when the smallest is taken; a component of null ids has null.  Rows that
    repeat an id are fingerprinted one by one.  An empty table gives an empty result."""
    docs_fp = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed, carry=carry))
    distinct = cut(docs_fp.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n_rows")))
    blocks = [GOLAY, GOLAY] + ([HAMMING] if distinct.count() > TWO_BLOCKS else [])
    roots = components(links(distinct, max_bits, blocks)).withColumnRenamed("node", "fp")
    lows = (roots.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("component_low")))
    moved = roots.join(lows, "root").select("fp", "root", F.col("component_low"))
    # an isolated fingerprint is its own root; a component without an id keeps null
    by_fp = distinct.join(moved, "fp", "left").select(
        "fp", "n_rows", F.when(F.col("root").isNotNull(), F.col("component_low")).otherwise(F.col("low")).alias("component_id"),
        F.coalesce("root", "fp").alias("component_root"))
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    joined = join_by_share(docs_fp, by_fp, ["fp"], "n_rows", total)
    return joined.select(id_col, *(carry or []), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                         *(["component_root"] if with_root else []))
