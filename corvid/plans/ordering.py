"""Skew-safe global ordering primitives.

A bare ``row_number() OVER (ORDER BY k)`` moves every row into one task.
The helpers here rank in two levels instead:

1. every row gets a *bucket* that is monotone in the sort key: a range between
   quantiles of an integer key (:func:`key_ranges`, for keys of any spread), a
   fixed-width range of a dense one, or a fixed-length prefix of an md5 hex
   key, which is uniform;
2. per-bucket counts (one row per bucket, not per data row) are turned into
   running offsets;
3. ``row_number()`` runs per bucket and the offset is added.

When only the position of the n-th row is needed (quotas, splits), only the
one bucket that contains it is ranked.
"""
from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
DEFAULT_INT_WIDTH = 1 << 16     # at most 65536 rows per bucket for a unique integer key
DEFAULT_HEX_DIGITS = 4          # 65536 md5 buckets


def int_bucket(key: Column | str, width: int = DEFAULT_INT_WIDTH) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.floor(k / F.lit(width)).cast("bigint")


def hex_bucket(hex_key: Column | str, digits: int = DEFAULT_HEX_DIGITS) -> Column:
    k = F.col(hex_key) if isinstance(hex_key, str) else hex_key
    return F.conv(F.substring(k, 1, digits), 16, 10).cast("bigint")


def seeded_key(seed, *parts) -> Column:
    """md5 of ``seed-part1-part2...``: a portable, partitioning-independent order."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols += [F.lit("-"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*cols))


def _bucket_offsets(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint")).drop("_n")


def global_index(df: DataFrame, order: Sequence[str], bucket: Column, groups: Sequence[str] = (),
                 name: str = "rank") -> DataFrame:
    """1-based dense position of each row in ``order`` within ``groups``.

    ``bucket`` must be non-decreasing in ``order`` (within a group).
    Equivalent to ``row_number() OVER (PARTITION BY groups ORDER BY order)``.
    """
    b = df.withColumn(BUCKET, bucket)
    offsets = _bucket_offsets(b, groups)
    w = Window.partitionBy(*groups, BUCKET).orderBy(*order)
    ranked = b.withColumn("_local", F.row_number().over(w))
    return (ranked.join(offsets, [*groups, BUCKET])
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop(BUCKET, "_offset", "_local"))


def nth_row(df: DataFrame, order: Sequence[str], bucket: Column, quota: DataFrame,
            groups: Sequence[str] = (), n_col: str = "n") -> DataFrame:
    """Per group, the ``order`` values of the n-th row (1-based), n from ``quota``.

    Only the bucket holding the n-th row is ranked.  Groups with fewer than n
    rows (or n <= 0) are absent from the result.  ``quota`` has one row per
    group (a spec table), so it is broadcast.
    """
    if not groups:
        df, quota, groups = df.withColumn("_g", F.lit(0)), quota.withColumn("_g", F.lit(0)), ("_g",)
        return nth_row(df, order, bucket, quota, groups, n_col).drop("_g")
    b = df.withColumn(BUCKET, bucket)
    counts = b.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_n").over(w))
    q = F.broadcast(quota.select(*groups, F.col(n_col).alias("_want")))
    crossing = counts.join(q, list(groups)).filter((F.col("_want") > 0) & (F.col("_cum") - F.col("_n") < F.col("_want"))
                               & (F.col("_cum") >= F.col("_want")))
    crossing = crossing.select(*groups, BUCKET, (F.col("_want") - (F.col("_cum") - F.col("_n"))).alias("_pos"))
    # at most one crossing bucket per group: a spec-sized table
    inside = b.join(F.broadcast(crossing), [*groups, BUCKET])
    w2 = Window.partitionBy(*groups, BUCKET).orderBy(*order)
    return (inside.withColumn("_local", F.row_number().over(w2))
            .filter(F.col("_local") == F.col("_pos"))
            .select(*groups, *order))


# ---------------------------------------------------------------- ranges of sparse keys
#: Rows in a range, about, and ranges of one table at most.
RANGE_ROWS, MOST_RANGES = 1 << 16, 1 << 14
#: Bounds that are looked through at once.
_COARSE = 128


def _numbers(values: Sequence[int]) -> Column:
    """A constant array; written as one literal, so that plans stay small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


@dataclass(frozen=True)
class KeyRanges:
    """Ranges of a unique integer key: range ``i`` holds ``counts[i]`` keys, from ``bounds[i - 1]`` (the
    first: from the smallest key) up to but not including ``bounds[i]``."""
    bounds: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def starts(self) -> tuple[int, ...]:
        """Position of each range's first key, and the number of all keys."""
        out = [0]
        for n in self.counts:
            out.append(out[-1] + n)
        return tuple(out)

    def bucket(self, key: Column) -> Column:
        """Number of the range that a key falls into: how many bounds are not above it."""
        if not self.bounds:
            return F.lit(0)
        coarse, fine = self.bounds[::_COARSE], _numbers(self.bounds)

        def passed(bounds: Column) -> Column:
            return F.size(F.filter(bounds, lambda b: b <= key))
        if len(coarse) == 1:
            return passed(fine)
        whole = F.greatest(passed(_numbers(coarse)) - 1, F.lit(0)) * _COARSE
        return whole + passed(F.slice(fine, whole + 1, F.lit(_COARSE)))

    def through(self, position: int) -> int:
        """The number of ranges that hold the first ``position`` keys."""
        return min(len(self.counts), bisect_left(self.starts, position))


def key_ranges(tables: dict[str, tuple[DataFrame, str]], rows: int = RANGE_ROWS) -> dict[str, KeyRanges]:
    """Ranges of about ``rows`` keys (``MOST_RANGES`` at most) of each table's key column.

    Three jobs over the key columns alone, for all tables together: their counts, their
    quantiles and the exact count of each range.  The quantiles reach the driver once and
    are constants from then on, so every later job sees the same ranges."""
    keys = None
    for name, (df, key) in tables.items():
        k = df.select(F.lit(name).alias("source"), F.col(key).cast("long").alias("_key")).where("_key is not null")
        keys = k if keys is None else keys.unionAll(k)
    n = {r["source"]: r["n"] for r in keys.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = min(MOST_RANGES, -(-max(n.values(), default=0) // max(1, rows)))
    if many <= 1:
        return {name: KeyRanges((), (n.get(name, 0),)) for name in tables}
    at = F.percentile_approx("_key", [i / many for i in range(1, many)], 8 * many)
    # a quantile is the last key of its range
    bounds = {r["source"]: tuple(sorted({b + 1 for b in r["b"]})) for r in keys.groupBy("source").agg(at.alias("b")).collect()}
    bucket = None
    for name in tables:
        own = KeyRanges(bounds.get(name, ()), ()).bucket(F.col("_key"))
        bucket = F.when(F.col("source") == name, own) if bucket is None else bucket.when(F.col("source") == name, own)
    counted = {(r["source"], r["b"]): r["n"] for r in keys.groupBy("source", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: KeyRanges(bounds.get(name, ()), tuple(counted.get((name, i), 0) for i in range(len(bounds.get(name, ())) + 1))) for name in tables}


def range_index(df: DataFrame, key: str, ranges: KeyRanges, name: str) -> DataFrame:
    """0-based dense position of each row in the order of ``key``; ``ranges`` are those of the whole
    table, of which ``df`` may be some whole ranges."""
    w = Window.partitionBy(BUCKET).orderBy(key)
    ranked = df.withColumn(BUCKET, ranges.bucket(F.col(key).cast("long")))
    return ranked.withColumn(name, F.get(_numbers(ranges.starts), F.col(BUCKET)) + F.row_number().over(w) - 1).drop(BUCKET)
