"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

Texts are first grouped by (128-bit hash, text): equal hashes with different bytes
are separate groups, so a hash collision never joins two texts.  The partial
aggregation folds the copies each task has read into one row before the shuffle, so
a text that a third of all rows share arrives as one row per task.  Only groups of
two or more rows are then joined back to the rows, by their digests; the largest of
these, a bounded number, by broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_share


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` says whether the row with the smallest or the largest id of equal texts stays.
    A null text counts as empty.  Null ids are passed over when the id that stays is chosen
    (a group of null ids keeps null).  Of rows that repeat both id and text one is kept and
    all of them count in ``group_size``.  Other columns of ``docs`` are not read."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_h", F.unhex(F.md5("_text")))
    groups = (rows.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id"))
              .where("group_size > 1")
              .select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "group_size", "keep_id"))
    # rows that repeat id and text fold into one with their number
    ids = (rows.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"))
           .groupBy("_id", "_h", "_sha").agg(F.count(F.lit(1)).alias("_times")))
    total = rows.count()
    joined = join_by_share(ids, cut(groups), ["_h", "_sha"], "group_size", total, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_nth")
    return (joined.select("_id", "_sha", keep_id.alias("keep_id"),
                          F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), one)
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))
