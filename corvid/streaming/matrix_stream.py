"""The routing matrix kept up to date by a stream of routing events.

``foreachBatch`` upserts cells keyed by (session, token, layer); the latest event wins.
Cells lie in buckets of sessions.  A batch reads the buckets that it touches as the batch
before it left them, merges its cells and writes these buckets anew under its own number;
a manifest, written last, says which batch wrote each bucket.  A batch that is replayed
starts from the same manifest and writes the same files again, so nothing counts twice.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as R

#: Buckets of sessions; what a batch rewrites is the buckets of its sessions.
BUCKETS = 64
CELLS = "session long, token_index long, layer int, expert int, seq long"


def event_cells(events: DataFrame, num_layers: int, seq_col: str) -> DataFrame:
    """One row per cell that an event reports, also as empty (null)."""
    layers = F.slice("layer_experts", 1, num_layers)
    return events.select(F.col("session").cast("long").alias("session"), F.col("token_index").cast("long").alias("token_index"),
                         F.posexplode(layers).alias("layer", "expert"), F.col(seq_col).cast("long").alias("seq"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int")


def _latest(cells: DataFrame) -> DataFrame:
    """The last event of each cell; of two with one number, the larger expert, whatever their order."""
    return cells.groupBy("_bucket", "session", "token_index", "layer").agg(F.max(F.struct("seq", "expert")).alias("_l")).select(
        "_bucket", "session", "token_index", "layer", F.col("_l.expert").alias("expert"), F.col("_l.seq").alias("seq"))


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which batch wrote each bucket last, of the newest manifest (older than batch ``before``); at most one entry per bucket."""
    try:
        said = spark.read.schema("bucket int, batch long, written_by long").json(f"{path}/manifest/*")
        said = said if before is None else said.where(F.col("written_by") < before)
        newest = said.agg(F.max("written_by")).first()[0]
        return {r.bucket: r.batch for r in said.where(F.col("written_by") == newest).collect()} if newest is not None else {}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def _cells_of(spark: SparkSession, path: str, manifest: dict[int, int]) -> DataFrame:
    parts = [f"{path}/cells/batch={batch}/_bucket={bucket}" for bucket, batch in sorted(manifest.items()) if bucket >= 0]
    if not parts:
        return spark.createDataFrame([], CELLS)
    return spark.read.schema(CELLS).parquet(*parts)


def upsert_batch(cells: DataFrame, batch: int, path: str, buckets: int = BUCKETS) -> None:
    """Merge the cells of batch number ``batch`` into the table at ``path``; may be repeated."""
    spark = cells.sparkSession
    was = _manifest(spark, path, batch)
    new = _latest(cells.withColumn("_bucket", _bucket(buckets)))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]        # at most ``buckets``
    old = _cells_of(spark, path, {b: was[b] for b in touched if b in was}).withColumn("_bucket", _bucket(buckets))
    merged = _latest(old.unionByName(new))
    merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/cells/batch={batch}")
    now = was | {b: batch for b in touched}
    rows = [(b, at, batch) for b, at in now.items()] or [(-1, batch, batch)]
    spark.createDataFrame(rows, "bucket int, batch long, written_by long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{batch}")


def write_routing_matrix(events: DataFrame, path: str, checkpoint: str, num_layers: int = R.MATRIX_LAYERS, seq_col: str = "step",
                         buckets: int = BUCKETS, trigger: dict | None = None):
    """Start the stream that keeps the matrix at ``path``; ``events`` is a stream of event records."""
    cells = event_cells(events, num_layers, seq_col)
    return (cells.writeStream.foreachBatch(lambda df, batch: upsert_batch(df, batch, path, buckets))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_routing_matrix(spark: SparkSession, path: str, num_layers: int = R.MATRIX_LAYERS) -> DataFrame:
    """T16's long form (session, token_index, layer, expert) of the table as it stands: -1 for layers
    without an event, tokens without layer 0 left out."""
    cells = _cells_of(spark, path, _manifest(spark, path))
    per_token = cells.groupBy("session", "token_index").agg(*[
        F.max(F.when(F.col("layer") == layer, F.col("expert"))).alias(f"_c{layer}") for layer in range(num_layers)])
    whole = F.array(*[F.coalesce(F.col(f"_c{layer}"), F.lit(-1)) for layer in range(num_layers)])
    return per_token.where("_c0 is not null").select("session", "token_index", F.posexplode(whole).alias("layer", "expert"))
