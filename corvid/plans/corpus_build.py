"""``build_corpus``: raw sources -> train / eval token tables with diagnostics.

S2 -> F* -> P1 -> P2..P7 -> (staged) -> P8/P9 -> P11/P12 -> P13 -> P14 -> S3.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.chat import QWEN_DEFAULT_SYSTEM
from ..operators import corpus as C
from ..plans.ordering import RANGE_ROWS, KeyRanges, key_ranges
from ..session import ensure_checkpoint_dir
from ..sources.registry import SourceDef, formatted, resolve


@dataclass
class CorpusSource:
    """One dataset of the mix: its registry name, weight and raw rows.

    ``key`` is a unique integer column giving the stream order.
    """
    name: str
    weight: float
    df: DataFrame
    key: str = "raw_id"
    formatter: Callable[[DataFrame], Column] | None = None


class Stage:
    """Tables of a build in a shared folder, each written once.

    A table counts as written when its manifest, which says what it was made from, is
    there; the manifest comes last.  A build that is run again with the same folder after a
    failure reads what is finished and writes the rest anew; a manifest that says something
    else is not trusted.  Parquet keeps columns apart, so who asks for a status reads no
    token arrays."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/corvid-build-{uuid.uuid4().hex}"

    def once(self, name: str, made_from: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """Table ``name``: as it stands if it was made from the same, else what ``make`` plans."""
        data, manifest = f"{self.path}/{name}", f"{self.path}/manifest/{name}"
        said = json.dumps(made_from, sort_keys=True, default=str)
        if self._manifest(manifest) != said:
            make().write.mode("overwrite").parquet(data)
            self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
        return self.spark.read.parquet(data)

    def _manifest(self, path: str) -> str | None:
        try:
            return "".join(r.value for r in self.spark.read.text(path).collect())
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def close(self) -> None:
        """Remove the folder; tables of the build cannot be read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class CorpusResult:
    """Outputs of :func:`build_corpus`.  Every part is planned (and, with ``materialize``,
    staged) on first use, so asking for the allocation or the diagnostics does not run the mix."""

    def __init__(self, make_samples, quota, allocation, names, weights, seed, stage, made_from):
        self._make_samples, self.quota, self.allocation = make_samples, quota, allocation
        self._names, self._weights, self._seed = names, weights, seed
        self._stage, self._made_from = stage, made_from
        self.valid_counts: dict = {}      # filled by the early-stop rounds

    @cached_property
    def samples(self) -> DataFrame:
        """Every sample (and one placeholder per rejected raw row) with its status, staged round by round."""
        return self._make_samples(self)

    @cached_property
    def streamed(self) -> DataFrame:
        return C.take_quota(self.samples, self.quota)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return C.collect_diagnostics(self.streamed, self.quota)

    @cached_property
    def reject_reasons(self) -> DataFrame:
        return C.reject_reasons(self.streamed)

    @cached_property
    def collected(self) -> DataFrame:
        collected = self.streamed.filter(F.col("status") == C.VALID).select(
            "source", "raw_idx", "sample_idx", "input_ids", "attention_mask", "labels")
        if self._stage:
            # one count per source reaches the driver (already known after early-stop rounds)
            self.samples
            counts = self.valid_counts or {r[0]: r[1] for r in collected.groupBy("source").count().collect()}
            empty = [n for n in self._names if counts.get(n, 0) == 0]
            if empty:
                raise RuntimeError(f"no valid sample from {empty[0]}")
        return collected

    @cached_property
    def split_keys(self) -> DataFrame:
        """Which split each collected sample belongs to, and its place in the shuffle; no token arrays."""
        keys = C.train_eval_split(self.collected.select("source", "raw_idx", "sample_idx"), self.allocation, self._seed)
        return self._stage.once("split", self._made_from | {"seed": self._seed}, lambda: keys) if self._stage else keys

    @cached_property
    def split(self) -> DataFrame:
        return self.collected.join(self.split_keys, ["source", "raw_idx", "sample_idx"])

    @cached_property
    def mixed(self) -> DataFrame:
        """Both splits in one chain: draws and ranks over sample keys, to which the token arrays are joined last."""
        keys = C.interleave_splits(self.split_keys, self._names, self._weights, self._seed)
        tokens = self.samples.select("source", "raw_idx", "sample_idx", "input_ids", "attention_mask", "labels")
        return keys.join(tokens, ["source", "raw_idx", "sample_idx"])

    @property
    def train(self) -> DataFrame:
        return self.mixed.filter(F.col("split") == "train").drop("split")

    @property
    def eval(self) -> DataFrame:
        return self.mixed.filter(F.col("split") == "eval").drop("split")

    def close(self) -> None:
        """Remove the staged tables."""
        if self._stage:
            self._stage.close()


def prefix_samples(sources: Sequence[CorpusSource], quota: dict, ranges: dict[str, KeyRanges], make,
                   stage: Stage | None, made_from: dict, first_rows: int | None = None, min_rows: int = 4096,
                   valid_out: dict | None = None) -> DataFrame:
    """Early stop (the reference streams until the quota is full).

    All sources advance together in rounds; in each round every unfinished source
    contributes its next key ranges, these are tokenized once (one staged table per round)
    and one grouped count of valid samples per source reaches the driver.  A source stops
    when its n-th valid sample is inside its processed prefix or its table ends.  The
    result equals processing whole tables for everything the quota and diagnostics read.
    """
    state = {s.name: {"n": int(quota[s.name]), "size": first_rows or max(8 * int(quota[s.name]), min_rows),
                      "at": 0, "valid": 0, "done": False} for s in sources}
    pieces = []
    while todo := [s for s in sources if not state[s.name]["done"]]:
        parts, said = [], []
        for src in todo:
            st, r = state[src.name], ranges[src.name]
            first = st["at"]
            st["at"] = max(first + 1, r.through(r.starts[first] + st["size"]))
            lo = r.bounds[first - 1] if first else None
            hi = r.bounds[st["at"] - 1] if st["at"] < len(r.counts) else None
            parts.append(make(src, lo, hi, r))
            said.append([src.name, lo, hi, r.starts[first], r.starts[st["at"]]])
        part = C.align_union(parts)
        if stage:
            part = stage.once(f"samples-{len(pieces):05d}", made_from | {"rounds": said}, lambda part=part: part)
        pieces.append(part)
        got = {r[0]: r[1] for r in part.filter(F.col("status") == C.VALID).groupBy("source").count().collect()}
        for src in todo:
            st = state[src.name]
            g = int(got.get(src.name, 0))
            st["valid"] += g
            if st["valid"] >= st["n"] or st["at"] >= len(ranges[src.name].counts):
                st["done"] = True
                continue
            need = (st["n"] - st["valid"]) * 1.25 * st["size"] / max(g, 1)
            st["size"] = int(max(2 * st["size"], need))
    if valid_out is not None:
        valid_out.update({k: v["valid"] for k, v in state.items()})
    return C.align_union(pieces)


def check_weights(sources: Sequence[CorpusSource]) -> None:
    if abs(sum(s.weight for s in sources) - 1.0) >= 1e-6:
        raise ValueError(f"the shares of all sources add up to {sum(s.weight for s in sources)}, not to one")


def source_samples(src: CorpusSource, context_length: int, encoder: TK.Encoder | None,
                   default_system: str | None, key_lo=None, key_hi=None, ranges: KeyRanges | None = None) -> DataFrame:
    """Samples of one source, optionally only for the keys from ``key_lo`` up to ``key_hi``, which
    are bounds of the table's key ``ranges`` (they reach the scan where the key is a plain column)."""
    shape = SourceDef(src.name, src.formatter, ()) if src.formatter else resolve(src.name)
    raw = src.df
    if key_lo is not None:
        raw = raw.filter(F.col(src.key) >= F.lit(key_lo))
    if key_hi is not None:
        raw = raw.filter(F.col(src.key) < F.lit(key_hi))
    df = formatted(shape, C.with_raw_index(raw, src.key, ranges)).select(F.lit(src.name).alias("source"), "raw_idx", "samples", "reject_reason")
    ex = C.explode_samples(df, keep=("source", "raw_idx", "reject_reason"))
    return C.tokenize_and_mask(ex, context_length, encoder, default_system)


def build_corpus(spark: SparkSession, sources: Sequence[CorpusSource], total_samples: int,
                 eval_fraction: float = C.EVAL_FRACTION, context_length: int = C.CONTEXT_LENGTH,
                 seed: int = C.SEED, encoder: TK.Encoder | None = None,
                 default_system: str | None = QWEN_DEFAULT_SYSTEM,
                 materialize: bool = True, early_stop: bool = True,
                 first_rows: int | None = None, stage_path: str | None = None) -> CorpusResult:
    """Build the train / eval mix.

    ``early_stop`` processes each source in growing key ranges until its quota
    is met (exact; see :func:`prefix_samples`); otherwise whole tables are
    tokenized.  ``materialize`` stages the tokenized samples and the split as Parquet
    (:class:`Stage`), in ``stage_path`` or a folder of its own in ``spark.checkpoint.dir``;
    a build that is run again with one ``stage_path`` goes on where it stopped.
    """
    check_weights(sources)
    for s in sources:              # unknown names fail before any job
        if s.formatter is None:
            resolve(s.name)
    for s in sources:
        if int(total_samples * s.weight) <= 0:
            raise ValueError(f"{s.name}: {total_samples} samples leave none for a share of {s.weight}")
    names = [s.name for s in sources]
    weights = [s.weight for s in sources]
    spec = spark.createDataFrame([(s.name, float(s.weight), i) for i, s in enumerate(sources)],
                                 "name string, weight double, ord int")
    alloc = C.allocate(spec, total_samples, eval_fraction)
    quota = alloc.select("source", F.col("total_alloc").alias("n"))

    totals = {s.name: int(total_samples * s.weight) for s in sources}
    enc = encoder or TK.hash_encoder()
    made_from = {"sources": [(s.name, s.weight, s.key) for s in sources], "total": total_samples, "context": context_length,
                 "system": default_system, "vocabulary": enc.full_length, "marker": list(enc.marker_ids), "eval": eval_fraction}
    stage = Stage(spark, stage_path) if materialize else None

    def make(src, lo=None, hi=None, ranges=None):
        return source_samples(src, context_length, encoder, default_system, lo, hi, ranges).drop("messages")

    def samples(result: CorpusResult) -> DataFrame:
        tables = {s.name: (s.df, s.key) for s in sources}
        if early_stop:
            rows = min(RANGE_ROWS, first_rows or max(4096, 8 * min(totals.values())))
            return prefix_samples(sources, totals, key_ranges(tables, rows), make, stage, made_from, first_rows, valid_out=result.valid_counts)
        ranges = key_ranges(tables)
        whole = C.align_union([make(s, ranges=ranges[s.name]) for s in sources])
        return stage.once("samples", made_from | {"rows": {k: r.counts for k, r in ranges.items()}}, lambda: whole) if stage else whole

    return CorpusResult(samples, quota, alloc, names, weights, seed, stage, made_from)


def write_corpus(result: CorpusResult, path: str, mode: str = "overwrite") -> None:
    """S3: one parquet dataset partitioned by split."""
    cols = ["order_key", "source", "raw_idx", "sample_idx", "input_ids", "attention_mask", "labels", "split"]
    result.mixed.select(*cols).write.mode(mode).partitionBy("split").parquet(path)
