"""Token-loss analytics (N1-N4) over scored-token tables.

Input rows: (sample, pos, logits ARRAY<DOUBLE>, step) and either ``labels``, the label
array of the row's sample, or ``label``, the row's own.  The label at pos + 1 is
predicted from the logits at pos.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE_INDEX
from .routing import let

LOGIT_CLAMP = 1e4          # fixed value
AUX_LOSS_COEF = 0.001      # fixed value: router aux loss coefficient


def clamp_logits(logits: Column, bound: float = LOGIT_CLAMP) -> Column:
    """N1."""
    return F.transform(logits, lambda x: F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def token_nll(scored: DataFrame) -> DataFrame:
    """N2 per token: -log softmax(logits)[next label]; ignored targets dropped.

    Where the rows carry their sample's ``labels`` array, the shift is local to the row
    and no logits are shuffled.  Otherwise the next ``label`` within the sample is found on
    the labels alone and joined back by (sample, pos), which must tell rows apart: a few
    bytes per token, which Spark broadcasts up to its threshold, so logits stay in place."""
    if "labels" in scored.columns:
        df = scored.withColumn("_t", F.get("labels", F.col("pos") + 1))
    else:
        after = F.lead("label").over(Window.partitionBy("sample").orderBy("pos"))
        df = scored.join(scored.select("sample", "pos", after.alias("_t")).where("_t is not null"), ["sample", "pos"])
    kept = df.where((F.col("_t") != IGNORE_INDEX) & (F.col("_t") >= 0) & (F.col("_t") < F.size("logits")))   # P6 clamp

    def nll(x: Column) -> Column:
        def lse(m: Column) -> Column:
            # one pass over the logits; max and target are bound outside the lambda
            return m + F.log(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - m)))
        return let(F.array_max(x), lse) - F.get(x, F.col("_t"))

    return kept.withColumn("nll", let(clamp_logits(F.col("logits")), nll)).drop("_t")


def masked_nll(scored: DataFrame, by: str = "step") -> DataFrame:
    """Mean over kept tokens per batch."""
    return token_nll(scored).groupBy(by).agg(F.avg("nll").alias("loss"), F.count(F.lit(1)).alias("n_tokens"))


def perplexity(loss: Column) -> Column:
    """exp(loss); overflow is +inf."""
    return F.exp(loss)


def combined_loss(nll: DataFrame, aux: DataFrame, coef: float = AUX_LOSS_COEF, by: str = "step") -> DataFrame:
    """NLL + coef x balance loss, joined per step."""
    return nll.join(aux.select(by, "aux_loss"), by).withColumn("total_loss", F.col("loss") + F.lit(coef) * F.col("aux_loss"))


def training_record(log: DataFrame, nll: DataFrame, by: str = "step") -> DataFrame:
    """The record that is logged per training step: loss and its perplexity (N2, N3), balance loss,
    entropy to 4 decimals and ``expert_{i}_pct`` (T18-T20, from ``routing.training_log``).  A step
    with one half only keeps nulls for the other."""
    return (nll.select(by, "loss").join(log, by, "full")
            .withColumn("train_perplexity", perplexity(F.col("loss"))).withColumnRenamed("aux_loss", "train_aux_loss"))


def evaluation_record(nll: DataFrame, aux: DataFrame, eval_col: str = "eval_id", by: str = "step") -> DataFrame:
    """The record of an evaluation: means over its batches of loss and balance loss (T21), and the
    perplexity of the mean loss.  ``nll`` and ``aux`` have a row per batch ``by`` of ``eval_col``."""
    batches = nll.select(eval_col, by, "loss").join(aux.select(eval_col, by, "aux_loss"), [eval_col, by], "full")
    return batches.groupBy(eval_col).agg(F.avg("loss").alias("eval_loss"), F.avg("aux_loss").alias("eval_aux_loss")) \
        .withColumn("eval_perplexity", perplexity(F.col("eval_loss")))
