"""Figures of a training run from its log of losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micro_batches(log: DataFrame, *, size: int, run: str, step: str) -> DataFrame:
    """Steps of a run in batches of ``size``, each step with its share of the batch's tokens."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(step))
    out = log.withColumn("batch", F.floor((nth - 1) / size).cast("long"))
    return out.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(run, "batch")))


def weighted_loss(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))


def best_checkpoint(log: DataFrame, by: str, step: str) -> DataFrame:
    """The step of least loss, the earlier of equals; NaN is never best."""
    valid = log.where(~F.isnan("loss"))
    return valid.groupBy(by).agg(F.min(F.struct("loss", step)).alias("m")).select(by, f"m.{step}", "m.loss")


def warmup_rate(step: Column, total: Column, rate: float, share: float = 0.03) -> Column:
    return F.lit(rate) * F.least(step / F.ceil(total * share), F.lit(1.0))
