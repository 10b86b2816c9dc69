"""Saving reviews as events: a change is taken if it was made on what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def apply_changes(current: DataFrame, changes: DataFrame, *, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows after the changes, and one receipt for each change.

    ``current`` has id and the payload; ``changes`` also ``base`` (the version it
    was made on) and ``seq``.  For each id the earliest change on the present
    version is committed; a change on another version, or behind it, is a conflict.
    """
    now = current.select("id", version(payload).alias("present"))
    seen = changes.join(now, "id", "left")
    fits = F.col("present").isNotNull() & (F.col("base") == F.col("present"))
    winners = seen.where(fits).groupBy("id").agg(F.min("seq").alias("won"))
    judged = seen.join(winners, "id", "left")
    status = F.when(F.col("present").isNull(), "failed").when(fits & (F.col("seq") == F.col("won")), "committed").otherwise("conflict")
    receipts = judged.select("id", "seq", status.alias("status"), F.col("present").alias("old_version"), version(payload).alias("new_version"), *payload)
    taken = receipts.where("status = 'committed'").select("id", *[F.col(c).alias(f"_{c}") for c in payload], F.lit(True).alias("_taken"))
    after = current.join(taken, "id", "left").select("id", *[F.when(F.col("_taken"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in payload])
    return after, receipts.drop(*payload)
