"""Seeded, order-independent sampling of records for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.storage import table

SEED = "lectern-sample-1"


def hash_rank(seed: str, pool: Column, key: Column) -> Column:
    """A rank that depends on the seed, the pool and the key alone."""
    nul = F.lit("\0")
    return F.sha2(F.concat(F.lit(seed), nul, pool, nul, key).cast("binary"), 256)


def balanced_sample(rows: DataFrame, *, size: int, seed: str = SEED) -> DataFrame:
    """Take turns over groups until each pool has ``size`` rows.

    ``rows`` has ``id, pool, grp`` (strings).  Rows are ranked within their
    group, groups within their pool; the first of every group comes before any
    group's second.  A short pool stays short.  The first cut, at most ``size``
    rows of a group, bounds what the pool-wide ranking sees.
    """
    ranked = rows.withColumn("row_rank", hash_rank(seed, F.col("pool"), F.col("id"))).withColumn(
        "group_rank", hash_rank(seed, F.col("pool"), F.col("grp"))
    )
    own = Window.partitionBy("pool", "grp").orderBy("row_rank", "id")
    turn = ranked.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= size)
    across = Window.partitionBy("pool").orderBy("turn", "group_rank", "grp")
    return (
        turn.withColumn("position", F.row_number().over(across))
        .where(F.col("position") <= size)
        .select("id", "pool", "grp", F.col("turn").cast("long"), F.col("position").cast("long"))
    )


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("text").rlike("[0-9０-９]"), "candidate").otherwise("control").alias("pool"),
        F.col("source").alias("grp"),
    )
    return balanced_sample(rows, size=40)


QUERIES = {"balanced_sample": _balanced}

ORACLES = {
    "balanced_sample": f"""
WITH r AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS grp,
         CASE WHEN regexp_matches(text, '[0-9０-９]') THEN 'candidate' ELSE 'control' END AS pool
  FROM documents),
k AS (SELECT *, sha256('{SEED}' || chr(0) || pool || chr(0) || id) AS rr,
             sha256('{SEED}' || chr(0) || pool || chr(0) || grp) AS gr FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY pool, grp ORDER BY rr, id) AS turn FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY turn, gr, grp) AS position FROM t)
SELECT id, pool, grp, turn, position FROM p WHERE position <= 40
"""
}
