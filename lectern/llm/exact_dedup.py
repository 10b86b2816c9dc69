"""Exact deduplication behind static binary-fuse filters.

The rows arrive as a sequence of batches.  Each batch, once deduplicated in
itself, is an immutable snapshot with one filter for every bucket of digests.
A later batch's digests are screened by the filters of all snapshots before it;
only what a filter lets through is joined with the snapshot's exact buckets,
where the texts' bytes are compared.  Duplicates inside a batch are grouped
separately, by an aggregation with map-side combine, so a group that holds a
third of all rows never meets in one task.

Cases: a null text counts as empty, and empty texts are equal to each other; an
empty table gives no rows; rows that repeat a doc_id and its text are reported
alike, one result row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import fuse
from lectern.llm.common import drop_repeats, drop_rows, hinted, text_hash
from lectern.storage import materialize, table

#: Digests that a bucket holds on average, which bounds its filter (about 2.3 bytes a digest) and its task.
BUCKET_DIGESTS = 50_000
#: Batches the query deals its table into: the last one is the incoming one, the others are snapshots by then.
BATCHES = 3


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), dtype="<u8")


def _build(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    return pd.DataFrame(
        {"batch": [first["batch"]], "bucket": [first["bucket"]], "filter": [fuse.build(_keys(group["digest"]))]}
    )


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The incoming digests that some earlier snapshot's filter lets through."""
    found = [incoming.iloc[:0]]
    keys = _keys(incoming["digest"])
    for snapshot, data in zip(filters["batch"], filters["filter"], strict=True):
        later = incoming["batch"].to_numpy() > snapshot
        hit = later & fuse.contains(data, keys)
        found.append(incoming[hit].assign(snapshot=snapshot))
    return pd.concat(found).reindex(columns=["digest", "batch", "snapshot"])


def exact_groups(docs: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, text_hash`` for each row of ``docs``.

    The row with the largest doc_id of a group of equal texts stays.
    """
    if batches < 1:
        raise ValueError("batches must be positive")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    batch = F.coalesce(F.pmod("doc_id", F.lit(batches)), F.lit(0)).cast("int")
    digests = materialize(
        base.select(
            "doc_id",
            batch.alias("batch"),
            text_hash().alias("text_hash"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )
    n_buckets = max(16, -(-digests.count() // BUCKET_DIGESTS))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")
    # New-batch duplicates: one row for each digest of a batch.
    groups = materialize(
        digests.groupBy("batch", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")),
        "digest-groups",
    )
    filters = (
        groups.where(F.col("batch") < batches - 1)
        .select("batch", bucket, "digest")
        .groupBy("batch", "bucket")
        .applyInPandas(_build, "batch int, bucket long, filter binary")
    )
    positives = (
        groups.where("batch > 0")
        .select("batch", bucket, "digest")
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest binary, batch int, snapshot int")
    )
    # Exact buckets: the positives that the snapshot really holds, with both groups' representatives.
    snapshot = groups.select("digest", F.col("batch").alias("snapshot"), F.col("keep_id").alias("old_id"))
    met = positives.join(snapshot, ["digest", "snapshot"])
    pairs = materialize(
        met.join(groups.select("digest", "batch", F.col("keep_id").alias("new_id")), ["digest", "batch"]),
        "digest-hits",
    )
    # Byte checks: the representatives' whole texts must be one and the same.
    ends = pairs.select("digest", F.col("old_id").alias("doc_id")).unionByName(
        pairs.select("digest", F.col("new_id").alias("doc_id"))
    )
    ends = materialize(ends.distinct(), "digest-ends")
    equal = (
        base.join(hinted(ends, 64), "doc_id")
        .where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("digest"))
        .groupBy("digest")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where(F.col("low").cast("binary") == F.col("high").cast("binary"))
        .select("digest")
    )
    across = (
        groups.join(equal, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("keep_id").alias("all_keep"), F.sum("n").alias("all_n"))
    )
    decided = groups.join(across, "digest", "left").select(
        "batch",
        "digest",
        F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_n", "n").cast("long").alias("group_size"),
    )
    return digests.join(decided, ["batch", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, one of the largest doc_id.

    Rows decide, not ids: of rows that share a doc_id only those go whose text is
    another row's, and where several rows of the group have that largest doc_id
    (or none has any) one of them stays.
    """
    found = materialize(exact_groups(docs).select("doc_id", "text_hash", "kept"), "exact-kept")
    return drop_repeats(drop_rows(docs, found.where("not kept")), found.where("kept"))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op10_exact_dedup": _query}

ORACLES = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
