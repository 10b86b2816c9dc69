"""Re-extraction, run discovery and snapshots, over documents as captured files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import git_blob_sha1
from lectern.sources import reextract as R
from lectern.sources import runs
from lectern.storage import scratch_root, table


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def sentences(texts: DataFrame) -> DataFrame:
    """``id, place, item``: what ends with a full stop, a question mark or an exclamation mark."""
    found = F.regexp_extract_all(F.col("text"), F.lit("[^.!?]+[.!?]"), F.lit(0))
    return texts.select("id", F.posexplode(found).alias("place", "item"))


def reextracted_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents from verified bodies, in batches, the first of equal ones; once more by the receipts alone."""
    body = F.col("text").cast("binary")
    docs = table(spark, d, "documents").select(F.format_string("%012d", "doc_id").alias("id"), body.alias("content")).withColumn("path", F.concat(F.lit("raw/"), "id"))
    listed = docs.select("id", "path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), git_blob_sha1(F.col("content")).alias("git_blob_sha"))
    output = _scratch(spark, "reextracted")
    R.reextract(listed, docs, sentences, output, revision="1", batches=3)
    again = R.reextract(listed, docs.limit(0), sentences, output, revision="1", batches=3)
    return again.select(F.col("id").cast("long").alias("doc_id"), "place", F.sha2(F.col("item").cast("binary"), 256).alias("item_sha256"))


def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a run's results, in one layout or both, sound or with a fault by its number."""
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("text"), F.pmod("doc_id", F.lit(8)).alias("k"))
    run, digest = F.concat(F.lit("run"), F.col("doc_id").cast("string")), F.sha2(F.col("text").cast("binary"), 256)
    state = F.to_json(F.struct(
        F.when(F.col("k") == 3, "failed").otherwise("complete").alias("status"), F.when(F.col("k") == 4, "other").otherwise("base").alias("baseline"),
        F.when(F.col("k") == 5, "0").otherwise(digest).alias("predictions_sha256"), F.when(F.col("k") == 6, "inputs.jsonl").when(F.col("k") == 7, "inputs.original.jsonl").alias("original_input_file"),
        F.when(F.col("k") == 7, "1").alias("original_input_sha256"),
    ))

    def file(path: str, content: Column, holds: Column) -> Column:
        return F.when(holds, F.struct(F.concat(run, F.lit(path)).alias("path"), content.cast("binary").alias("content")))

    k = F.col("k")
    files = F.array_compact(F.array(
        file("/base.jsonl", F.col("text"), k.isin(0, 1)), file("/base.meta.json", F.lit("{}"), k == 0), file("/base/predictions.jsonl", F.col("text"), k > 0),
        file("/base/run.json", state, k > 0), file("/base/inputs.original.jsonl", F.lit("x"), k == 7), file("/notes.txt", F.lit("x"), k == 2),
    ))
    return runs.discover(docs.select(F.explode(files).alias("f")).select("f.*"))


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files that changed, went or came since a snapshot of them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "lang")
    target = _scratch(spark, "snapshot")
    runs.snapshot(docs.where("lang <> 'fr'"), target)
    now = docs.where("lang <> 'es'").withColumn("content", F.when(F.col("lang") == "de", F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    return runs.snapshot_problems(spark, now, target)


QUERIES = {f.__name__: f for f in (reextracted_sentences, run_discovery, snapshot_changes)}
ORACLES = {
    "reextracted_sentences": """WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]') AS found FROM documents),
r AS (SELECT doc_id, unnest(found) AS item, generate_subscripts(found, 1) - 1 AS place FROM s)
SELECT min(doc_id) AS doc_id, CAST(arg_min(place, (doc_id, place)) AS INTEGER) AS place, sha256(item) AS item_sha256 FROM r GROUP BY item""",
    "run_discovery": """SELECT 'run' || doc_id AS run, 'base' AS name, CASE doc_id % 8 WHEN 0 THEN 'legacy' WHEN 1 THEN 'both' ELSE 'wrapped' END AS layout, sha256(text) AS predictions_sha256,
  CASE doc_id % 8 WHEN 1 THEN 'ambiguous_layout' WHEN 3 THEN 'incomplete' WHEN 4 THEN 'mislabeled' WHEN 5 THEN 'predictions_differ'
    WHEN 6 THEN 'evidence_path:original_input_file' WHEN 7 THEN 'evidence_differs:original_input_file' END AS problem FROM documents""",
    "snapshot_changes": """SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'fr' THEN 'missing' WHEN 'es' THEN 'extra' ELSE 'changed' END AS problem
FROM documents WHERE lang IN ('fr', 'es', 'de')""",
}
