"""Suggestion envelopes and confirmations over rounds made of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import suggestions as S
from lectern.storage import materialize, table

CONTRACT = S.Contract("assistant", ("review-v1", "review-v2"), ("review-v3", "review-v4", "review-v5", "review-v6"), ("review-v5", "review-v6"))
MANIFEST = "0" * 64


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents; a round for each hundred."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.floor(F.col("doc_id") / 100).alias("round"), F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "quality", "toxic", "lang")


def suggestion_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a round's suggestions: by its number the envelope is wrong, by label and language its items are."""
    rows = materialize(_rows(spark, d), "rounds")
    n = F.length("text")
    span = F.struct(
        F.lit(0).alias("start"), F.when(F.col("lang") == "fr", n + 1).otherwise(1).alias("end"), F.substring("text", 1, 1).alias("surface"),
        F.when(F.col("lang") == "de", 2).otherwise(1).alias("occurrence"), F.lit("omit").alias("mode"), F.lit("x").alias("reading"), F.lit("y").alias("reason"),
    )
    audit = F.struct(F.when(F.col("toxic") == 1, "text_only_ok").otherwise("needs_reading_annotation").alias("status"), F.lit("s").alias("summary"),
                     F.array(span).alias("spans"), F.array().cast("array<string>").alias("issues"))
    item = F.struct(
        "id", F.when(F.col("lang") == "es", "no").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"), F.lit("keep").alias("decision"),
        F.array(F.when(F.col("quality") == 0, F.lit("other")).otherwise(F.col("text"))).alias("acceptable_outputs"), F.lit("preservation").alias("track"), F.lit("f").alias("family"),
        F.lit(False).alias("context_required"), F.lit("because").alias("reason"), F.array().cast("array<string>").alias("flags"), audit.alias("reading_audit"),
    )
    per = rows.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("own"))
    kind = F.pmod("round", F.lit(5))

    def wrong(k: int, other: Column, right: Column) -> Column:
        return F.when(kind == k, other).otherwise(right)

    body = F.to_json(F.struct(
        F.lit(2).alias("schema_version"), wrong(1, F.lit("1" * 64), F.lit(MANIFEST)).alias("prepared_manifest_sha256"), F.lit("assistant").alias("generator"),
        wrong(2, F.lit(True), F.lit(False)).alias("human_reviewed"), F.lit("review-v6").alias("policy_version"),
        wrong(3, F.lit("2026-10-01T00:00:00+08:00"), F.lit("2026-10-01T00:00:00Z")).alias("created_at_utc"), F.col("own.item").alias("items"),
    ))
    envelopes = per.select("round", wrong(4, F.concat(F.lit("{"), body), body).alias("body"), F.lit(MANIFEST).alias("manifest_sha256"))
    return S.envelope_problems(materialize(envelopes, "envelopes"), rows.select("round", "id", "text"), CONTRACT)


def suggestion_confirmations(spark: SparkSession, d: str) -> DataFrame:
    """Which labelled documents a save confirms: by the present bundle, by the item, by an archive, or by none."""
    rows = _rows(spark, d)
    item, review = F.sha2(F.concat(F.lit("i"), "id"), 256), F.sha2(F.concat(F.lit("r"), "id"), 256)
    saved = rows.select("round", "id", F.when(F.col("toxic") == 1, "pending").otherwise("approved").alias("status"), review.alias("review_sha256"))
    offered = rows.select("round", "id", item.alias("item_sha256"), F.lit("review-v6").alias("policy_version"), F.lit("now").alias("bundle_sha256"))
    # English rows were saved under the present bundle, German ones by item, French ones under an archive; Spanish ones changed since.
    bundle = F.when(F.col("lang") == "en", "now").when(F.col("lang") == "fr", F.concat(F.lit("old"), F.col("quality").cast("string"))).otherwise("gone")
    noted = F.when(F.col("lang") == "de", F.when(F.col("quality") == 1, item).otherwise("changed"))
    first = rows.select("round", F.lit("20261001T000000000000Z-0000000000000000").alias("name"), F.lit("committed").alias("status"), "id",
                        F.when(F.col("lang") == "es", "changed").otherwise(review).alias("saved_review_sha256"),
                        bundle.alias("bundle_sha256"), noted.alias("item_sha256"), F.lit("review-v5").alias("policy_version"))
    later = first.withColumn("name", F.lit("20261002T000000000000Z-0000000000000000")).withColumn("saved_review_sha256", F.lit("later"))
    conflict = later.withColumn("status", F.lit("conflict"))
    receipts = first.unionByName(conflict).unionByName(later.where("id like '%7'")).where("id not like '%9'")
    archives = rows.select("round", F.concat(F.lit("old"), F.col("quality").cast("string")).alias("bundle_sha256"), (F.col("quality") == 1).alias("sound"),
                           F.lit("review-v5").alias("policy_version"), "id", item.alias("item_sha256"))
    return S.confirmations(saved, offered, receipts, archives, CONTRACT)


QUERIES = {f.__name__: f for f in (suggestion_faults, suggestion_confirmations)}

_ROWS = """r AS (SELECT doc_id // 100 AS round, CAST(doc_id AS VARCHAR) AS id, doc_id, text, quality, toxic, lang FROM documents JOIN labels USING (doc_id))"""
ORACLES = {
    "suggestion_faults": f"""WITH {_ROWS}, p AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY doc_id) - 1 AS k FROM r),
e AS (SELECT DISTINCT round, unnest(CASE round % 5 WHEN 1 THEN [{{'path': '$.prepared_manifest_sha256', 'reason': 'other_package'}}]
  WHEN 2 THEN [{{'path': '$.human_reviewed', 'reason': 'not_false'}}] WHEN 3 THEN [{{'path': '$.created_at_utc', 'reason': 'not_utc_time'}}]
  WHEN 4 THEN [{{'path': '$', 'reason': 'invalid_json'}}] ELSE [] END) AS f FROM r),
i AS (SELECT round, '$.items[' || k || ']' AS place, unnest(list_filter([
  CASE WHEN lang = 'es' THEN {{'path': '.text_sha256', 'reason': 'text_differs'}} END,
  CASE WHEN quality = 0 THEN {{'path': '', 'reason': 'keep_changes_text'}} END,
  CASE WHEN quality = 0 THEN {{'path': '', 'reason': 'preservation_changed'}} END,
  CASE WHEN toxic = 1 THEN {{'path': '.reading_audit.status', 'reason': 'ok_with_findings'}} END,
  CASE WHEN lang = 'fr' THEN {{'path': '.reading_audit.spans[0]', 'reason': 'span_order'}}
    WHEN lang = 'de' THEN {{'path': '.reading_audit.spans[0]', 'reason': 'occurrence_differs'}} END], lambda x: x IS NOT NULL)) AS f FROM p WHERE round % 5 <> 4)
SELECT round, f.path AS path, f.reason AS reason FROM e UNION ALL SELECT round, place || f.path, f.reason FROM i""",
    "suggestion_confirmations": f"""WITH {_ROWS}, k AS (SELECT *, CASE WHEN id LIKE '%9' OR id LIKE '%7' OR lang = 'es' THEN NULL WHEN lang = 'en' THEN 'current_bundle_sha256'
  WHEN lang = 'de' AND quality = 1 THEN 'unchanged_item_sha256' WHEN lang = 'fr' AND quality = 1 THEN 'verified_archived_bundle' END AS kind FROM r)
SELECT round, id, CASE WHEN kind IS NULL THEN 'unreviewed' WHEN toxic = 1 THEN 'draft' ELSE 'reviewed' END AS state,
  CASE WHEN id LIKE '%9' THEN 'no_committed_receipt' WHEN kind IS NULL THEN 'receipt_does_not_match_snapshot_or_suggestion' ELSE 'matching_committed_receipt' END AS basis, kind FROM k""",
}
