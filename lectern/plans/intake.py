"""Captures that are read only where they are verified, and dataset packages that are read only as they are bound."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.scans import _files
from lectern.sources import capture, package
from lectern.storage import scratch_root, table


def _captures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files in a folder for each language, and a manifest that is wrong about one file of every folder but the English one."""
    own = _files(spark, d)
    files = own.select(F.concat_ws("/", F.coalesce("lang", F.lit("none")), "path").alias("path"), "content", F.col("path").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("none")).alias("lang"))
    sha, blob = F.sha2("content", 256), T.git_blob_sha1(F.col("content"))
    bound = files.select("path", "doc_id", "lang", F.octet_length("content").cast("long").alias("bytes"), sha.alias("sha"), blob.alias("blob"))
    # A row a language; no content is dealt out by language, of which there are few.
    first = files.groupBy("lang").agg(F.min("doc_id").alias("first"))
    marked = bound.join(F.broadcast(first), "lang").withColumn("bad", F.col("doc_id") == F.col("first"))

    def wrong(lang: str, other: Column, right: Column) -> Column:
        return F.when(F.col("bad") & (F.col("lang") == lang), other).otherwise(right)

    listed = marked.select("path", "bytes", wrong("fr", F.sha2(F.lit("other"), 256), F.col("sha")).alias("sha256"),
                           wrong("de", F.sha1(F.lit("other")), wrong("es", F.upper("blob"), F.col("blob"))).alias("git_blob_sha"))
    return files.select("path", "content"), listed


def intake_problems(spark: SparkSession, d: str) -> DataFrame:
    return capture.verify(*_captures(spark, d))


def intake_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the captures of which every file is as the manifest says; one bad file keeps its whole capture out."""
    rows = capture.judge(capture.parsed(capture.trusted(*_captures(spark, d))), before=1_700_000_000)
    found = capture.records(rows, "capture")
    return found.select("id", "comment_id", "comment_time", "source.path", "source.line_end", F.array_join("quality_flags", ",").alias("flags"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def package_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents published as a package of two roles, over an older version of it, and read again."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("quality") == 1, "train").otherwise("validation").alias("role"))
    target = f"{scratch_root(spark)}/lectern/package-{uuid.uuid4().hex}"
    roles = {r: rows.where(F.col("role") == r).drop("role") for r in ("train", "validation")}
    package.publish(spark, target, {r: df.limit(0) for r, df in roles.items()}, {"revision": 1})
    package.publish(spark, target, roles, {"revision": 2})
    train, validation = (df.withColumn("role", F.lit(r)) for r, df in package.read(spark, target, *roles).items())
    return train.unionByName(validation).select("role", "id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (intake_problems, intake_records, package_rows)}

ORACLES = {
    "intake_problems": """SELECT coalesce(lang, 'none') || '/' || min(doc_id) AS path, CASE lang WHEN 'fr' THEN 'sha256' WHEN 'de' THEN 'git_blob' ELSE 'bad_entry' END AS problem
FROM documents WHERE lang IN ('fr', 'de', 'es') GROUP BY lang""",
    "intake_records": r"""SELECT 'capture:BV1aaaaaaaaa:' || (doc_id + 1) AS id, CAST(doc_id + 1 AS VARCHAR) AS comment_id,
  strftime(make_timestamp((1600000000 + doc_id + 28800) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+08:00' AS comment_time, coalesce(lang, 'none') || '/' || doc_id AS path,
  CAST(2 + length(regexp_replace(text, '[^\n]', '', 'g')) AS INTEGER) AS line_end,
  array_to_string(list_filter([CASE WHEN contains(text, chr(10)) OR contains(text, chr(13)) THEN 'multiline_text' END,
    CASE WHEN regexp_matches(text, '\A[\s\x0b\x1c-\x1f\x{85}\x{a0}]|[\s\x0b\x1c-\x1f\x{85}\x{a0}]\z') THEN 'boundary_whitespace' END,
    CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_characters' END], lambda x: x IS NOT NULL), ',') AS flags,
  sha256(text) AS text_sha256 FROM documents WHERE (lang IS NULL OR lang NOT IN ('fr', 'de', 'es')) AND regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}]')""",
    "package_rows": """SELECT CASE WHEN quality = 1 THEN 'train' ELSE 'validation' END AS role, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS text_sha256
FROM documents JOIN labels USING (doc_id)""",
}
