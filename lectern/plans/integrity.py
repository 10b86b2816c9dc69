"""The integrity audit over runs made of documents, each with a fault in one check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import integrity as I
from lectern.storage import materialize, table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents dealt to ten runs; in run k the first document has the fault of check k, run 0 has none."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("run"), F.pmod("doc_id", F.lit(10)).cast("string")).alias("run"))
    first = docs.groupBy("run").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "run").withColumn("bad", F.col("doc_id") == F.col("first")).drop("first")


def _facts(rows: DataFrame) -> DataFrame:
    """Evidence of all nine checks from every document."""
    body, key = F.col("text").cast("binary"), F.col("doc_id").cast("string")
    digest, size = F.sha2(body, 256), F.octet_length("text").cast("long")

    def fault(k: int) -> Column:
        return F.col("bad") & (F.col("run") == f"run{k}")

    def wrong(k: int, right: Column) -> Column:
        return F.when(fault(k), F.sha2(F.lit("other"), 256)).otherwise(right)

    def files(k: int, lost: Column) -> DataFrame:
        return rows.select("run", key.alias("path"), size.alias("bytes"), digest.alias("sha256"), F.when(~lost, size).alias("found_bytes"), wrong(k, digest).alias("found_sha256"))

    none = F.lit(False)
    declared = rows.select("run", F.lit("d").alias("dataset"), key.alias("file"), digest.alias("sha256"))
    clips = rows.select("run", key.alias("clip_id"), body.alias("wav"), digest.alias("wav_sha256"), "text", wrong(3, digest).alias("text_sha256"))
    fields = F.when(fault(6), F.array(F.lit("id"), F.lit("text"), F.lit("reference"))).otherwise(F.array(F.lit("text"), F.lit("id")))
    reads = rows.select("run", key.alias("name"), F.when(fault(7), 10).otherwise(11 + F.pmod("doc_id", F.lit(5))).alias("read_at"))
    batches = rows.select("run", F.lit(10).alias("finished_at")).distinct()
    before = rows.select("run", F.col("doc_id").alias("place"), key.alias("id"), F.array("text").alias("outputs"))
    pilot = rows.select("run", F.lit("p").alias("dataset"), F.explode(F.array(F.lit("cases.jsonl"), F.lit("inputs.jsonl"))).alias("file"), F.sha2(F.lit("pilot"), 256).alias("sha256"))
    return reduce(DataFrame.unionByName, [
        I.unchanged_files(files(1, none), I.CHECKS[0]),
        I.unchanged_manifests(rows.select("run", key.alias("path"), digest.alias("sha256"), digest.alias("found_sha256")), I.CHECKS[0]),
        # A file that is gone has neither size nor digest.
        I.unchanged_files(files(-1, fault(2)), I.CHECKS[1]),
        I.feedback_clips(clips),
        I.frozen_files(declared, declared.where("not (run = 'run4')").unionByName(rows.where(~fault(4) & (F.col("run") == "run4")).select("run", F.lit("d").alias("dataset"), key.alias("file"), digest.alias("sha256"))), I.CHECKS[3]),
        I.frozen_files(pilot, pilot.withColumn("sha256", F.when((F.col("run") == "run5") & (F.col("file") == "cases.jsonl"), F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))),
                       I.CHECKS[4], ("cases.jsonl", "inputs.jsonl")),
        I.gold_free_inputs(rows.select("run", key.alias("file"), fields.alias("fields"))),
        I.read_after(reads, batches),
        I.export_current(rows.select("run", key.alias("export"), digest.alias("submitted_sha256"), wrong(8, digest).alias("current_sha256"))),
        I.readings_unchanged(before, before.withColumn("outputs", F.when((F.col("run") == "run9"), F.array(F.upper("id"), F.col("outputs")[0])).otherwise(F.col("outputs")))),
    ])


def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every run, with what it looked at and what failed."""
    found = I.counted(_facts(materialize(_runs(spark, d), "runs")))
    return found.select("run", "name", "holds", (F.col("failures") > 0).alias("fails"))


def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which runs are eligible, by which check they aren't, and how many of their labelled documents stay candidates."""
    rows = materialize(_runs(spark, d), "runs")
    audited = materialize(I.audit(_facts(rows)), "audit")
    labels = table(spark, d, "labels")
    kind = F.when(F.col("quality") == 1, I.RETAINED).when(F.col("toxic") == 1, "withdrawn_for_future_use").otherwise("needs_review")
    items = rows.join(labels, "doc_id").select("run", F.col("doc_id").alias("id"), kind.alias("disposition"))
    per = I.dispositions(items, audited).groupBy("run").agg(F.count_if("eligible").alias("candidates"), F.sum(F.size("blockers")).alias("blockers"))
    return audited.join(per, "run", "left").select("run", "eligible", "failed", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("blockers", F.lit(0)).cast("long").alias("blockers"))


QUERIES = {f.__name__: f for f in (integrity_checks, integrity_audit)}

_NAMES = ", ".join(f"'{c}'" for c in I.CHECKS)
_RUNS = f"n AS (SELECT [{_NAMES}] AS names), r AS (SELECT DISTINCT 'run' || (doc_id % 10) AS run, CAST(doc_id % 10 AS INTEGER) AS k FROM documents)"
ORACLES = {
    "integrity_checks": f"""WITH {_RUNS} SELECT run, names[i] AS name, i <> k AS holds, i = k AS fails FROM r, n, unnest(range(1, 10)) AS u(i)""",
    "integrity_audit": f"""WITH {_RUNS}, l AS (SELECT doc_id % 10 AS k, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality = 0) AS other, count(*) AS every
  FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT run, r.k = 0 AS eligible, CASE WHEN r.k = 0 THEN '' ELSE names[r.k] END AS failed, CASE WHEN r.k = 0 THEN coalesce(kept, 0) ELSE 0 END AS candidates,
  CAST(coalesce(other + CASE WHEN r.k = 0 THEN 0 ELSE every END, 0) AS BIGINT) AS blockers FROM n, r LEFT JOIN l ON l.k = r.k""",
}
