"""Policy queries over every document, set into a template that triggers the rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators.policies import columns as P
from lectern.storage import table


def _templated() -> Column:
    own = F.col("doc_id").cast("string")
    return F.concat(F.lit("回复 @用户"), own, F.lit("："), F.col("text"), F.lit(" [微笑]一把🔨，像🐶一样😊；JDK"), own,
                    F.lit("用API，u1s1 985高校、211本科，学费211元。"))


def _policy(name: str, spark: SparkSession, d: str) -> DataFrame:
    out = P.policy(name)(F.col("source_text")).alias("r")
    rows = table(spark, d, "documents").select("doc_id", _templated().alias("source_text")).select("doc_id", out)
    return rows.select(
        "doc_id", F.sha2(F.col("r.text").cast("binary"), 256).alias("text_sha256"), F.size("r.edits").cast("long").alias("n_edits"),
        F.size("r.warnings").cast("long").alias("n_warnings"), F.size("r.protected").cast("long").alias("n_protected"),
        F.col("r.policy_version").alias("policy_version"))


def reply_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The reply prefix alone, as a native expression."""
    pattern = r"\A[ \t]*回复[ \t]*@[^\r\n\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}:：]+[:：][ \t]*"
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(_templated(), pattern, "").alias("body"))


def guarded_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rules' text, a model's answer for the labelled documents, and what is taken of it."""
    out = P.policy("audited")(F.col("source_text"))["text"]
    rows = table(spark, d, "documents").select("doc_id", _templated().alias("source_text")).select("doc_id", out.alias("text"))
    labels = table(spark, d, "labels")
    said = F.when(F.col("quality") == 1, "211元->二百一十一元").when(F.col("toxic") == 1, "没有->零").otherwise("学费211元->费二百一十一元")
    model = rows.join(labels, "doc_id", "left").withColumn("raw", F.when(F.col("quality").isNotNull(), said))
    model = model.withColumn("prediction", F.when(F.col("raw").isNotNull(), P.replay_lines("text", F.coalesce("raw", F.lit("")))))
    reasons = P.guard_reasons("text", "raw", "prediction")
    judged = model.withColumn("reasons", reasons)
    missing, taken = F.col("raw").isNull(), F.size("reasons") == 0
    status = F.when(missing, "missing").when(taken, "ok").otherwise("tn_guard_rejected")
    final = F.when(~missing & taken, F.col("prediction")).otherwise(F.col("text"))
    return judged.select("doc_id", status.alias("status"), F.array_join("reasons", ",").alias("reasons"),
                         F.sha2(final.cast("binary"), 256).alias("text_sha256"))


def chinese_integer(spark: SparkSession, d: str) -> DataFrame:
    """Every order's key as it is read."""
    return table(spark, d, "orders").select("o_orderkey", N.chinese_integer(F.col("o_orderkey").cast("string")).alias("said"))


def version_reading(spark: SparkSession, d: str) -> DataFrame:
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"), F.lit("007"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.version_reading(version).alias("said"), N.spell(F.col("l_returnflag")).alias("spelled"))


QUERIES = {f"policy_{name}": partial(_policy, name) for name in P._STAGES} | {
    f.__name__: f for f in (reply_prefix, guarded_merge, chinese_integer, version_reading)
}

_T = "'回复 @用户' || doc_id || '：' || text || ' [微笑]一把🔨，像🐶一样😊；JDK' || doc_id || '用API，u1s1 985高校、211本科，学费211元。'"
_NUMBER = r"""CASE WHEN {n} = '0' OR (length({n}) > 1 AND {n}[1] = '0') THEN translate({n}, '0123456789', '零一二三四五六七八九') ELSE
  regexp_replace(regexp_replace(regexp_replace((SELECT string_agg(g, '' ORDER BY k) FROM (SELECT k,
    CASE WHEN f = '0000' THEN '零' ELSE regexp_replace(regexp_replace(
      (SELECT string_agg(CASE WHEN f[i] = '0' THEN '零' ELSE translate(f[i], '123456789', '一二三四五六七八九') || ['千', '百', '十', ''][i] END, '' ORDER BY i)
       FROM (SELECT unnest([1, 2, 3, 4]) AS i)), '零+', '零', 'g'), '零$', '') || ['兆', '亿', '万', ''][k] END AS g
    FROM (SELECT k, substr(lpad({n}, 16, '0'), 4 * k - 3, 4) AS f FROM (SELECT unnest([1, 2, 3, 4]) AS k)))),
    '零+', '零', 'g'), '^零|零$', '', 'g'), '^一十', '十') END"""
ORACLES = {
    "reply_prefix": rf"SELECT doc_id, regexp_replace({_T}, '^[ \t]*回复[ \t]*@[^\r\n\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}:：]+[:：][ \t]*', '') AS body FROM documents",
    "chinese_integer": "SELECT o_orderkey, " + _NUMBER.format(n="n") + " AS said FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS n FROM orders)",
    "version_reading": "SELECT l_orderkey, l_linenumber, " + " || '点' || ".join(_NUMBER.format(n=x) for x in ("a", "b"))
    + " || '点零零七' AS said, l_returnflag AS spelled FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_orderkey AS VARCHAR) AS b FROM lineitem)",
}
