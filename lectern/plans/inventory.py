"""Inventories, orders and checks on single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import store
from lectern.sources import jsonl
from lectern.storage import table


def key_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Every key that the events' properties have, and how often."""
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Digests of properties with sorted keys and spaced separators."""
    return jsonl.canonical_hashes(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value")))


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """An order of each user's events for three epochs that depends on seed, epoch and id alone."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("epoch"))
    rank = F.sha2(F.concat_ws("|", F.lit("lectern-epoch"), F.col("epoch").cast("string"), F.col("event_id").cast("string")).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("user_id", "epoch").orderBy(rank, "event_id")).cast("long")
    return rows.select("user_id", "epoch", "event_id", place.alias("place"))


def china_dates(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.unix_timestamp("ts")
    local = T.china_time(epoch)
    return table(spark, d, "events").select("event_id", local.alias("local"), T.strict_date(F.substring(local, 1, 10)).alias("day"))


def occurrence_check(spark: SparkSession, d: str) -> DataFrame:
    """Where the third occurrence of a surface starts, overlapping ones counted; null if there are fewer."""

    def next_(at, _):
        here = F.call_function("locate", F.lit("e"), F.col("text"), at + 1)
        return F.when((at < 0) | (here == 0), F.lit(-1)).otherwise(here)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0), next_)
    return table(spark, d, "documents").select("doc_id", F.when(found > 0, found - 1).cast("long").alias("start"))


def review_saves(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of changes to labels: one made on the present version, one on it again, one on an older version."""
    current = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    base = store.version(["quality", "toxic"])
    first = current.select("id", (1 - F.col("quality")).alias("quality"), "toxic", base.alias("base"), F.lit(1).alias("seq"))
    again = first.where("toxic = 1").withColumn("seq", F.lit(2))
    stale = first.where("quality = 0").withColumn("base", F.lit("old")).withColumn("seq", F.lit(3))
    _, receipts = store.apply_changes(current, first.unionByName(again).unionByName(stale), payload=["quality", "toxic"])
    return receipts.select("id", "seq", "status")


QUERIES = {f.__name__: f for f in (key_inventory, canonical_json, epoch_order, china_dates, occurrence_check, review_saves)}
ORACLES = {
    # The events' objects are flat.
    "canonical_json": r"""SELECT CAST(event_id AS VARCHAR) AS id, sha256('{' || array_to_string(list_transform(list_sort(json_keys(props)),
  lambda k: '"' || k || '": ' || CAST(json_extract(props, '$.' || k) AS VARCHAR)), ', ') || '}' || chr(10)) AS sha256 FROM events""",
    "key_inventory": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "epoch_order": """SELECT user_id, epoch, event_id, row_number() OVER (PARTITION BY user_id, epoch ORDER BY sha256('lectern-epoch|' || epoch || '|' || event_id), event_id) AS place
FROM (SELECT user_id, event_id, unnest([1, 2, 3]) AS epoch FROM events)""",
    "china_dates": """SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local,
  CAST(date_trunc('second', ts) + INTERVAL 8 HOUR AS DATE) AS day FROM events""",
    "occurrence_check": """WITH p AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents),
e AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM p WHERE c = 'e')
SELECT d.doc_id, e.k - 1 AS start FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id AND e.n = 3""",
    "review_saves": """SELECT doc_id AS id, 1 AS seq, 'committed' AS status FROM labels UNION ALL SELECT doc_id, 2, 'conflict' FROM labels WHERE toxic = 1
UNION ALL SELECT doc_id, 3, 'conflict' FROM labels WHERE quality = 1""",
}
