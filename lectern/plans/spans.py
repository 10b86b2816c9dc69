"""Span queries: the runs of digits, capitals and punctuation of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import spans as S
from lectern.storage import table


def _words(text: Column) -> Column:
    """Starts and lengths of the space-separated pieces of a text, and whether they have a capital in front."""

    def step(before: Column, p: Column) -> Column:
        at = F.coalesce(before["end"] + 1, F.lit(0))
        return F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.rlike("^[A-Z]").alias("capital"))

    return S.scan(F.split(text, " "), step, "struct<start:int,end:int,capital:boolean>")


def _line_words(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document with the spans of its words, and of the capitalised ones."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", "text", _words(F.col("text")).alias("spans"))


def _capitals() -> Column:
    return F.transform(F.filter("spans", lambda s: s["capital"]), lambda s: S.span(s["start"], s["end"]))


def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Words of more than six characters, grown by one at the end, joined where they touch."""
    rows = _line_words(spark, d)
    long = F.transform(F.filter("spans", lambda s: s["end"] - s["start"] > 6), lambda s: S.span(s["start"], s["end"] + 1))
    merged = S.merge(long)
    return rows.select("doc_id", "line", F.explode(merged).alias("s")).select("doc_id", "line", "s.start", "s.end")


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Does a capitalised word stand within a line's first twenty characters, or its last ten?"""
    rows = _line_words(spark, d).withColumn("caps", _capitals())
    n = F.length("text")
    return rows.select("doc_id", "line", S.overlaps(F.lit(0), F.least(n, F.lit(20)), F.col("caps")).alias("early"),
                       S.overlaps(n - 10, n, F.col("caps")).alias("late"))


def _edits() -> Column:
    """Capitalised words become their length in brackets."""
    return F.transform(_capitals(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                 F.concat(F.lit("<"), (s["end"] - s["start"]).cast("string"), F.lit(">")).alias("replacement")))


def edit_replay(spark: SparkSession, d: str) -> DataFrame:
    """Lines after their edits, and back again by the inverse ones."""
    rows = _line_words(spark, d)
    rows = rows.withColumn("edits", _edits()).withColumn("edited", S.replay(F.col("text"), F.col("edits")))
    back = S.replay(F.col("edited"), S.inverse(F.col("text"), F.col("edits")))
    return rows.select("doc_id", "line", "edited", F.size("edits").cast("long").alias("n_edits"), (back == F.col("text")).alias("restored"))


def span_remap(spark: SparkSession, d: str) -> DataFrame:
    """Where the other words stand after the edits."""
    rows = _line_words(spark, d)
    rows = rows.withColumn("edits", _edits())
    other = F.transform(F.filter("spans", lambda s: ~s["capital"] & (s["end"] > s["start"])), lambda s: S.span(s["start"], s["end"]))
    moved = S.remap(other, F.col("edits"))
    return rows.select("doc_id", "line", F.explode(moved).alias("s")).select("doc_id", "line", "s.start", "s.end")


def span_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_words(spark, d)
    caps = _capitals()
    return rows.select("doc_id", "line", S.mask(F.col("text"), caps).alias("masked"))


QUERIES = {f.__name__: f for f in (span_merge, span_overlap, edit_replay, span_remap, span_mask)}

_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, text, unnest(string_split(text, ' ')) AS p, generate_subscripts(string_split(text, ' '), 1) AS k FROM l),
s AS (SELECT *, CAST(sum(length(p) + 1) OVER (PARTITION BY doc_id, line ORDER BY k) - length(p) - 1 AS INTEGER) AS a FROM w),
x AS (SELECT *, a + CAST(length(p) AS INTEGER) AS b, regexp_matches(p, '^[A-Z]') AS cap FROM s)"""
ORACLES = {
    "span_merge": f"""WITH {_LINES}, g AS (SELECT doc_id, line, a, b + 1 AS b FROM x WHERE length(p) > 6),
h AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id, line ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM g),
i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY a) AS n FROM h)
SELECT doc_id, line, min(a) AS start, max(b) AS "end" FROM i GROUP BY doc_id, line, n""",
    "span_overlap": f"""WITH {_LINES}
SELECT doc_id, line, bool_or(cap AND a < least(length(text), 20) AND least(length(text), 20) > 0) AS early, bool_or(cap AND a < length(text) AND b > length(text) - 10) AS late
FROM x GROUP BY doc_id, line""",
    "edit_replay": f"""WITH {_LINES}
SELECT doc_id, line, string_agg(CASE WHEN cap THEN '<' || length(p) || '>' ELSE p END, ' ' ORDER BY k) AS edited,
  count(*) FILTER (cap) AS n_edits, true AS restored FROM x GROUP BY doc_id, line""",
    "span_remap": f"""WITH {_LINES},
m AS (SELECT *, coalesce(CAST(sum(CASE WHEN cap THEN length('<' || length(p) || '>') - length(p) ELSE 0 END)
  OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 0) AS d FROM x)
SELECT doc_id, line, a + d AS start, b + d AS "end" FROM m WHERE NOT cap AND b > a""",
    "span_mask": f"""WITH {_LINES}
SELECT doc_id, line, string_agg(CASE WHEN cap THEN regexp_replace(p, '[^\\n\\r]', ' ', 'g') ELSE p END, ' ' ORDER BY k) AS masked FROM x GROUP BY doc_id, line""",
}
