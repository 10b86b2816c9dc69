"""Preparing records: flags, canonical rows, context, pools and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import canonical as C
from lectern.storage import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _joined(column):
    return F.array_join(column, ",")


def text_signals(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _joined(T.text_signals(F.col("text"))).alias("signals"))


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_sort(F.array_distinct(F.concat(T.import_flags(F.col("text")), T.content_flags(F.col("text")))))
    return _docs(spark, d).select("doc_id", _joined(flags).alias("flags"))


def row_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons to reject a row, none hiding another; stand-in identifiers of every kind."""
    own, page = F.col("doc_id").cast("string"), F.col("doc_id")
    rows = _docs(spark, d).select(
        "doc_id",
        F.when(page % 11 == 0, F.concat(own, F.lit("E+3"))).when(page % 7 == 0, F.concat(F.lit("0"), own)).otherwise(
            (page + 1).cast("string")).alias("rpid"),
        F.when(page % 5 == 0, "x").otherwise((F.lit(1_200_000_000) + page * 900_000).cast("string")).alias("ctime"),
        F.when(page % 13 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("message"),
    )
    stamp = F.when(F.col("ctime").rlike(r"\A(?:0|[1-9][0-9]*)\z"), F.col("ctime").cast("long"))
    scientific = F.col("rpid").rlike(r"\A[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+\z")
    bad_id = ~F.col("rpid").rlike(r"\A[1-9][0-9]*\z")
    reasons = F.array_compact(
        F.array(
            F.when(bad_id & scientific, "scientific_notation:rpid").when(bad_id, "invalid_identifier:rpid"),
            F.when(stamp.isNull(), "invalid_timestamp"),
            F.when((stamp < 1_230_739_200) | (stamp >= 1_900_000_000), "timestamp_out_of_range"),
            F.when(T.strip(F.col("message")) == "", "empty_text"),
        )
    )
    return rows.select("doc_id", _joined(reasons).alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text").cast("binary")
    return _docs(spark, d).select(
        "doc_id",
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("sha256"),
        T.git_blob_sha1(body).alias("git_blob_sha1"),
    )


def canonical_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Every document once, and the labelled ones again, with another text where they are toxic."""
    docs = _docs(spark, d)
    again = docs.join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        "lang",
        F.lit(1).alias("seq"),
    )
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang", F.lit(0).alias("seq")).unionByName(again)
    found = C.collapse_ids(rows, payload=["text", "lang"], order="seq")
    return found.select("id", "members", "conflict", F.when(~F.col("conflict"), F.length("text")).cast("long").alias("n_chars"))


def exact_text_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return C.exact_text_groups(rows).select(
        "text_sha256", "group_id", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")
    )


def video_components(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(
        F.concat("source", F.lit("-"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("grp"), "text"
    )
    return C.shared_text_components(rows).select("grp", F.concat(F.lit("video-component:"), "component").alias("component"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("scope"),
        (t + 1).cast("string").alias("own"),
        F.when(t == 0, "0").when((F.col("conv_id") % 9 == 0) & (t == 2), "99").when(
            (F.col("conv_id") % 10 == 0) & (t == 1), "2").otherwise(t.cast("string")).alias("parent"),
        F.when(t == 0, "0").when(F.col("conv_id") % 8 == 0, "77").otherwise("1").alias("root"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string")).alias("id"),
        "text",
    )


def root_context(spark: SparkSession, d: str) -> DataFrame:
    found = C.root_context(_replies(spark, d))
    return found.select("id", "context_id", F.length("context_text").cast("long").alias("context_chars"), "context_issue")


def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    return C.parent_chains(spark, _replies(spark, d))


def unresolved_pointers(spark: SparkSession, d: str) -> DataFrame:
    rows = _replies(spark, d)
    both = [C.unresolved_pointers(rows, "scope", "own", p).select("id", F.lit(f"unresolved_{p}").alias("flag")) for p in ("root", "parent")]
    return both[0].unionByName(both[1])


def eligible_pools(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a date window without an excluding flag, split into candidates and controls."""
    flags = F.when(F.col("value") < 5, F.array(F.lit("empty_text"))).when(F.col("value") < 20, F.array(F.lit("short_text"))).otherwise(
        F.array().cast("array<string>"))
    day = F.to_date(F.date_format("ts", "yyyy-MM-dd"))
    excluded = F.array(*[F.lit(x) for x in ("empty_text", "replacement_character", "control_character")])
    rows = table(spark, d, "events").select("event_id", day.alias("day"), flags.alias("flags"), "event_type")
    return rows.where((F.col("day") >= "2024-01-05") & (F.col("day") < "2024-01-20") & ~F.arrays_overlap("flags", excluded)).select(
        "event_id", F.when(F.col("event_type").isin("click", "purchase"), "candidate").otherwise("control").alias("pool"))


def prepare_summary(spark: SparkSession, d: str) -> DataFrame:
    """Histograms in long form, and distinct counts."""
    docs = _docs(spark, d).select(
        "doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"),
        T.text_signals(F.col("text")).alias("signals"), T.content_flags(F.col("text")).alias("flags"))
    long = docs.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("name")),
                        F.struct(F.lit("source").alias("kind"), F.col("source").alias("name"))),
                F.transform("signals", lambda s: F.struct(F.lit("signal").alias("kind"), s.alias("name"))),
                F.transform("flags", lambda s: F.struct(F.lit("flag").alias("kind"), s.alias("name"))),
            )
        ).alias("x")
    )
    counts = long.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    unique = docs.agg(F.count_distinct("h").alias("n")).select(F.lit("unique").alias("kind"), F.lit("texts").alias("name"), "n")
    return counts.unionByName(unique)


def first_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return C.first_seen(rows, key="h", order=["id"])


def group_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", "url", host.alias("host"))
    return C.quota_sample(rows, group="host", key="url", n=3).select("page_id", "host", "place")


def inspection_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.col("text").rlike("[0-9]").alias("has_digit"))
    # Two first cuts of 50 rows each; no window over a whole half of the table.
    halves = [rows.where(F.col("has_digit") == flag).orderBy("doc_id").limit(50) for flag in (True, False)]
    return halves[0].unionByName(halves[1])


QUERIES = {
    f.__name__: f
    for f in (
        text_signals, quality_flags, row_reject_reasons, file_fingerprint, canonical_conflicts, exact_text_groups,
        video_components, root_context, parent_chain, unresolved_pointers, eligible_pools, prepare_summary,
        first_seen_dedup, group_quota_sample, inspection_sample,
    )
}

_WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SIGNALS = r"""list_filter([
  CASE WHEN regexp_matches(text, '[0-9０-９]') THEN 'digits' END,
  CASE WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[㐀-鿿]') THEN 'latin_and_han' END,
  CASE WHEN regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[㐀-鿿]') THEN 'latin' END,
  CASE WHEN len(list_filter(range(1, len(ch) - 1), lambda i: ch[i] = ch[i + 1] AND ch[i] = ch[i + 2]
            AND NOT regexp_matches(ch[i], '^(WS|\p{Nd})$'))) > 0 THEN 'repeated_character' END,
  CASE WHEN regexp_matches(text, '\[[^\[\]\r\n]{1,24}\]') THEN 'bracket_expression' END,
  CASE WHEN regexp_matches(text, '[\p{So}\p{Sk}\p{Sm}]') THEN 'symbol_or_emoji' END], lambda x: x IS NOT NULL)""".replace("WS", _WS)
_FLAGS = r"""
  CASE WHEN text = '' OR regexp_matches(text, '^WS+$') THEN 'empty_text' END,
  CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]') THEN 'control_character' END,
  CASE WHEN length(text) <= 4 THEN 'short_text' END,
  CASE WHEN length(text) > 400 THEN 'long_text' END,
  CASE WHEN regexp_matches(text, 'https?://') THEN 'contains_url' END,
  CASE WHEN contains(text, '@') THEN 'contains_at_sign' END""".replace("WS", _WS)
_IMPORT = r"""
  CASE WHEN regexp_matches(text, '[\r\n]') THEN 'multiline_text' END,
  CASE WHEN regexp_matches(text, '^WS|WS$') THEN 'boundary_whitespace' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_characters' END""".replace("WS", _WS)
_REPLIES = """r AS (SELECT CAST(conv_id AS VARCHAR) AS scope, CAST(turn + 1 AS VARCHAR) AS own,
  CASE WHEN turn = 0 THEN '0' WHEN conv_id % 9 = 0 AND turn = 2 THEN '99' WHEN conv_id % 10 = 0 AND turn = 1 THEN '2' ELSE CAST(turn AS VARCHAR) END AS parent,
  CASE WHEN turn = 0 THEN '0' WHEN conv_id % 8 = 0 THEN '77' ELSE '1' END AS root,
  CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text FROM conversations)"""

ORACLES = {
    "text_signals": f"SELECT doc_id, array_to_string({_SIGNALS}, ',') AS signals FROM (SELECT *, string_split(text, '') AS ch FROM documents)",
    "quality_flags": f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter([{_IMPORT}, {_FLAGS}], lambda x: x IS NOT NULL))), ','), '') AS flags FROM documents""",
    "row_reject_reasons": r"""
WITH r AS (SELECT doc_id,
  CASE WHEN doc_id % 11 = 0 THEN doc_id || 'E+3' WHEN doc_id % 7 = 0 THEN '0' || doc_id ELSE CAST(doc_id + 1 AS VARCHAR) END AS rpid,
  CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE CAST(1200000000 + doc_id * 900000 AS VARCHAR) END AS ctime,
  CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) ELSE text END AS message FROM documents),
s AS (SELECT *, CASE WHEN regexp_matches(ctime, '^(0|[1-9][0-9]*)$') THEN CAST(ctime AS BIGINT) END AS st FROM r),
t AS (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(rpid, '^[1-9][0-9]*$') THEN NULL
       WHEN regexp_matches(rpid, '^[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$') THEN 'scientific_notation:rpid' ELSE 'invalid_identifier:rpid' END,
  CASE WHEN st IS NULL THEN 'invalid_timestamp' END,
  CASE WHEN st < 1230739200 OR st >= 1900000000 THEN 'timestamp_out_of_range' END,
  CASE WHEN regexp_matches(message, '^\s*$') THEN 'empty_text' END], lambda x: x IS NOT NULL) AS l FROM s)
SELECT doc_id, coalesce(array_to_string(l, ','), '') AS reasons, len(l) = 0 AS accepted FROM t""",
    "file_fingerprint": """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256,
       sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS git_blob_sha1 FROM documents""",
    "canonical_conflicts": """
WITH r AS (SELECT doc_id AS id, text, lang FROM documents UNION ALL
  SELECT doc_id, CASE WHEN toxic = 1 THEN text || '!' ELSE text END, lang FROM documents JOIN labels USING (doc_id))
SELECT id, count(*) AS members, count(DISTINCT (text, lang)) > 1 AS conflict,
       CASE WHEN count(DISTINCT (text, lang)) = 1 THEN CAST(max(length(text)) AS BIGINT) END AS n_chars FROM r GROUP BY id""",
    "exact_text_groups": """
SELECT sha256(text) AS text_sha256, min(doc_id) AS group_id, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids
FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1""",
    "video_components": """
WITH RECURSIVE x AS (SELECT source || '-' || (doc_id % 97) AS grp, text FROM documents),
e AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM x a JOIN x b ON a.text = b.text AND a.text <> '' AND a.grp <> b.grp),
r AS (SELECT DISTINCT grp AS n, grp AS m FROM x UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
SELECT n AS grp, 'video-component:' || min(m) AS component FROM r GROUP BY n""",
    "root_context": f"""
WITH {_REPLIES}
SELECT a.id, b.id AS context_id, CAST(length(b.text) AS BIGINT) AS context_chars,
       CASE WHEN a.root <> '0' AND a.root <> a.own AND b.id IS NULL THEN 'incomplete_context' END AS context_issue
FROM r a LEFT JOIN r b ON a.scope = b.scope AND b.own = a.root AND a.root <> '0' AND a.root <> a.own""",
    "parent_chain": f"""
WITH RECURSIVE {_REPLIES},
w AS (SELECT id, scope, parent AS next, [own] AS seen, CAST(NULL AS VARCHAR) AS top, 0 AS n, CAST(NULL AS VARCHAR) AS issue FROM r
  UNION ALL
  SELECT w.id, w.scope, CASE WHEN list_contains(w.seen, w.next) OR p.id IS NULL THEN '0' ELSE p.parent END, list_append(w.seen, w.next),
    CASE WHEN list_contains(w.seen, w.next) THEN w.top ELSE coalesce(p.id, w.top) END,
    CASE WHEN list_contains(w.seen, w.next) OR p.id IS NULL THEN w.n ELSE w.n + 1 END,
    CASE WHEN list_contains(w.seen, w.next) THEN 'context_cycle' WHEN p.id IS NULL THEN 'incomplete_context' END
  FROM w LEFT JOIN r p ON p.scope = w.scope AND p.own = w.next WHERE w.next <> '0')
SELECT w.id, CAST(w.n AS BIGINT) AS chain_length, w.top AS top_id,
  coalesce(w.issue, CASE WHEN r.root <> '0' AND w.n > 0 AND w.top IS DISTINCT FROM t.id THEN 'context_root_mismatch' END) AS context_issue
FROM w JOIN r ON r.id = w.id LEFT JOIN r t ON t.scope = r.scope AND t.own = r.root WHERE w.next = '0'""",
    "unresolved_pointers": f"""
WITH {_REPLIES}
SELECT id, 'unresolved_root' AS flag FROM r a WHERE root <> '0' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.scope = a.scope AND b.own = a.root)
UNION ALL SELECT id, 'unresolved_parent' FROM r a WHERE parent <> '0' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.scope = a.scope AND b.own = a.parent)""",
    "eligible_pools": """
SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'candidate' ELSE 'control' END AS pool
FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-20' AND NOT value < 5""",
    "prepare_summary": f"""
WITH x AS (SELECT *, string_split(text, '') AS ch FROM documents)
SELECT 'lang' AS kind, lang AS name, count(*) AS n FROM x GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY source
UNION ALL SELECT 'signal', s, count(*) FROM (SELECT unnest({_SIGNALS}) AS s FROM x) GROUP BY s
UNION ALL SELECT 'flag', s, count(*) FROM (SELECT unnest(list_filter([{_FLAGS}], lambda y: y IS NOT NULL)) AS s FROM x) GROUP BY s
UNION ALL SELECT 'unique', 'texts', count(DISTINCT text) FROM x""",
    "first_seen_dedup": """
SELECT doc_id AS id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents""",
    "group_quota_sample": """
SELECT * FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host,
  row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY sha256(url), url) AS place FROM pages) WHERE place <= 3""",
    "inspection_sample": """
SELECT doc_id, d AS has_digit FROM (SELECT doc_id, regexp_matches(text, '[0-9]') AS d,
  row_number() OVER (PARTITION BY regexp_matches(text, '[0-9]') ORDER BY doc_id) AS p FROM documents) WHERE p <= 50""",
}
