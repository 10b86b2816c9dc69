"""Source queries: each document as a captured file, a Markdown page, JSON lines and a manifest entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import local as O
from lectern.sources import capture, jsonl, manifest, prose
from lectern.storage import table

_HEADER = "bv_id,oid,rpid,root_rpid,parent_rpid,ctime,message\r\n"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One capture file a document: its text as one quoted field of one row."""
    own = F.col("doc_id").cast("string")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    stamp = F.when(F.col("lang") == "es", "soon").when(F.col("lang") == "de", "1000000000").otherwise((F.lit(1_600_000_000) + F.col("doc_id")).cast("string"))
    rpid = F.when(F.col("lang") == "fr", F.concat(own, F.lit("E+4"))).otherwise((F.col("doc_id") + 1).cast("string"))
    row = F.concat(F.lit("BV1aaaaaaaaa,7,"), rpid, F.lit(",0,0,"), stamp, F.lit(","), quoted, F.lit("\r\n"))
    return table(spark, d, "documents").select(own.alias("path"), F.concat(F.lit(_HEADER), row).cast("binary").alias("content"), "lang")


def capture_verify(spark: SparkSession, d: str) -> DataFrame:
    """Files against a manifest that is wrong about some: a size, a digest, one listed but missing."""
    files = _files(spark, d)
    kept = files.where("lang <> 'fr'")
    listed = files.where("lang <> 'es'").select("path", (F.octet_length("content") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("bytes"),
        F.sha2("content", 256).alias("sha256"), T.git_blob_sha1(F.col("content")).alias("git_blob_sha"))
    return capture.verify(kept, listed)


def capture_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = capture.judge(capture.scan(_files(spark, d)), before=1_700_000_000)
    return rows.select("path", "record_number", "line_start", "line_end", F.array_join("reasons", ",").alias("reasons"),
                       F.sha2(F.col("message").cast("binary"), 256).alias("message_sha256"))


def prose_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the documents as Markdown, ended by full stops."""
    found = prose.prose_sentences(table(spark, d, "documents"), ends=".!?", least_han=0)
    return found.select("doc_id", "first_line", "last_line", "start", "end", "sentence", "reason")


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents as inference inputs, written as lines and read strictly again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit("\u2028\u0085")).alias("text"))
    back = jsonl.inference_inputs(jsonl.to_lines(docs))
    return back.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "problem")


def directory_totals(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("path"), F.octet_length("html").alias("bytes"))
    return manifest.directory_totals(files)


def member_problems(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.octet_length("html").alias("bytes"))
    return manifest.member_problems(members, most_bytes=4000, suffixes=(".html",), parts=("de",))


def local_alignment(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the first word of the benchmark's texts in an output that changes some of them."""
    own = F.col("text")
    word: Column = F.regexp_extract(own, r"^\S+", 0)
    output = F.when(F.col("item_id") % 3 == 0, F.concat(F.upper(word), F.expr("substring(text, length(regexp_extract(text, '^\\\\S+', 0)) + 1)"))).otherwise(own)
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", output.alias("output"), F.lit("ok").alias("status"),
        F.lit(0).alias("start"), F.length(word).alias("end"), F.upper(word).alias("accepted"))
    return O.score_targets(rows).select("id", "state", "seen")


def outside_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits outside the first ten characters of the benchmark's texts, whose output is in lower case."""
    rows = table(spark, d, "benchmark").select("item_id", O.changed_spans(F.col("text"), F.lower("text")).alias("spans"))
    return rows.select("item_id", F.size(F.filter("spans", lambda s: s["end"] > 10)).cast("long").alias("outside"))


def local_scores(spark: SparkSession, d: str) -> DataFrame:
    """First words are targets and last words protected; answers rewrite the first, some the last, some nothing, some failed."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.regexp_extract("text", r"^\S+", 0).alias("first"), F.regexp_extract("text", r"\S+$", 0).alias("last"))
    n, k = F.length("text"), F.pmod("item_id", F.lit(5))
    middle = F.substring("text", F.length("first") + 1, n - F.length("first") - F.length("last"))
    said = F.when(k == 3, F.col("text")).otherwise(F.concat(F.lit("中文"), middle, F.when(k == 2, "尾").otherwise(F.col("last"))))
    targets = F.array(F.struct(F.lit(0).alias("start"), F.length("first").alias("end"), F.array(F.lit("no"), F.when(k == 1, "文").otherwise("中文")).alias("accepted")))
    protected = F.array(F.struct((n - F.length("last")).alias("start"), n.alias("end"), F.col("last").alias("text")))
    cases = rows.select(F.col("item_id").alias("id"), "text", targets.alias("targets"), protected.alias("protected"))
    answers = rows.select(F.col("item_id").alias("id"), said.alias("prediction"), F.when(k == 4, "error").otherwise("ok").alias("status"))
    found = O.local_scores(cases, answers.where("id > 0"))
    return found.select("id", "status", F.col("targets")[0]["state"].alias("target"), F.col("protected")[0]["state"].alias("protected"), "source_kept",
                        F.when(F.col("status") == "ok", F.size("outside")).otherwise(-1).cast("long").alias("outside"))


QUERIES = {
    f.__name__: f
    for f in (
        local_scores, capture_verify, capture_scan, prose_sentences, jsonl_round_trip, directory_totals, member_problems, local_alignment, outside_edits,
    )
}

ORACLES = {
    "capture_verify": """SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'fr' THEN 'missing' WHEN 'es' THEN 'unlisted' ELSE 'size' END AS problem
FROM documents WHERE lang IN ('fr', 'es', 'de')""",
    "capture_scan": r"""SELECT CAST(doc_id AS VARCHAR) AS path, 2 AS record_number, 2 AS line_start,
  CAST(2 + length(regexp_replace(text, '[^\n]', '', 'g')) AS INTEGER) AS line_end,
  CASE lang WHEN 'fr' THEN 'scientific_notation:rpid' WHEN 'es' THEN 'invalid_timestamp' WHEN 'de' THEN 'timestamp_out_of_range' ELSE '' END AS reasons,
  sha256(text) AS message_sha256 FROM documents""",
    "jsonl_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text || chr(8232) || chr(133)) AS text_sha256, CAST(NULL AS VARCHAR) AS problem FROM documents",
    "directory_totals": r"""SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '.' END AS top, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes
FROM (SELECT regexp_extract(url, '://(.*)$', 1) AS p, strlen(html) AS b FROM pages) GROUP BY 1""",
    "member_problems": r"""WITH m AS (SELECT regexp_replace(url, '^https?://', '') AS path, strlen(html) AS b FROM pages)
SELECT path, CASE WHEN regexp_matches(path, '^/|^[A-Za-z]:|\\|(^|/)\.{1,2}(/|$)|//|/$') OR path = '' THEN 'unsafe_path'
  WHEN list_contains(string_split(lower(path), '/'), 'de') THEN 'forbidden_part' WHEN lower(path) LIKE '%.html' THEN 'forbidden_suffix'
  WHEN b > 4000 THEN 'too_large' END AS problem FROM m WHERE problem IS NOT NULL
UNION ALL SELECT lower(path), 'repeated' FROM m GROUP BY 1 HAVING count(*) > 1""",
    # Lower case changes runs of capitals alone; those that end beyond the tenth character are outside.
    "outside_edits": r"""WITH c AS (SELECT item_id, string_split(text, '') AS c FROM benchmark),
e AS (SELECT item_id, unnest(list_filter(range(1, len(c) + 1), lambda k: lower(c[k]) <> c[k] AND (k = len(c) OR lower(c[k + 1]) = c[k + 1]))) AS last FROM c)
SELECT b.item_id, count(e.last) FILTER (e.last > 10) AS outside FROM benchmark b LEFT JOIN e ON e.item_id = b.item_id GROUP BY 1""",
    "local_alignment": r"""WITH w AS (SELECT item_id AS id, regexp_extract(text, '^\S+', 0) AS word FROM benchmark),
s AS (SELECT *, CASE WHEN id % 3 = 0 THEN upper(word) ELSE word END AS seen FROM w)
SELECT id, CASE WHEN seen = upper(word) THEN 'matched' ELSE 'unmatched' END AS state, seen FROM s""",
    "local_scores": """SELECT item_id AS id, CASE WHEN item_id <= 0 THEN 'missing' WHEN item_id % 5 = 4 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN item_id <= 0 OR item_id % 5 = 4 THEN 'failed' WHEN item_id % 5 IN (1, 3) THEN 'unmatched' ELSE 'matched' END AS target,
  CASE WHEN item_id <= 0 OR item_id % 5 = 4 THEN 'failed' WHEN item_id % 5 = 2 THEN 'changed' ELSE 'preserved' END AS protected,
  item_id > 0 AND item_id % 5 = 3 AS source_kept,
  CAST(CASE WHEN item_id <= 0 OR item_id % 5 = 4 THEN -1 WHEN item_id % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS outside FROM benchmark""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
