"""Scoring queries over cases and predictions made from the documents by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import scoring as S
from lectern.storage import table

SYSTEMS = ("identity", "upper", "spaced")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    own, lang = F.col("text"), F.col("lang")
    track = F.when(lang == "en", "core_tn").when(lang == "fr", "context_reading").otherwise("preservation")
    refs = F.when(track == "preservation", F.array(own)).when(track == "core_tn", F.array(F.upper(own), own)).otherwise(F.array(F.upper(own)))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("family"), track.alias("track"), own.alias("text"), refs.alias("refs"))


def _predictions(spark: SparkSession, d: str, system: str) -> DataFrame:
    """A system answers the labelled documents alone, and fails on the toxic ones."""
    own, good = F.col("text"), F.col("quality") == 1
    made = {
        "identity": own,
        "upper": F.when(good, F.upper(own)).otherwise(own),
        "spaced": F.when(good, F.concat(F.lit("  "), F.upper(own))).otherwise(F.lit(" ")),
    }[system]
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), made.alias("prediction"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))


def _scored(spark: SparkSession, d: str, system: str) -> DataFrame:
    return S.score_cases(_cases(spark, d), _predictions(spark, d, system))


def _compared(spark: SparkSession, d: str, systems: tuple[str, ...]) -> DataFrame:
    said = reduce(DataFrame.unionByName, (_predictions(spark, d, x).withColumn("system", F.lit(x)) for x in systems))
    return S.score_systems(_cases(spark, d), said, systems)


def score_cases(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "spaced")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summarize(_scored(spark, d, "upper"))


def family_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.families(_scored(spark, d, "upper"))


def development_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Counts by each of five dimensions and role, from one pass over five grouping sets."""
    cases = _cases(spark, d)
    accepted = cases.select("id", F.array_contains("refs", F.col("text")).alias("source_accepted"),
                            F.when(F.sha2(F.col("id").cast("string").cast("binary"), 256) < "4", "validation").otherwise("train").alias("role"),
                            F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 2, 1).alias("skill"), F.lit("v1").alias("version"))
    rows = _scored(spark, d, "upper").join(accepted, "id")
    rows = rows.withColumn("category", S.category(rows))
    dims = ["track", "family", "version", "skill", "category"]
    long = rows.select("role", "surface_correct", F.explode(F.array(*[
        F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in dims])).alias("x"))
    return long.groupBy("role", "x.dimension", "x.value").agg(
        F.count("*").alias("n"), F.count_if("surface_correct").alias("matches"),
        S.ratio(F.count_if("surface_correct"), F.count("*")).alias("rate"))


def paired_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_changes(_compared(spark, d, SYSTEMS[:2]), *SYSTEMS[:2])


def comparison_matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.comparison_matrix(_compared(spark, d, SYSTEMS), SYSTEMS)


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Median, largest and exact sum by kind; the sum in decimals, so its order doesn't matter."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(F.median("value"), 6).alias("median"), F.max("value").alias("largest"),
        F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))


def unknown_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions without a case, and cases with two: both are errors."""
    cases = _cases(spark, d).where("track <> 'preservation'")
    predictions = _predictions(spark, d, "identity")
    twice = predictions.unionByName(predictions.where("status = 'error'")).groupBy("id").count().where("count > 1")
    return predictions.join(cases, "id", "left_anti").select("id", F.lit("unknown").alias("problem")).unionByName(
        twice.select("id", F.lit("duplicate").alias("problem")))


def blind_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("system"))
    return S.blind_order(rows, salt="lectern-blind-1")


def surface_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("金额１２元，已 收。“A　B” "), F.col("text"), F.lit(" 、结 ‘ok’"))
    return table(spark, d, "documents").select("doc_id", T.surface(text).alias("surface"))


def numeric_template(spark: SparkSession, d: str) -> DataFrame:
    """Keys of every text with numbers before it."""
    text = F.concat(F.lit("Item 12.5 of "), F.col("doc_id").cast("string"), F.lit(": "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.numeric_template(text).alias("template"))


QUERIES = {
    f.__name__: f
    for f in (
        score_cases, score_summary, family_summary, development_breakdown, paired_changes, comparison_matrix,
        latency_stats, unknown_predictions, blind_order, surface_normalize, numeric_template,
    )
}

_WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_surface(x: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "。“”‘’、"
    narrow = ("".join(chr(c) for c in range(0x21, 0x7F)) + ".\"\"'',").replace("'", "''")
    collapsed = f"trim(regexp_replace(translate(nfc_normalize({x}), '{wide}', '{narrow}'), '{_WS}', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({collapsed}, '([㐀-鿿]) +', '\\1', 'g'), ' +([㐀-鿿])', '\\1', 'g')"


def _sql_base(system: str) -> str:
    made = {
        "identity": "text",
        "upper": "CASE WHEN quality = 1 THEN upper(text) ELSE text END",
        "spaced": "CASE WHEN quality = 1 THEN '  ' || upper(text) ELSE ' ' END",
    }[system]
    return f"""{system}_c AS (SELECT doc_id AS id, source AS family, text,
  CASE lang WHEN 'en' THEN 'core_tn' WHEN 'fr' THEN 'context_reading' ELSE 'preservation' END AS track,
  CASE lang WHEN 'en' THEN [upper(text), text] WHEN 'fr' THEN [upper(text)] ELSE [text] END AS refs FROM documents),
{system}_p AS (SELECT doc_id AS id, {made} AS prediction, CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS status FROM documents JOIN labels USING (doc_id)),
{system}_j AS (SELECT c.*, coalesce(regexp_matches(prediction, '[^\\s]'), false) AS output_valid, coalesce(status, 'missing') AS st,
  CASE WHEN regexp_matches(prediction, '[^\\s]') THEN prediction ELSE '' END AS prediction FROM {system}_c c LEFT JOIN {system}_p USING (id)),
{system}_k AS (SELECT *, CASE WHEN st = 'ok' AND NOT output_valid THEN 'empty_or_invalid' ELSE st END AS status FROM {system}_j),
{system}_s AS (SELECT id, family, track, status, output_valid, status = 'ok' AND list_contains(refs, prediction) AS strict_correct,
  status = 'ok' AND list_contains(list_transform(refs, lambda r: {_sql_surface("r")}), {_sql_surface("prediction")}) AS surface_correct,
  {_sql_surface("prediction")} <> {_sql_surface("text")} AS changed_source, list_contains(refs, text) AS source_accepted FROM {system}_k)"""


ORACLES = {
    "score_cases": f"WITH {_sql_base('spaced')} SELECT * EXCLUDE (source_accepted) FROM spaced_s",
    "score_summary": f"""WITH {_sql_base('upper')},
t AS (SELECT coalesce(track, '(all)') AS track, count(*) AS total, count(*) FILTER (status = 'ok') AS completed,
  count(*) FILTER (strict_correct) AS strict_correct, count(*) FILTER (surface_correct) AS surface_correct,
  count(*) FILTER (track = 'preservation') AS preservation_total,
  count(*) FILTER (track0 = 'preservation' AND status = 'ok' AND changed_source) AS preservation_changed,
  count(*) FILTER (track0 = 'preservation' AND status <> 'ok') AS preservation_failed_or_missing,
  count(*) FILTER (track0 = 'preservation') AS pt
  FROM (SELECT *, track AS track0 FROM upper_s) GROUP BY GROUPING SETS ((track), ()))
SELECT track, total, completed, total - completed AS failed_or_missing, strict_correct, strict_correct / total AS strict_accuracy,
  surface_correct, surface_correct / total AS surface_accuracy, pt AS preservation_total, preservation_changed, preservation_failed_or_missing,
  CASE WHEN pt > 0 THEN (preservation_changed + preservation_failed_or_missing) / pt END AS preservation_violation_rate FROM t""",
    "family_summary": f"""WITH {_sql_base('upper')}
SELECT count(*) AS families, count(*) FILTER (g) AS all_correct FROM (SELECT family, bool_and(surface_correct) AS g FROM upper_s GROUP BY family)""",
    "development_breakdown": f"""WITH {_sql_base('upper')},
x AS (SELECT *, CASE WHEN sha256(CAST(id AS VARCHAR)) < '4' THEN 'validation' ELSE 'train' END AS role, substr(sha256(CAST(id AS VARCHAR)), 2, 1) AS skill, 'v1' AS version,
  CASE WHEN status <> 'ok' THEN 'execution_failure' WHEN surface_correct THEN 'reference_match'
       WHEN source_accepted AND changed_source THEN 'changed_acceptable_original'
       WHEN NOT source_accepted AND NOT changed_source THEN 'unchanged_required_conversion' ELSE 'other_reference_mismatch' END AS category FROM upper_s),
u AS (SELECT role, surface_correct, 'track' AS dimension, track AS value FROM x UNION ALL SELECT role, surface_correct, 'family', family FROM x
  UNION ALL SELECT role, surface_correct, 'version', version FROM x UNION ALL SELECT role, surface_correct, 'skill', skill FROM x
  UNION ALL SELECT role, surface_correct, 'category', category FROM x)
SELECT role, dimension, value, count(*) AS n, count(*) FILTER (surface_correct) AS matches, count(*) FILTER (surface_correct) / count(*) AS rate
FROM u GROUP BY ALL""",
    "paired_changes": f"""WITH {_sql_base('identity')}, {_sql_base('upper')}
SELECT CASE WHEN NOT a.surface_correct AND b.surface_correct THEN 'new_matches' WHEN a.surface_correct AND NOT b.surface_correct THEN 'regressions'
  WHEN a.surface_correct THEN 'both' ELSE 'neither' END AS change, count(*) AS n FROM identity_s a JOIN upper_s b USING (id) GROUP BY 1""",
    "comparison_matrix": f"""WITH {_sql_base('identity')}, {_sql_base('upper')}, {_sql_base('spaced')}
SELECT id, CASE WHEN a.surface_correct THEN 'match' ELSE a.status END AS identity, CASE WHEN b.surface_correct THEN 'match' ELSE b.status END AS upper,
  CASE WHEN c.surface_correct THEN 'match' ELSE c.status END AS spaced FROM identity_s a JOIN upper_s b USING (id) JOIN spaced_s c USING (id)""",
    "latency_stats": """SELECT event_type, round(median(value), 6) AS median, max(value) AS largest,
  CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events GROUP BY event_type""",
    "unknown_predictions": """SELECT doc_id AS id, 'unknown' AS problem FROM documents JOIN labels USING (doc_id) WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT doc_id, 'duplicate' FROM labels WHERE toxic = 1""",
    "blind_order": """SELECT id, chr(CAST(64 + row_number() OVER (PARTITION BY id ORDER BY sha256('lectern-blind-1|' || id || '|' || system), system) AS INTEGER)) AS label, system
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(['identity', 'upper', 'spaced']) AS system FROM documents)""",
    "surface_normalize": "SELECT doc_id, " + _sql_surface("'金额１２元，已 收。“A　B” ' || text || ' 、结 ‘ok’'") + " AS surface FROM documents",
    "numeric_template": r"""SELECT doc_id, regexp_replace(regexp_replace(replace(lower('Item 12.5 of ' || doc_id || ': ' || nfc_normalize(text)), 'ß', 'ss'),
  '[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g'), '[0-9]+(\.[0-9]+)*', '<number>', 'g') AS template FROM documents""",
}
