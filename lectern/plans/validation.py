"""Validation queries: documents, labels and benchmark texts as cases, samples and runs, some of them faulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import validation as V
from lectern.operators.splits import linked_groups
from lectern.storage import materialize, table

_ORIGIN = {"origin": "original", "license": "Apache-2.0"}


def _every(n: int, rest: int, of: str = "doc_id") -> Column:
    return F.col(of) % n == rest


def _cases(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    shift = F.when(_every(10, 9), 1).otherwise(0)
    refs = (
        F.when(_every(5, 0), F.array().cast("array<string>"))
        .when(_every(5, 1), F.array(F.concat(F.lit("  "), text, F.lit("  "))))
        .when(_every(5, 2), F.array(F.concat(text, F.lit("!"))))
        .when(_every(5, 3), F.array(text, F.lit(" ")))
        .otherwise(F.array(text))
    )
    return table(spark, d, "documents").select(
        F.when(~_every(50, 7), (F.col("doc_id") - shift).cast("string")).alias("id"), "text", refs.alias("refs"),
        F.when(F.col("lang") == "fr", "").otherwise("plain").alias("family"), F.when(F.col("lang") == "en", "preservation").otherwise("core_tn").alias("track"))


def case_validation(spark: SparkSession, d: str) -> DataFrame:
    return V.case_problems(_cases(spark, d))


def reference_coverage(spark: SparkSession, d: str) -> DataFrame:
    return V.reference_coverage(_cases(spark, d))


def annotation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with their first word and what follows it as targets, and two characters protected."""
    rows = table(spark, d, "benchmark").withColumn("word", F.regexp_extract("text", r"^[^ ]+", 0)).withColumn("m", F.length("word"))

    def at(name: str, start: Column, end: Column, said: Column, *more: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), said.alias(name), *more)

    low = F.col("m") - F.when(_every(5, 2, "item_id"), 1).otherwise(0)
    between = F.substring("text", low + 1, F.col("m") + 1 - low)
    first = at("source", F.lit(0), F.col("m"), F.when(_every(3, 1, "item_id"), F.lit("?")).otherwise(F.col("word")), F.array(F.upper("word")).alias("outputs"))
    second = at("source", low, F.col("m") + 1, between, F.array(between).alias("outputs"))
    own = F.when(_every(7, 3, "item_id"), F.lit("??")).otherwise(F.substring("text", F.col("m") + 2, F.lit(2)))
    fixed = at("text", F.col("m") + 1, F.col("m") + 3, own)
    wanted = F.concat(F.when(_every(4, 1, "item_id"), F.lit("?")).otherwise(F.upper("word")), F.substr(F.col("text"), F.col("m") + 1))
    return V.annotation_problems(rows.select(F.col("item_id").cast("string").alias("id"), "text", F.array(wanted).alias("refs"),
                                             F.array(first, second).alias("targets"), F.array(fixed).alias("protected")))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as draft samples: good ones transform, toxic ones change."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    target = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", F.coalesce("source", F.lit("")).alias("skill_id"), (F.col("doc_id") % 40).cast("string").alias("group_id"), "text",
        target.alias("target"), F.when(_every(11, 2), " ").otherwise("as said").alias("rationale"),
        F.when(_every(17, 4), "test").when(_every(5, 0), "validation").otherwise("train").alias("proposed_role"),
        F.when(F.col("lang") == "en", "preservation").otherwise("core_tn").alias("track"),
        F.when(F.col("quality") == 1, "transform").otherwise("preserve").alias("operation"),
        F.when(_every(13, 5), F.array(F.lit("?"))).otherwise(F.array(target)).alias("acceptable_outputs"),
        _every(19, 6).alias("training_ready"),
        F.create_map(F.lit("origin"), F.lit("original"), F.lit("license"), F.when(_every(23, 7), "none").otherwise("Apache-2.0")).alias("provenance"))


def sample_validation(spark: SparkSession, d: str) -> DataFrame:
    return V.sample_problems(_samples(spark, d), _ORIGIN)


def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    return V.coverage_problems(_samples(spark, d).where(F.col("proposed_role").isin(*V.ROLES)))


def merged_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by what declared groups turn out to be: rows whose texts are equal but for numbers are one group."""
    rows = materialize(_samples(spark, d).where(F.col("proposed_role").isin(*V.ROLES)), "samples")
    template = F.sha2(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s+", ""), r"[0-9]+(\.[0-9]+)*", "<number>").cast("binary"), 256)
    keyed = rows.select(F.monotonically_increasing_id().alias("id"), "skill_id", "group_id", "proposed_role", "operation", template.alias("template"))
    keyed = materialize(keyed, "keyed-samples")
    parts = linked_groups(keyed.select("id", "group_id", "template"), ["group_id", "template"]).select("id", "component")
    found = V.coverage_problems(keyed.join(parts, "id"), group="component")
    return found.groupBy("kind", "skill_id", "role").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


def training_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a registered training set, whose validation side has some ids again."""
    side = F.when(_every(9, 0), "validation").otherwise("train")
    rows = table(spark, d, "documents").select(
        side.alias("role"), (F.col("doc_id") - F.when(_every(9, 1), 1).otherwise(0)).cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("text", F.lit("")).alias("target"), F.lit("core_tn").alias("track"), F.when(_every(21, 5), "").otherwise("plain").alias("family"),
        F.floor(F.col("doc_id") / 6).cast("string").alias("group_id"), F.array(F.coalesce("text", F.lit(""))).alias("acceptable_outputs"),
        F.create_map(F.lit("origin"), F.lit("original"), F.lit("license"), F.lit("Apache-2.0"), F.lit("assigned_role"),
                     F.when(_every(18, 9), "train").otherwise(side)).alias("provenance"))
    return V.training_problems(rows, _ORIGIN)


def run_identity(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as runs: the role of each turn against those that its place allows."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").cast("string").alias("key"), F.col("role").alias("value"))
    wanted = turns.select("run", "key", F.explode(F.when(F.col("key") == "1", F.array(F.lit("assistant"), F.lit("tool"))).otherwise(F.array(F.lit("user")))).alias("value"))
    return V.identity_problems(wanted, turns)


def run_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as runs of three checks; one of them is missing for some."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("run"), F.explode(F.array(
        F.struct(F.lit("good").alias("name"), (F.col("quality") == 1).alias("holds")), F.struct(F.lit("clean").alias("name"), (F.col("toxic") == 0).alias("holds")),
        F.struct(F.when(_every(4, 0), "other").otherwise("known").alias("name"), F.lit(True).alias("holds")))).alias("c")).select("run", "c.*")
    return V.integrity(rows, ("good", "clean", "known"))


def squeezed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.squeezed(F.col("text")).cast("binary"), 256).alias("key"))


def masked_signature(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with words of four letters or fewer as noncanonical tokens, of a type by their length."""
    tokens = F.transform(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: F.struct(
        (F.length(w) < 5).alias("is_nc"), F.when(F.length(w) > 2, F.length(w).cast("string")).alias("nc_type"), w.alias("canonical")))
    return table(spark, d, "benchmark").select("item_id", T.masked_signature(tokens).alias("signature"))


def alternative_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sources as surfaces: each of their documents accepts two residues of its number."""
    near = F.array((F.col("doc_id") % 12).cast("string"), F.when(_every(3, 0), ((F.col("doc_id") % 12) + 3).cast("string")))
    return V.alternative_groups(table(spark, d, "documents").select(F.col("source").alias("key"), near.alias("accepted")))


QUERIES = {
    f.__name__: f
    for f in (
        case_validation, reference_coverage, annotation_validation, sample_validation, sample_coverage, merged_coverage, training_validation,
        run_identity, run_integrity, squeezed_text, masked_signature, alternative_groups,
    )
}

_SAMPLES = """s AS (SELECT doc_id, coalesce(source, '') AS skill_id, CAST(doc_id % 40 AS VARCHAR) AS group_id, quality, toxic, lang, text,
  CASE WHEN doc_id % 17 = 4 THEN 'test' WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS role FROM documents JOIN labels USING (doc_id))"""
_SQUEEZED = r"replace(lower(regexp_replace(nfc_normalize(text), '\s+', '', 'g')), 'ß', 'ss')"
ORACLES = {
    "case_validation": """WITH c AS (SELECT *, CASE WHEN doc_id % 50 <> 7 THEN CAST(doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR) END AS id FROM documents),
p AS (SELECT id, 'missing_id' AS problem FROM c WHERE id IS NULL
UNION ALL SELECT id, 'bad_references' FROM c WHERE doc_id % 5 IN (0, 3) OR text IS NULL OR text = ''
UNION ALL SELECT id, 'missing_field' FROM c WHERE lang = 'fr' OR text IS NULL OR text = ''
UNION ALL SELECT id, 'preservation_changes' FROM c WHERE lang = 'en' AND doc_id % 5 IN (2, 3) AND text <> '')
SELECT id, problem, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT id, 'repeated_id', count(*) FROM c WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
    "reference_coverage": "SELECT count(*) FILTER (doc_id % 5 <> 0) AS scored, count(*) FILTER (doc_id % 5 = 0) AS pending FROM documents",
    "annotation_validation": """SELECT CAST(item_id AS VARCHAR) AS id, problem, 1 AS n FROM (SELECT item_id, unnest(list_filter([
  CASE WHEN item_id % 5 = 2 THEN 'bad_offsets' END, CASE WHEN item_id % 3 = 1 THEN 'source_differs' END,
  CASE WHEN item_id % 5 <> 2 AND item_id % 4 = 1 THEN 'replay_differs' END, CASE WHEN item_id % 7 = 3 THEN 'bad_protected' END],
  lambda x: x IS NOT NULL)) AS problem FROM benchmark)""",
    "sample_validation": f"""WITH {_SAMPLES} SELECT CAST(doc_id AS VARCHAR) AS id, problem, 1 AS n FROM (SELECT doc_id, unnest(list_filter([
  CASE WHEN trim(skill_id) = '' THEN 'missing:skill_id' END, CASE WHEN doc_id % 11 = 2 THEN 'missing:rationale' END,
  CASE WHEN role = 'test' THEN 'invalid:proposed_role' END, CASE WHEN doc_id % 13 = 5 THEN 'bad_outputs' END,
  CASE WHEN quality <> 1 AND toxic = 1 THEN 'preserve_changes_text' END, CASE WHEN quality = 1 AND toxic <> 1 THEN 'transform_keeps_text' END,
  CASE WHEN lang = 'en' AND quality = 1 THEN 'preservation_needs_preserve' END, CASE WHEN doc_id % 19 = 6 THEN 'ready_draft' END,
  CASE WHEN doc_id % 23 = 7 THEN 'bad_provenance' END], lambda x: x IS NOT NULL)) AS problem FROM s)""",
    "sample_coverage": f"""WITH {_SAMPLES}, v AS (SELECT * FROM s WHERE role <> 'test'),
r AS (SELECT k.skill_id, k.role, count(DISTINCT v.group_id) AS n, count(*) FILTER (v.quality = 1) AS t
  FROM (SELECT DISTINCT skill_id, unnest(['train', 'validation']) AS role FROM v) k LEFT JOIN v ON v.skill_id = k.skill_id AND v.role = k.role GROUP BY ALL)
SELECT 'group_cross_role' AS kind, NULL AS skill_id, group_id, NULL AS role, 2 AS n FROM v GROUP BY group_id HAVING count(DISTINCT role) > 1
UNION ALL SELECT 'missing_operation', skill_id, NULL, NULL, count(*) FROM v GROUP BY skill_id HAVING count(DISTINCT quality = 1) < 2
UNION ALL SELECT 'insufficient_groups', skill_id, NULL, role, n FROM r WHERE n < CASE role WHEN 'train' THEN 2 ELSE 1 END
UNION ALL SELECT 'missing_transform', skill_id, NULL, role, n FROM r WHERE t = 0""",
    "merged_coverage": rf"""WITH RECURSIVE {_SAMPLES}, v AS (SELECT *, regexp_replace(regexp_replace(lower(text), '[\s\x0b]+', '', 'g'), '[0-9]+(\.[0-9]+)*', '<number>', 'g') AS tpl FROM s WHERE role <> 'test'),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON (a.group_id = b.group_id OR a.tpl = b.tpl) AND a.doc_id <> b.doc_id),
w AS (SELECT doc_id AS n, doc_id AS m FROM v UNION SELECT w.n, e.b FROM w JOIN e ON w.m = e.a),
c AS (SELECT v.*, component FROM v JOIN (SELECT n, min(m) AS component FROM w GROUP BY n) ON n = doc_id),
r AS (SELECT k.skill_id, k.role, count(DISTINCT c.component) AS n, count(*) FILTER (c.quality = 1) AS t
  FROM (SELECT DISTINCT skill_id, unnest(['train', 'validation']) AS role FROM c) k LEFT JOIN c ON c.skill_id = k.skill_id AND c.role = k.role GROUP BY ALL),
f AS (SELECT 'group_cross_role' AS kind, NULL AS skill_id, NULL AS role, 2 AS n FROM c GROUP BY component HAVING count(DISTINCT role) > 1
UNION ALL SELECT 'missing_operation', skill_id, NULL, count(*) FROM c GROUP BY skill_id HAVING count(DISTINCT quality = 1) < 2
UNION ALL SELECT 'insufficient_groups', skill_id, role, n FROM r WHERE n < CASE role WHEN 'train' THEN 2 ELSE 1 END
UNION ALL SELECT 'missing_transform', skill_id, role, n FROM r WHERE t = 0)
SELECT kind, skill_id, role, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL""",
    "training_validation": rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'validation' ELSE 'train' END AS role, coalesce(text, '') AS text,
  CAST(doc_id - CASE WHEN doc_id % 9 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS id, CAST(doc_id // 6 AS VARCHAR) AS g FROM documents),
k AS (SELECT *, sha256({_SQUEEZED}) AS source FROM t),
p AS (SELECT role, id, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'missing:text' END, CASE WHEN trim(text) = '' THEN 'missing:target' END,
  CASE WHEN doc_id % 21 = 5 THEN 'missing:family' END, CASE WHEN trim(text) = '' THEN 'bad_outputs' END,
  CASE WHEN doc_id % 18 = 9 THEN 'bad_provenance' END], lambda x: x IS NOT NULL)) AS problem FROM k)
SELECT role, id, problem, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT role, id, 'repeated_id', count(*) FROM k GROUP BY role, id HAVING count(*) > 1
UNION ALL SELECT role, source, 'repeated_source', count(*) FROM k GROUP BY role, source HAVING count(*) > 1
UNION ALL SELECT role, NULL, 'row_count', count(*) FROM k GROUP BY role HAVING count(*) > CASE role WHEN 'train' THEN 256 ELSE 64 END
UNION ALL SELECT NULL, id, 'overlap:id', count(*) FROM k GROUP BY id HAVING count(DISTINCT role) > 1
UNION ALL SELECT NULL, g, 'overlap:group_id', count(*) FROM k GROUP BY g HAVING count(DISTINCT role) > 1
UNION ALL SELECT NULL, source, 'overlap:source', count(*) FROM k GROUP BY source HAVING count(DISTINCT role) > 1""",
    "run_identity": """SELECT DISTINCT conv_id AS run, CAST(turn AS VARCHAR) AS key, role AS actual FROM conversations
WHERE NOT coalesce(CASE WHEN turn = 1 THEN role IN ('assistant', 'tool') ELSE role = 'user' END, false)""",
    "run_integrity": """SELECT DISTINCT doc_id AS run, failed = '' AS eligible, failed FROM (SELECT doc_id, concat_ws(',', CASE WHEN toxic <> 0 THEN 'clean' END,
  CASE WHEN quality <> 1 THEN 'good' END, CASE WHEN doc_id % 4 = 0 THEN 'known' END) AS failed FROM labels)""",
    "squeezed_text": f"SELECT doc_id, sha256({_SQUEEZED}) AS key FROM documents",
    "masked_signature": r"""SELECT item_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '),
  lambda w: CASE WHEN length(w) < 3 THEN '<NC:None>' WHEN length(w) < 5 THEN '<NC:' || length(w) || '>' ELSE w END), ' '), '\s+', ' ', 'g')) AS signature FROM benchmark""",
    "alternative_groups": """WITH RECURSIVE a AS (SELECT source AS key, doc_id % 12 AS x, CASE WHEN doc_id % 3 = 0 THEN doc_id % 12 + 3 ELSE doc_id % 12 END AS y FROM documents WHERE source IS NOT NULL),
f AS (SELECT key, x AS v FROM a UNION SELECT key, y FROM a),
r AS (SELECT key, v AS n, v AS m FROM f UNION SELECT r.key, r.n, e.w FROM r JOIN (SELECT key, x AS v, y AS w FROM a UNION SELECT key, y, x FROM a) e ON e.key = r.key AND e.v = r.m),
c AS (SELECT key, n, min(m) AS c FROM r GROUP BY key, n)
SELECT key, count(*) AS forms, count(DISTINCT c) AS groups FROM c GROUP BY key""",
}
