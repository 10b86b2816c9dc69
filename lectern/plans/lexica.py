"""Lexicon queries: words of the documents as tokens, their lower-case stems as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lexicon as L
from lectern.storage import table


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every word; English documents are the training side, French and German ones the test side.

    A word's label is its lower-case form without punctuation at the end, or in
    documents of some sources the word as it is, so keys are ambiguous.
    """
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", r"[ \n]+")).alias("pos", "key")).where("key <> ''")
    plain = F.regexp_replace(F.lower("key"), r"[.,|]+$", "")
    label = F.when(F.col("source").isin("src1", "src2", "src3"), F.col("key")).otherwise(plain)
    return rows.select("doc_id", "source", "pos", "key", label.alias("label"), F.col("lang").isin("en", "es").alias("train"),
                       (label != F.col("key")).alias("is_nc"))


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return L.majority(_tokens(spark, d).where("train and is_nc").select("key", "label"))


def majority_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return L.majority(_tokens(spark, d).where("train").select("key", "label"))


def _tested(spark: SparkSession, d: str, lexicon: DataFrame) -> DataFrame:
    return L.lookup(_tokens(spark, d).where("not train").withColumnRenamed("label", "gold"), lexicon)


def lookup_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate and exact matches on the test side's rewritten tokens, by source and overall."""
    rows = _tested(spark, d, _lexicon(spark, d)).where("is_nc")
    right = F.col("hit") & (F.col("predicted") == F.col("gold"))
    out = rows.groupingSets([["source"], []], "source").agg(
        F.count("*").alias("tokens"), F.count_if("hit").alias("hits"), F.count_if(right).alias("correct"),
        F.count_if(F.col("n_labels") > 1).alias("ambiguous_hits"), F.count_if(right & (F.col("n_labels") > 1)).alias("ambiguous_correct"))
    return out.select(F.coalesce("source", F.lit("(all)")).alias("source"), "tokens", "hits", (F.col("hits") / F.col("tokens")).alias("hit_rate"),
                      "correct", F.when(F.col("hits") > 0, F.col("correct") / F.col("hits")).alias("on_hits"), "ambiguous_hits", "ambiguous_correct")


def filtered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon without keys that the training side also has as they are."""
    canonical = _tokens(spark, d).where("train and not is_nc").select("key").distinct()
    return L.rewrite_metrics(_tested(spark, d, _lexicon(spark, d).join(canonical, "key", "left_anti")), "is_nc")


def rewrite_harm(spark: SparkSession, d: str) -> DataFrame:
    return L.rewrite_metrics(_tested(spark, d, _lexicon(spark, d)), "is_nc")


def wrong_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent wrong rewrites of ten or more occurrences; the limit is the report's own."""
    rows = _tested(spark, d, _lexicon(spark, d)).where("not is_nc and predicted <> key and predicted <> gold")
    return rows.groupBy("key", "predicted", "gold").agg(F.count("*").alias("n")).where("n >= 10").orderBy(
        F.desc("n"), "key", "predicted", "gold").limit(10)


def ambiguity_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select("key", "label", F.col("doc_id").alias("context"))
    per = L.ambiguity(rows)
    return per.agg(F.count("*").alias("keys"), F.count_if(F.expr("n_labels > 1")).alias("multilabel"),
                   F.count_if(F.expr("n_labels > 1 and varied")).alias("contextual"), F.sum("errors").alias("least_errors"))


def variant_forms(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated forms and folded keys of every document."""
    forms = F.array_join(F.array_sort(T.alternatives(F.col("text"))), "|")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(forms.cast("binary"), 256).alias("forms_sha256"), F.size(T.alternatives(F.col("text"))).cast("long").alias("n_forms"),
        F.sha2(T.flex(F.col("text")).cast("binary"), 256).alias("flexed_sha256"))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys and rows that both sides of a split have: by text, by template and by group."""
    role = F.when(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256) < "4", "validation").otherwise("train")
    template = F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s+", ""), r"[0-9]+(\.[0-9]+)*", "<number>")
    docs = table(spark, d, "documents").select(role.alias("role"), F.explode(F.array(
        F.struct(F.lit("exact").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("key")),
        F.struct(F.lit("template").alias("kind"), F.sha2(template.cast("binary"), 256).alias("key")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")))).alias("x")).select("role", "x.kind", "x.key")
    train = F.col("role") == "train"
    keys = docs.groupBy("kind", "key").agg(F.count_if(train).alias("t"), F.count_if(~train).alias("v"))
    return keys.groupBy("kind").agg(F.count_if(F.expr("t > 0 and v > 0")).alias("shared_keys"),
        F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("t"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("v"))), F.lit(0)).alias("validation_rows"))


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rows, groups and operations of each skill and role, and what is too little."""
    role = F.when(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256) < "4", "validation").otherwise("train")
    rows = table(spark, d, "documents").select(F.col("lang").alias("skill"), role.alias("role"), F.col("source").alias("grp"),
        F.when(F.col("text").rlike("[0-9]"), "transform").otherwise("preserve").alias("operation"))
    out = rows.groupBy("skill", "role").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("groups"),
        F.count_if(F.expr("operation = 'transform'")).alias("transform"), F.count_if(F.expr("operation = 'preserve'")).alias("preserve"))
    least = F.when(F.col("role") == "train", 2).otherwise(1)
    return out.withColumn("enough", (F.col("groups") >= least) & (F.col("transform") > 0))


def variant_matches(spark: SparkSession, d: str) -> DataFrame:
    """Exact and tolerant matches of the lexicon by source, where some annotations name the word itself as another form."""
    other = F.length("key") % 2 == 0
    rows = _tokens(spark, d).withColumn("label", F.when(other, F.concat("label", F.lit(","), "key")).otherwise(F.col("label")))
    known = L.majority(rows.where("train").select("key", "label")).select("key", F.col("label").alias("predicted"))
    tested = rows.where("not train").select("source", "key", F.when(F.length("key") % 4 == 0, F.col("key")).otherwise(F.col("label")).alias("gold")).join(known, "key", "left")
    return L.match_counts(tested, "source", ("tolerant", L.same_variant(F.col("gold"), F.col("predicted"))))


QUERIES = {
    f.__name__: f
    for f in (
        variant_matches, majority_lexicon, lookup_scores, filtered_lookup, rewrite_harm, wrong_rewrites, ambiguity_counts, split_overlap, coverage_matrix,
    )
} | {"variant_forms": variant_forms}

_TOKENS = r"""t0 AS (SELECT doc_id, lang, source, unnest(regexp_split_to_array(text, '[ \n]+')) AS key FROM documents),
t AS (SELECT *, label <> key AS is_nc, lang IN ('en', 'es') AS train FROM (SELECT doc_id, lang, source, key,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN key ELSE regexp_replace(lower(key), '[.,|]+$', '') END AS label FROM t0 WHERE key <> '')),
c AS (SELECT key, label, count(*) AS n FROM t WHERE train AND is_nc GROUP BY ALL),
x AS (SELECT key, arg_min(label, (-n, label)) AS label, max(n) AS n, sum(n) AS total, count(*) AS n_labels FROM c GROUP BY key),
m AS (SELECT t.*, label AS gold, lx.found, n_labels, coalesce(lx.found, t.key) AS predicted, lx.found IS NOT NULL AS hit
  FROM t LEFT JOIN (SELECT key, label AS found, n_labels FROM x) lx ON lx.key = t.key WHERE NOT train)"""
_METRICS = """SELECT is_nc, count(*) AS tokens, count(*) FILTER (hit) AS hits, count(*) FILTER (predicted <> key) AS rewritten,
  count(*) FILTER (predicted = gold) AS correct, count(*) FILTER (key = gold) AS correct_as_is,
  count(*) FILTER (predicted <> key AND predicted <> gold) AS rewritten_wrong, count(*) FILTER (key = gold AND predicted <> gold) AS introduced,
  count(*) FILTER (key <> gold AND predicted = gold) AS fixed FROM m GROUP BY is_nc"""
_WHITE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORMAL = f"trim(regexp_replace(nfc_normalize(text), '{_WHITE}+', ' ', 'g'))"
_PART = rf"trim(regexp_replace(regexp_replace(p, '\A(\p{{P}}|{_WHITE})+|(\p{{P}}|{_WHITE})+\z', '', 'g'), '{_WHITE}+', ' ', 'g'))"
_FORMS = rf"CASE WHEN regexp_matches({{0}}, '\d,\d') OR len(list_filter(list_transform(string_split({{0}}, ','), lambda p: {_PART.replace('{', '{{').replace('}', '}}')}), lambda p: p <> '')) = 0 THEN [nfc_normalize({{0}})] ELSE list_filter(list_transform(string_split(nfc_normalize({{0}}), ','), lambda p: {_PART.replace('{', '{{').replace('}', '}}')}), lambda p: p <> '') END"
ORACLES = {
    # Of what case folding does to more than single letters only this occurs: sharp s.
    "variant_forms": rf"""WITH n AS (SELECT doc_id, {_NORMAL} AS own FROM documents),
p AS (SELECT doc_id, own, list_distinct(list_filter(list_transform(string_split(own, ','), lambda p: {_PART}), lambda p: p <> '')) AS parts FROM n),
f AS (SELECT *, CASE WHEN regexp_matches(own, '\d,\d') OR len(parts) = 0 THEN [own] ELSE list_sort(parts) END AS forms FROM p)
SELECT doc_id, sha256(array_to_string(forms, '|')) AS forms_sha256, CAST(len(forms) AS BIGINT) AS n_forms,
  sha256(trim(regexp_replace(regexp_replace(replace(lower(own), 'ß', 'ss'), '\p{{P}}', '', 'g'), '{_WHITE}+', ' ', 'g'))) AS flexed_sha256 FROM f""",
    "variant_matches": rf"""WITH {_TOKENS}, y AS (SELECT source, key, train, CASE WHEN length(key) % 2 = 0 THEN label || ',' || key ELSE label END AS label FROM t),
u AS (SELECT key, label, count(*) AS n FROM y WHERE train GROUP BY ALL), z AS (SELECT key, arg_min(label, (-n, label)) AS predicted FROM u GROUP BY key),
g AS (SELECT source, CASE WHEN length(y.key) % 4 = 0 THEN y.key ELSE label END AS gold, predicted FROM y LEFT JOIN z ON z.key = y.key WHERE NOT train),
q AS (SELECT gold, predicted, source, {_FORMS.format("gold")} AS a, {_FORMS.format("predicted")} AS b FROM g)
SELECT source, count(*) AS tokens, count(predicted) AS hits, count(*) FILTER (nfc_normalize(gold) = nfc_normalize(predicted)) AS exact,
  count(*) FILTER (predicted IS NOT NULL AND list_has_any(a, b)) AS tolerant FROM q GROUP BY source""",
    "majority_lexicon": f"""WITH {_TOKENS}, a AS (SELECT key, label, count(*) AS n FROM t WHERE train GROUP BY ALL)
SELECT key, arg_min(label, (-n, label)) AS label, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_labels FROM a GROUP BY key""",
    "lookup_scores": f"""WITH {_TOKENS}
SELECT coalesce(source, '(all)') AS source, count(*) AS tokens, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / count(*) AS hit_rate,
  count(*) FILTER (hit AND predicted = gold) AS correct,
  CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (hit AND predicted = gold) / count(*) FILTER (hit) END AS on_hits,
  count(*) FILTER (n_labels > 1) AS ambiguous_hits, count(*) FILTER (hit AND predicted = gold AND n_labels > 1) AS ambiguous_correct
FROM m WHERE is_nc GROUP BY GROUPING SETS ((source), ())""",
    "filtered_lookup": f"WITH {_TOKENS.replace('FROM c GROUP BY key)', 'FROM c WHERE key NOT IN (SELECT key FROM t WHERE train AND NOT is_nc) GROUP BY key)')} {_METRICS}",
    "rewrite_harm": f"WITH {_TOKENS} {_METRICS}",
    "wrong_rewrites": f"""WITH {_TOKENS} SELECT key, predicted, gold, count(*) AS n FROM m WHERE NOT is_nc AND predicted <> key AND predicted <> gold
GROUP BY ALL HAVING count(*) >= 10 ORDER BY n DESC, key, predicted, gold LIMIT 10""",
    "ambiguity_counts": f"""WITH {_TOKENS}, k AS (SELECT key, label, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT key, count(*) AS n_labels, sum(n) - max(n) AS errors FROM k GROUP BY key),
q AS (SELECT key, count(DISTINCT doc_id) AS n_contexts FROM t GROUP BY key)
SELECT count(*) AS keys, count(*) FILTER (n_labels > 1) AS multilabel, count(*) FILTER (n_labels > 1 AND n_contexts > 1) AS contextual,
  CAST(sum(errors) AS BIGINT) AS least_errors FROM p JOIN q USING (key)""",
    "split_overlap": r"""WITH r AS (SELECT CASE WHEN sha256(CAST(doc_id AS VARCHAR)) < '4' THEN 'validation' ELSE 'train' END AS role, text, source,
  regexp_replace(regexp_replace(lower(text), '[\s\x0b]+', '', 'g'), '[0-9]+(\.[0-9]+)*', '<number>', 'g') AS tpl FROM documents),
u AS (SELECT role, 'exact' AS kind, text AS key FROM r UNION ALL SELECT role, 'template', tpl FROM r UNION ALL SELECT role, 'source', source FROM r),
k AS (SELECT kind, key, count(*) FILTER (role = 'train') AS t, count(*) FILTER (role <> 'train') AS v FROM u GROUP BY ALL)
SELECT kind, count(*) FILTER (t > 0 AND v > 0) AS shared_keys, CAST(coalesce(sum(t) FILTER (v > 0), 0) AS BIGINT) AS train_rows,
  CAST(coalesce(sum(v) FILTER (t > 0), 0) AS BIGINT) AS validation_rows FROM k GROUP BY kind""",
    "coverage_matrix": """WITH r AS (SELECT lang AS skill, CASE WHEN sha256(CAST(doc_id AS VARCHAR)) < '4' THEN 'validation' ELSE 'train' END AS role,
  source AS grp, regexp_matches(text, '[0-9]') AS tr FROM documents),
m AS (SELECT skill, role, count(*) AS rows, count(DISTINCT grp) AS groups, count(*) FILTER (tr) AS transform, count(*) FILTER (NOT tr) AS preserve FROM r GROUP BY ALL)
SELECT *, groups >= CASE WHEN role = 'train' THEN 2 ELSE 1 END AND transform > 0 AS enough FROM m""",
}
