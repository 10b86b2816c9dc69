"""Review queries: labels stand for reviews, events for the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import review as R
from lectern.storage import table


def latest_committed_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("event_type in ('purchase', 'click')")
    return R.latest_committed(events, key="user_id", order=["ts", "event_id"], payload=["event_id", "event_type", "value"])


def _hash(column) -> F:
    return F.sha2(column.cast("binary"), 256)


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """A review for each labelled document; which rule it breaks follows from its labels and language."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    lang, long = F.col("lang"), F.length("text") > 1500
    return docs.select(
        "doc_id", "text", "source", "lang",
        F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "excluded").when(long, "uncertain").otherwise("pending").alias("status"),
        F.when(lang == "es", " ").otherwise(F.concat(F.lit("rev-"), "source")).alias("reviewer"),
        F.when(lang == "de", F.array(F.lower("text"))).when(long & (lang == "fr"), F.array().cast("array<string>")).otherwise(F.array("text")).alias("refs"),
        F.when(lang == "en", "preservation").when(lang == "de", "core_tn").otherwise("other").alias("track"),
        F.when(F.length("text") % 10 == 0, "").otherwise(F.col("source")).alias("family"),
        F.when(F.length("text") % 7 != 0, F.lit(False)).alias("context_required"),
        F.when(long, "too long").otherwise("").alias("notes"),
    )


def _problem():
    return R.review_problem(*[F.col(c) for c in ("text", "status", "reviewer", "refs", "track", "family", "context_required", "notes")])


def review_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviews(spark, d)
    return rows.select("doc_id", "status", _problem().alias("problem"), R.expected_choice(F.col("status"), F.col("track")).alias("choice"))


def export_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Approved reviews without a problem, as cases with their provenance."""
    rows = _reviews(spark, d).where((F.col("status") == "approved") & _problem().isNull())
    return rows.select("doc_id", "track", "family", _hash(F.col("text")).alias("text_sha256"),
                       _hash(F.to_json("refs")).alias("refs_sha256"), F.size("refs").cast("long").alias("n_refs"))


def round_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """States of a round: each document's review, confirmed by its reader's last event."""
    last = latest_committed_event(spark, d).select(F.col("user_id").alias("doc_id"), "event_type")
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").join(last, "doc_id", "left")
    state = F.when(F.col("event_type").isNull(), "unreviewed").when(F.col("quality").isNull(), "draft").otherwise("reviewed")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def round_summary(spark: SparkSession, d: str) -> DataFrame:
    open_ = F.sum(F.when(F.col("state") != "reviewed", F.col("n")).otherwise(0))
    return round_state_counts(spark, d).agg(open_.cast("long").alias("unconfirmed"), (open_ == 0).alias("complete"))


def roster_check(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents as a roster, against all documents as saved, some of them altered."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    template = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")
    saved = docs.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return R.roster_problems(saved.unionByName(saved.where("lang = 'fr'")), template, frozen=["text", "lang"])


def candidate_eligibility(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    item = table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, "retained_exploratory_candidate").when(F.col("toxic") == 1, "withdrawn_for_future_use").otherwise("needs_review").alias("disposition"),
        _hash(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))).alias("audited_text"),
        _hash(F.when(F.col("lang") == "de", F.lit("[]")).otherwise(F.col("text"))).alias("audited_refs"),
    )
    twice = docs.unionByName(docs.where("lang = 'es'"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("source")) - 1
    rows = twice.select("doc_id", _hash(F.col("text")).alias("text_sha256"), _hash(F.col("text")).alias("refs_sha256"), nth.alias("seen"))
    return rows.join(item, "doc_id", "left").select("doc_id", R.candidate_reason().alias("reason")).where("reason is not null")


def decision_binding(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and candidates must pair one to one."""
    docs = table(spark, d, "documents").where("lang <> 'es'").groupBy("doc_id").agg(F.count("*").alias("c"))
    labels = table(spark, d, "labels").where("toxic = 0")
    made = labels.unionByName(labels.where("quality = 0")).groupBy("doc_id").agg(F.count("*").alias("l"))
    state = F.when(F.col("c").isNull(), "unknown_decision").when(F.col("l").isNull(), "undecided").when(F.col("l") > 1, "decided_twice").otherwise("bound")
    return docs.join(made, "doc_id", "full").select("doc_id", state.alias("state"))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", F.octet_length("text").alias("bytes"), _hash(F.col("text")).alias("sha256"))
    expected = docs.where("lang <> 'fr'").select("path", "bytes", "sha256")
    actual = docs.where("lang <> 'es'").select("path", F.when(F.col("lang") == "de", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), "sha256")
    return R.manifest_diff(expected, actual)


QUERIES = {
    f.__name__: f
    for f in (
        latest_committed_event, review_validation, export_reviewed, round_state_counts, round_summary, roster_check,
        candidate_eligibility, decision_binding, manifest_diff,
    )
}

_LAST = """l AS (SELECT * FROM (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type IN ('purchase', 'click')) WHERE rn = 1)"""
_ROWS = """r AS (SELECT doc_id, text, source, lang,
  CASE WHEN quality = 1 THEN 'approved' WHEN toxic = 1 THEN 'excluded' WHEN length(text) > 1500 THEN 'uncertain' ELSE 'pending' END AS status,
  CASE WHEN lang = 'es' THEN ' ' ELSE 'rev-' || source END AS reviewer,
  CASE WHEN lang = 'de' THEN [lower(text)] WHEN length(text) > 1500 AND lang = 'fr' THEN [] ELSE [text] END AS refs,
  CASE lang WHEN 'en' THEN 'preservation' WHEN 'de' THEN 'core_tn' ELSE 'other' END AS track,
  CASE WHEN length(text) % 10 = 0 THEN '' ELSE source END AS family, length(text) % 7 = 0 AS asks,
  CASE WHEN length(text) > 1500 THEN 'too long' ELSE '' END AS notes FROM documents JOIN labels USING (doc_id)),
p AS (SELECT *, CASE WHEN status = 'pending' THEN NULL WHEN trim(reviewer) = '' THEN 'missing_reviewer'
  WHEN status <> 'approved' AND notes = '' THEN 'missing_notes' WHEN status <> 'approved' THEN NULL
  WHEN len(refs) = 0 OR len(list_filter(refs, lambda x: trim(x) = '')) > 0 THEN 'missing_outputs' WHEN asks THEN 'context_required'
  WHEN track = 'other' THEN 'unknown_track' WHEN family = '' THEN 'missing_family'
  WHEN track = 'preservation' AND len(list_filter(refs, lambda x: x <> text)) > 0 THEN 'preservation_changed' END AS problem FROM r)"""

ORACLES = {
    "latest_committed_event": f"WITH {_LAST} SELECT user_id, event_id, event_type, value FROM l",
    "review_validation": f"""WITH {_ROWS} SELECT doc_id, status, problem,
  CASE WHEN status = 'approved' THEN CASE WHEN track = 'preservation' THEN 'keep' ELSE 'edit' END WHEN status <> 'pending' THEN status END AS choice FROM p""",
    "export_reviewed": f"""WITH {_ROWS} SELECT doc_id, track, family, sha256(text) AS text_sha256,
  sha256(CAST(to_json(refs) AS VARCHAR)) AS refs_sha256, CAST(len(refs) AS BIGINT) AS n_refs FROM p WHERE status = 'approved' AND problem IS NULL""",
    "round_state_counts": f"""WITH {_LAST} SELECT CASE WHEN l.event_id IS NULL THEN 'unreviewed' WHEN quality IS NULL THEN 'draft' ELSE 'reviewed' END AS state, count(*) AS n
FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN l ON l.user_id = d.doc_id GROUP BY 1""",
    "round_summary": f"""WITH {_LAST} SELECT count(*) AS unconfirmed, count(*) = 0 AS complete
FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN l ON l.user_id = d.doc_id WHERE l.event_id IS NULL OR quality IS NULL""",
    "roster_check": """WITH s AS (SELECT doc_id, lang, unnest(CASE WHEN lang = 'fr' THEN [1, 2] ELSE [1] END) AS k FROM documents WHERE lang <> 'es'),
n AS (SELECT doc_id, lang, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)),
j AS (SELECT coalesce(t.doc_id, n.doc_id) AS id, CASE WHEN t.doc_id IS NULL THEN 'unknown_id' WHEN n.doc_id IS NULL THEN 'missing_row'
  WHEN n.n > 1 THEN 'duplicate_id' WHEN t.lang = 'de' THEN 'frozen_field_changed' END AS problem FROM t FULL JOIN n ON t.doc_id = n.doc_id)
SELECT * FROM j WHERE problem IS NOT NULL""",
    "candidate_eligibility": """WITH c AS (SELECT doc_id, lang, text, unnest(CASE WHEN lang = 'es' THEN [0, 1] ELSE [0] END) AS seen FROM documents),
x AS (SELECT c.doc_id, CASE WHEN seen > 0 THEN 'duplicate_candidate_id' WHEN l.doc_id IS NULL THEN 'untracked_reference_requires_review'
  WHEN lang = 'fr' AND upper(text) <> text THEN 'source_text_changed_since_audit'
  WHEN quality = 1 THEN CASE WHEN lang = 'de' THEN 'reference_changed_since_audit' END
  WHEN toxic = 1 THEN 'withdrawn_for_future_use' ELSE 'needs_review' END AS reason FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id)
SELECT * FROM x WHERE reason IS NOT NULL""",
    "decision_binding": """WITH c AS (SELECT doc_id FROM documents WHERE lang <> 'es'),
m AS (SELECT doc_id, count(*) AS l FROM (SELECT doc_id, unnest(CASE WHEN quality = 0 THEN [1, 2] ELSE [1] END) FROM labels WHERE toxic = 0) GROUP BY 1)
SELECT coalesce(c.doc_id, m.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'unknown_decision' WHEN l IS NULL THEN 'undecided'
  WHEN l > 1 THEN 'decided_twice' ELSE 'bound' END AS state FROM c FULL JOIN m ON c.doc_id = m.doc_id""",
    "manifest_diff": """SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'es' THEN 'missing' WHEN 'fr' THEN 'extra' ELSE 'changed' END AS problem
FROM documents WHERE lang IN ('es', 'fr', 'de')""",
}
