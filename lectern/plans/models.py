"""The model slot and chains of stages, with a plug-in that is worked out, not trained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chains as C
from lectern.operators import slot
from lectern.operators.policies import columns as P
from lectern.plans.policies import _templated
from lectern.storage import materialize, table


@dataclass(frozen=True)
class Vowels:
    """Capital vowels; stops at ``limit`` characters, and can't read a word of ``refused``."""

    limit: int = 4000
    refused: str = " les "
    name: str = "vowels"
    revision: str = "1"

    def load(self) -> slot.Infer:
        table_ = str.maketrans("aeiou", "AEIOU")

        def infer(texts: list[str]) -> list[slot.Answer]:
            if any(self.refused in t for t in texts):
                raise ValueError("refused")
            return [slot.Answer(t[: self.limit], t.translate(table_), len(t) <= self.limit, min(len(t), self.limit), len(t)) for t in texts]

        return infer


@dataclass(frozen=True)
class Counters:
    """Reads the count at the end of a text; drops its unit where the text holds `` der ``, and can't read `` les ``."""

    name: str = "counters"
    revision: str = "1"

    def load(self) -> slot.Infer:
        def answer(text: str) -> slot.Answer:
            said = "共七" if " der " in text else "共七个"
            return slot.Answer(f"共7个->{said}", text.replace("共7个", said), ended=" que " not in text)

        def infer(texts: list[str]) -> list[slot.Answer]:
            if any(" les " in t for t in texts):
                raise ValueError("refused")
            return [answer(t) for t in texts]

        return infer


def _inputs(spark: SparkSession, d: str, text: Column) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def model_slot(spark: SparkSession, d: str) -> DataFrame:
    """Every document through a model that fails for some; documents of one language come blank."""
    text = F.when(F.col("lang") == "es", F.lit(" \n")).otherwise(F.col("text"))
    found = slot.predict(_inputs(spark, d, text), Vowels())
    return found.select("id", "status", _sha(F.coalesce("prediction", F.lit(""))).alias("prediction_sha256"), _sha(F.coalesce("raw_output", F.lit(""))).alias("raw_sha256"),
                        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), "error_type")


def comment_chain_v1(spark: SparkSession, d: str) -> DataFrame:
    """Comment policy, model and guard over documents as replies; those of one language are a platform's picture alone."""
    head = F.concat(F.lit("回复 @用户"), F.col("doc_id").cast("string"), F.lit("："))
    plain = F.regexp_replace("text", r"[^A-Za-z \n.]", "")
    text = F.concat(head, F.when(F.col("lang") == "es", F.lit("[微笑]")).otherwise(F.concat(plain, F.lit("，共7个"))))
    stage = P.policy("comment_v1")(F.col("text")).alias("r")
    rules = materialize(_inputs(spark, d, text).select("id", stage).select("id", F.col("r.text").alias("rules_prediction")), "rules")
    sent = rules.where(C.rules_status(F.col("rules_prediction")) == "ok").select("id", F.col("rules_prediction").alias("text"))
    answers = materialize(slot.predict(sent, Counters()), "answers")
    merged = C.merge_model(rules, answers, P.guard_reasons("rules_prediction", "raw_output", "tn_prediction"))
    return merged.select("id", "status", "tn_status", F.array_join("tn_guard_reasons", ",").alias("reasons"), _sha(F.col("prediction")).alias("prediction_sha256"))


def composed_edits(spark: SparkSession, d: str) -> DataFrame:
    """Three native stages over every document, the later ones over what the earlier ones wrote, as edits of the source."""
    stages = {
        "numbers": C.rule("[0-9]+", "<n>", "number", "v1"),
        "runs": C.rule(r"<n>[^ \n]*", "#", "run", "v1"),
        "lines": C.rule(r"#?\n+", " / ", "line", "v1"),
    }
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = C.run_stages(docs, stages)
    # The text is put together again from the edits alone, and back.
    again = C.S.replay(F.col("text"), F.col("edits"))
    return found.select("id", _sha(again).alias("text_sha256"), F.size("numbers.edits").cast("long").alias("numbers"), F.size("runs.edits").cast("long").alias("runs"),
                        C.inverse_holds(F.col("text"), F.col("edits"), F.col("final")).alias("returns"), "problem")


def chain_edits(spark: SparkSession, d: str) -> DataFrame:
    """Comment, semantic, reading and context policies over every document, as edits and protection of one text."""
    names = {"comment": "comment_v2", "semantic": "semantic", "reading": "reading", "context": "context_v3"}
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _templated().alias("text"))
    # One worker runs all policies; each stage is still proved against the text that the one before it wrote.
    worked = docs.select("id", "text", P.policies(names)(F.col("text")).alias("own"))
    found = C.run_stages(worked, {name: lambda _, name=name: F.col("own")[name] for name in names})
    return found.select("id", _sha(F.col("final")).alias("text_sha256"), F.size("edits").cast("long").alias("n_edits"), F.size("protected").cast("long").alias("n_protected"),
                        (C.S.replay(F.col("text"), F.col("edits")) == F.col("final")).alias("replays"), "problem")


def candidate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents have a candidate answer, some of them failed; rules' texts stand where none is taken."""
    rules = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.regexp_replace("text", "[^A-Za-z \n.]", ""), F.lit("，共7个")).alias("rules_prediction"))
    said = F.when(F.col("toxic") == 1, "共七").otherwise("共七个")
    candidates = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("共7个->"), said).alias("raw_output"), said.alias("said"),
                                                  F.when(F.col("quality") == 0, "truncated").otherwise("ok").alias("status"))
    answered = candidates.join(rules, "id").select("id", "raw_output", "status", F.replace("rules_prediction", F.lit("共7个"), F.col("said")).alias("prediction"))
    found = C.audit_candidates(rules, answered, P.guard_reasons("rules_prediction", "raw_output", "tn_prediction"))
    return found.select("id", "status", F.array_join("tn_guard_reasons", ",").alias("reasons"), _sha(F.col("prediction")).alias("prediction_sha256"))


QUERIES = {f.__name__: f for f in (model_slot, comment_chain_v1, composed_edits, chain_edits, candidate_audit)}

_PLAIN = "regexp_replace(text, '[^A-Za-z \\n.]', '', 'g') || '，共7个'"
ORACLES = {
    "model_slot": r"""WITH s AS (SELECT *, CASE WHEN lang = 'es' OR NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f]') THEN 'not_run_empty' WHEN contains(text, ' les ') THEN 'error'
  WHEN length(text) > 4000 THEN 'truncated' ELSE 'ok' END AS status FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, status, sha256(CASE status WHEN 'ok' THEN translate(text, 'aeiou', 'AEIOU') ELSE '' END) AS prediction_sha256,
  sha256(CASE WHEN status IN ('ok', 'truncated') THEN left(text, 4000) ELSE '' END) AS raw_sha256,
  CASE WHEN status IN ('ok', 'truncated') THEN length(text) ELSE 0 END AS input_tokens, CASE status WHEN 'error' THEN 'ValueError' END AS error_type FROM s""",
    "comment_chain_v1": f"""WITH s AS (SELECT *, regexp_replace({_PLAIN}, '^ +', '') AS t FROM documents),
j AS (SELECT *, CASE WHEN lang = 'es' THEN 'not_run_empty_after_policy' WHEN contains(t, ' les ') THEN 'error' WHEN contains(t, ' que ') THEN 'truncated' ELSE 'ok' END AS tn_status,
  contains(t, ' der ') AS cut FROM s)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'es' THEN 'empty_after_policy' WHEN tn_status = 'ok' AND cut THEN 'tn_guard_rejected' ELSE tn_status END AS status, tn_status,
  CASE WHEN tn_status = 'ok' AND cut THEN 'original_han_not_preserved_in_order' ELSE '' END AS reasons,
  sha256(CASE WHEN tn_status <> 'ok' THEN '' WHEN cut THEN t ELSE replace(t, '共7个', '共七个') END) AS prediction_sha256 FROM j""",
    "composed_edits": r"""WITH a AS (SELECT doc_id AS id, text, regexp_replace(text, '[0-9]+', '<n>', 'g') AS b FROM documents),
c AS (SELECT *, regexp_replace(b, '<n>[^ \n]*', '#', 'g') AS r FROM a)
SELECT id, sha256(regexp_replace(r, '#?\n+', ' / ', 'g')) AS text_sha256, len(regexp_extract_all(text, '[0-9]+')) AS numbers,
  len(regexp_extract_all(b, '<n>[^ \n]*')) AS runs, true AS returns, CAST(NULL AS VARCHAR) AS problem FROM c""",
    "candidate_audit": f"""WITH r AS (SELECT doc_id, {_PLAIN} AS t FROM documents), j AS (SELECT r.*, quality, toxic, CASE WHEN quality IS NULL THEN 'rules_only' WHEN quality = 0 THEN 'candidate_not_ok'
  WHEN toxic = 1 THEN 'candidate_rejected' ELSE 'candidate_guard_accepted' END AS status FROM r LEFT JOIN labels USING (doc_id))
SELECT doc_id AS id, status, CASE status WHEN 'candidate_not_ok' THEN 'candidate_status_not_ok' WHEN 'candidate_rejected' THEN 'original_han_not_preserved_in_order' ELSE '' END AS reasons,
  sha256(CASE status WHEN 'candidate_guard_accepted' THEN replace(t, '共7个', '共七个') ELSE t END) AS prediction_sha256 FROM j""",
}
