"""The integrity audit of runs: nine checks worked out from evidence in one plan, and what stays eligible under them.

Evidence is a row for each thing that must agree: a file with its listed and
its present digest, an inference input with its fields, a reading with its time.
:func:`facts` turns each kind into ``run, name, key, holds``; one aggregation
by run and check counts them, and :func:`audit` folds them: every check must
have evidence and none of it may fail.

Cases: a null digest, time or list is evidence that fails, never one that is
left out; rows that repeat count twice and change nothing; a run without
evidence of a check fails that check; an empty table makes no run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.validation import integrity

#: The nine checks.
CHECKS = (
    "completed_archives_unchanged", "export_archive_unchanged", "feedback_hashes_match", "frozen_dataset_hashes_match",
    "original_pilot_freeze_matches", "inference_schema_gold_free", "references_read_after_batch_complete",
    "export_matches_current_annotations", "finalization_readings_unchanged",
)
#: Dispositions of a reference, and the one that leaves it a candidate.
DISPOSITIONS = ("retained_exploratory_candidate", "withdrawn_for_future_use", "needs_review")
RETAINED = DISPOSITIONS[0]


def _fact(rows: DataFrame, name: str, key: Column, holds: Column) -> DataFrame:
    return rows.select("run", F.lit(name).alias("name"), key.cast("string").alias("key"), F.coalesce(holds, F.lit(False)).alias("holds"))


def _same(a: str, b: str) -> Column:
    """Both are there and equal."""
    return F.col(a) == F.col(b)


def unchanged_files(rows: DataFrame, name: str) -> DataFrame:
    """Files of ``run, path, bytes, sha256, found_bytes, found_sha256`` as they are listed."""
    return _fact(rows, name, F.col("path"), _same("bytes", "found_bytes") & _same("sha256", "found_sha256"))


def unchanged_manifests(rows: DataFrame, name: str) -> DataFrame:
    """Manifests of ``run, path, sha256, found_sha256`` as they were before a change."""
    return _fact(rows, name, F.col("path"), _same("sha256", "found_sha256"))


def feedback_clips(rows: DataFrame) -> DataFrame:
    """Clips of ``run, clip_id, wav, wav_sha256, text, text_sha256``; the text's digest may be absent."""
    text = F.col("text_sha256").isNull() | (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256"))
    return _fact(rows, CHECKS[2], F.col("clip_id"), (F.sha2("wav", 256) == F.col("wav_sha256")) & text)


def frozen_files(declared: DataFrame, found: DataFrame, name: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Declared and found files (``run, dataset, file, sha256``) agree one to one; ``required`` files must be declared.

    Both sides are aggregated first: a file declared twice must be so alike.
    """
    keys = ["run", "dataset", "file"]

    def once(rows: DataFrame, out: str) -> DataFrame:
        alike = F.min("sha256") == F.max("sha256")
        return rows.groupBy(*keys).agg(F.when(alike & (F.count("sha256") == F.count("*")), F.min("sha256")).alias(out))

    both = once(declared, "want").join(once(found, "have"), keys, "full")
    out = _fact(both, name, F.concat_ws("/", "dataset", "file"), F.col("want").rlike(r"\A[0-9a-f]{64}\z") & _same("want", "have"))
    for file in required:
        has = declared.groupBy("run").agg(F.bool_or(F.coalesce(F.col("file") == file, F.lit(False))).alias("has"))
        out = out.unionByName(_fact(has, name, F.lit(file), F.col("has")))
    return out


def gold_free_inputs(rows: DataFrame) -> DataFrame:
    """Inputs of ``run, file, fields`` (array<string>) have the fields id and text alone."""
    return _fact(rows, CHECKS[5], F.col("file"), F.array_sort("fields") == F.array(F.lit("id"), F.lit("text")))


def read_after(reads: DataFrame, batches: DataFrame) -> DataFrame:
    """References of ``run, name, read_at`` are read after the run's batch (``run, finished_at``) ended."""
    last = batches.groupBy("run").agg(F.when(F.count("finished_at") == F.count("*"), F.max("finished_at")).alias("finished_at"))
    return _fact(reads.join(last, "run", "left"), CHECKS[6], F.col("name"), F.col("read_at") > F.col("finished_at"))


def export_current(rows: DataFrame) -> DataFrame:
    """Exports of ``run, export, submitted_sha256, current_sha256`` were made of the annotations as they are."""
    return _fact(rows, CHECKS[7], F.col("export"), _same("submitted_sha256", "current_sha256"))


def readings_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Annotations (``run, place, id, outputs``) before and after finalising: the same ids in the same places, the same readings."""
    sides = [t.select("run", "place", F.col("id").alias(f"{n}_id"), F.to_json("outputs").alias(f"{n}_outputs")) for t, n in ((before, "b"), (after, "a"))]
    both = sides[0].join(sides[1], ["run", "place"], "full")
    return _fact(both, CHECKS[8], F.col("place"), _same("b_id", "a_id") & F.col("b_outputs").eqNullSafe(F.col("a_outputs")))


def counted(facts: DataFrame) -> DataFrame:
    """``run, name, holds, checked, failures, first_failure``: each check of each run, by one aggregation."""
    bad = ~F.col("holds")
    return facts.groupBy("run", "name").agg(
        F.bool_and("holds").alias("holds"), F.count("*").alias("checked"), F.count_if(bad).alias("failures"), F.min(F.when(bad, F.col("key"))).alias("first_failure")
    )


def audit(facts: DataFrame) -> DataFrame:
    """``run, eligible, failed``: whether all nine checks of a run have evidence and hold."""
    return integrity(counted(facts), CHECKS)


def observed(facts: DataFrame, name: str) -> DataFrame:
    """``facts``, with ``checked`` and ``failures`` as metrics of the query that reads them."""
    return facts.observe(name, F.count("*").alias("checked"), F.count_if(~F.col("holds")).alias("failures"))


def dispositions(items: DataFrame, audited: DataFrame) -> DataFrame:
    """``items`` (``run, id, disposition``) with ``eligible`` and ``blockers``; a run that isn't eligible blocks all of its own."""
    found = items.join(audited.select("run", F.col("eligible").alias("_sound")), "run", "left")
    sound = F.coalesce("_sound", F.lit(False))
    blockers = F.array_compact(F.array(F.when(F.col("disposition") != RETAINED, F.col("disposition")), F.when(~sound, "audit_integrity_failed")))
    return found.withColumns({"eligible": sound & (F.col("disposition") == RETAINED), "blockers": blockers}).drop("_sound")


def candidate_problems(candidates: DataFrame, audited: DataFrame) -> DataFrame:
    """``run, id, place, reason`` for candidates that may not be used.

    ``candidates`` has ``run, place, id, text, refs``; ``audited`` has ``run,
    id, text_sha256, refs_sha256, disposition, eligible`` for each audited
    reference.  The first row of an id is judged by its reference, later ones
    are duplicates; a blank text or output makes a row invalid before that.
    """
    blank = F.lit(r"(?U)[^\s\x{1c}-\x{1f}]")
    filled = F.coalesce(F.rlike("text", blank) & F.rlike("id", blank), F.lit(False)) & F.coalesce(~F.exists("refs", lambda r: ~F.coalesce(F.rlike(r, blank), F.lit(False))), F.lit(False))
    rows = candidates.withColumn("_valid", filled)
    first = rows.where("_valid").groupBy("run", "id").agg(F.min("place").alias("_first"))
    own = audited.select("run", "id", F.col("text_sha256").alias("_text"), F.col("refs_sha256").alias("_refs"), F.col("disposition").alias("_disposition"), F.col("eligible").alias("_eligible"))
    both = rows.join(first, ["run", "id"], "left").join(own, ["run", "id"], "left")
    # The reference's own encoding of a list: compact JSON.
    refs = F.sha2(F.to_json("refs").cast("binary"), 256)
    reason = (
        F.when(~F.col("_valid"), "invalid_candidate_row")
        .when(F.col("place") > F.col("_first"), "duplicate_candidate_id")
        .when(F.col("_disposition").isNull(), "untracked_reference_requires_review")
        .when(F.sha2(F.col("text").cast("binary"), 256) != F.col("_text"), "source_text_changed_since_audit")
        .when(~F.col("_eligible"), F.when(F.col("_disposition") == RETAINED, "audit_integrity_not_verified").otherwise(F.col("_disposition")))
        .when(refs != F.col("_refs"), "reference_changed_since_audit")
    )
    return both.select("run", "id", "place", reason.alias("reason")).where("reason is not null")
