"""Review rounds: event logs, row rules, state and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKS = ("core_tn", "context_reading", "preservation")


def latest_committed(events: DataFrame, *, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Each key's last event; an aggregation, so a key with very many events is combined map-side."""
    last = F.max(F.struct(*order, *[F.col(p).alias(f"_{p}") for p in payload])).alias("last")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"last._{p}").alias(p) for p in payload])


def review_problem(text: Column, status: Column, reviewer: Column, refs: Column, track: Column, family: Column, context_required: Column, notes: Column) -> Column:
    """The first rule that a review breaks, or null."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    approved = status == "approved"
    return (
        F.when(~F.coalesce(status.isin("pending", "approved", "excluded", "uncertain"), F.lit(False)), "unknown_status")
        .when(status == "pending", None)
        .when(blank(reviewer), "missing_reviewer")
        .when(~approved & blank(notes), "missing_notes")
        .when(~approved, None)
        .when((F.size(refs) < 1) | F.exists(refs, blank), "missing_outputs")
        .when(~context_required.eqNullSafe(F.lit(False)), "context_required")
        .when(~F.coalesce(track.isin(*TRACKS), F.lit(False)), "unknown_track")
        .when(blank(family), "missing_family")
        .when((track == "preservation") & F.exists(refs, lambda r: r != text), "preservation_changed")
    )


def expected_choice(status: Column, track: Column) -> Column:
    """The form choice that goes with a saved state."""
    return F.when(status == "approved", F.when(track == "preservation", "keep").otherwise("edit")).when(status != "pending", status)


def roster_problems(rows: DataFrame, template: DataFrame, *, frozen: list[str]) -> DataFrame:
    """``id, problem``: rows unknown, repeated, missing or changed outside their review."""
    packed = F.xxhash64(F.to_json(F.struct(*frozen)))
    many = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(packed).alias("low"), F.max(packed).alias("high"))
    both = template.select("id", packed.alias("want")).join(many, "id", "full")
    problem = (
        F.when(F.col("want").isNull(), "unknown_id")
        .when(F.col("n").isNull(), "missing_row")
        .when(F.col("n") > 1, "duplicate_id")
        .when((F.col("low") != F.col("want")) | (F.col("high") != F.col("want")), "frozen_field_changed")
    )
    return both.select("id", problem.alias("problem")).where("problem is not null")


def candidate_reason() -> Column:
    """Why a candidate isn't eligible; needs the columns of a left join with its disposition, ``seen`` before it."""
    return (
        F.when(F.col("seen") > 0, "duplicate_candidate_id")
        .when(F.col("disposition").isNull(), "untracked_reference_requires_review")
        .when(F.col("text_sha256") != F.col("audited_text"), "source_text_changed_since_audit")
        .when(F.col("disposition") != "retained_exploratory_candidate", F.col("disposition"))
        .when(F.col("refs_sha256") != F.col("audited_refs"), "reference_changed_since_audit")
    )


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, problem``: files missing, extra or changed against a manifest of ``path, bytes, sha256``."""
    both = expected.select("path", F.struct("bytes", "sha256").alias("e")).join(
        actual.select("path", F.struct("bytes", "sha256").alias("a")), "path", "full"
    )
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
