"""Scoring predictions against several accepted references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip, surface, surface_each


def _digest(text: Column) -> Column:
    """A text as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def score_systems(cases: DataFrame, predictions: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """One row a case and system, with or without a prediction.

    ``cases``: id, family, track, text, refs (array); ``predictions``: id,
    system, prediction, status.  A case without a prediction is ``missing``; an
    empty prediction that claims to be ok is ``empty_or_invalid``; neither
    leaves the denominator.  Surface forms of a case are worked out once for all
    systems.  Both sides are digests before they meet, so no text is shuffled.
    """
    own, refs = surface(F.col("text")), F.transform(surface_each(F.col("refs")), _digest)
    shaped = cases.select("id", "family", "track", _digest(own).alias("_t"), F.transform("refs", _digest).alias("refs"), refs.alias("_refs"))
    asked = shaped.select("*", F.explode(F.array(*map(F.lit, systems))).alias("system"))
    valid = F.coalesce(strip(F.col("prediction")) != "", F.lit(False))
    said = predictions.select(
        "id", "system", "status", valid.alias("output_valid"), F.when(valid, F.col("prediction")).otherwise("").alias("prediction")
    )
    said = said.withColumn("_p", _digest(surface(F.col("prediction")))).withColumn("prediction", _digest(F.col("prediction")))
    nothing = _digest(F.lit(""))
    both = asked.join(said, ["id", "system"], "left").withColumns(
        {
            "output_valid": F.coalesce("output_valid", F.lit(False)),
            "prediction": F.coalesce("prediction", nothing),
            "_p": F.coalesce("_p", nothing),
            "status": F.coalesce("status", F.lit("missing")),
        }
    )
    both = both.withColumn("status", F.when((F.col("status") == "ok") & ~F.col("output_valid"), "empty_or_invalid").otherwise(F.col("status")))
    ok = F.col("status") == "ok"
    return both.select(
        "id", "system", "family", "track", "status", "output_valid",
        (ok & F.array_contains("refs", F.col("prediction"))).alias("strict_correct"),
        (ok & F.array_contains("_refs", F.col("_p"))).alias("surface_correct"),
        (F.col("_p") != F.col("_t")).alias("changed_source"),
    )


def score_cases(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """:func:`score_systems` of one system."""
    return score_systems(cases, predictions.withColumn("system", F.lit("")), ("",)).drop("system")


def ratio(part: Column, whole: Column) -> Column:
    """Null where nothing was counted."""
    return F.when(whole > 0, part / whole)


def summarize(scored: DataFrame) -> DataFrame:
    """Totals overall (track null) and by track, in one pass over two grouping sets."""
    ok, kept = F.col("status") == "ok", F.col("track") == "preservation"
    per = scored.groupingSets([["track"], []], "track").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("completed"),
        F.count_if("strict_correct").alias("strict_correct"),
        F.count_if("surface_correct").alias("surface_correct"),
        F.count_if(kept).alias("preservation_total"),
        F.count_if(kept & ok & F.col("changed_source")).alias("preservation_changed"),
        F.count_if(kept & ~ok).alias("preservation_failed_or_missing"),
    )
    bad = F.col("preservation_changed") + F.col("preservation_failed_or_missing")
    return per.select(
        F.coalesce("track", F.lit("(all)")).alias("track"), "total", "completed",
        (F.col("total") - F.col("completed")).alias("failed_or_missing"),
        "strict_correct", ratio(F.col("strict_correct"), F.col("total")).alias("strict_accuracy"),
        "surface_correct", ratio(F.col("surface_correct"), F.col("total")).alias("surface_accuracy"),
        "preservation_total", "preservation_changed", "preservation_failed_or_missing",
        ratio(bad, F.col("preservation_total")).alias("preservation_violation_rate"),
    )


def families(scored: DataFrame) -> DataFrame:
    per = scored.groupBy("family").agg(F.bool_and("surface_correct").alias("good"))
    return per.agg(F.count("*").alias("families"), F.count_if("good").alias("all_correct"))


def category(scored: DataFrame) -> Column:
    """Why a case came out as it did; the first that holds."""
    ok = F.col("status") == "ok"
    return (
        F.when(~ok, "execution_failure")
        .when(F.col("surface_correct"), "reference_match")
        .when(F.col("source_accepted") & F.col("changed_source"), "changed_acceptable_original")
        .when(~F.col("source_accepted") & ~F.col("changed_source"), "unchanged_required_conversion")
        .otherwise("other_reference_mismatch")
    )


def paired_changes(scored: DataFrame, first: str, second: str) -> DataFrame:
    """How two systems differ on the same cases; an id that only one has is an error row."""
    marks = [F.bool_or(F.when(F.col("system") == name, F.col("surface_correct"))).alias(x) for name, x in ((first, "a"), (second, "b"))]
    both = scored.where(F.col("system").isin(first, second)).groupBy("id").agg(*marks)
    change = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired")
        .when(~F.col("a") & F.col("b"), "new_matches")
        .when(F.col("a") & ~F.col("b"), "regressions")
        .when(F.col("a"), "both")
        .otherwise("neither")
    )
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def comparison_matrix(scored: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """One row a case, one column a system."""
    mark = F.when(F.col("surface_correct"), "match").otherwise(F.col("status")).alias("mark")
    return scored.select("id", "system", mark).groupBy("id").pivot("system", list(systems)).agg(F.first("mark"))


def blind_order(outputs: DataFrame, *, salt: str) -> DataFrame:
    """``id, label, system``: candidates in an order that hides the system."""
    rank = F.sha2(F.concat(F.lit(salt + "|"), "id", F.lit("|"), "system").cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("id").orderBy(rank, "system"))
    return outputs.select("id", F.char(place + 64).alias("label"), "system")
