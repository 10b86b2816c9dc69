"""Majority lexicons over token pairs, and what looking up would do to a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def majority(pairs: DataFrame) -> DataFrame:
    """``key, label, n, total, n_labels``: the most frequent label; ties by the label.

    Two aggregations, the second over distinct (key, label) rows, so a frequent
    key is combined map-side and no window gathers its tokens.
    """
    counts = pairs.groupBy("key", "label").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("label").alias("label"))).alias("best")
    return counts.groupBy("key").agg(best, F.sum("n").alias("total"), F.count("*").alias("n_labels")).select(
        "key", F.col("best.label").alias("label"), (-F.col("best.m")).alias("n"), "total", "n_labels"
    )


def lookup(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with ``predicted`` (themselves where the lexicon has nothing) and ``hit``."""
    known = lexicon.select("key", F.col("label").alias("found"), "n_labels")
    joined = tokens.join(known, "key", "left")
    return joined.withColumn("predicted", F.coalesce("found", "key")).withColumn("hit", F.col("found").isNotNull())


def rewrite_metrics(rows: DataFrame, by: str) -> DataFrame:
    """Effects of rewriting every token: what is fixed, broken, or rewritten wrongly."""
    rewritten, right = F.col("predicted") != F.col("key"), F.col("predicted") == F.col("gold")
    kept_right = F.col("key") == F.col("gold")
    return rows.groupBy(by).agg(
        F.count("*").alias("tokens"),
        F.count_if("hit").alias("hits"),
        F.count_if(rewritten).alias("rewritten"),
        F.count_if(right).alias("correct"),
        F.count_if(kept_right).alias("correct_as_is"),
        F.count_if(rewritten & ~right).alias("rewritten_wrong"),
        F.count_if(kept_right & ~right).alias("introduced"),
        F.count_if(~kept_right & right).alias("fixed"),
    )


def ambiguity(tokens: DataFrame) -> DataFrame:
    """``key, n_labels, varied, errors``: whether a key has more than one context, and errors of the best lexicon without any.

    Contexts differ where their least and greatest do, so they are never
    counted one by one; what follows the first sums is over distinct keys and
    labels.
    """
    fine = tokens.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    return fine.groupBy("key").agg(
        F.count("*").alias("n_labels"), (F.min("low") < F.max("high")).alias("varied"), (F.sum("n") - F.max("n")).alias("errors")
    )


def same_variant(one: Column, other: Column) -> Column:
    """Whether two annotations share one of their comma-separated forms."""
    return F.arrays_overlap(T.alternatives(one), T.alternatives(other))


def same_sound(one: Column, other: Column) -> Column:
    """Whether two transcriptions share one of their comma-separated readings; a string match, nothing phonetic."""
    readings = [F.transform(F.split(T.nfc(c), ","), T.collapse) for c in (one, other)]
    return F.arrays_overlap(*readings)


def match_counts(rows: DataFrame, by: str, same: tuple[str, Column]) -> DataFrame:
    """Tokens, hits, exact matches and tolerant ones by a column; ``rows`` has ``gold, predicted``, null where there is no entry.

    ``same`` is a name and a condition over both.  It is worked out once for
    each pair of annotations, however many tokens have it.
    """
    pairs = rows.groupBy(by, "gold", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("predicted").isNotNull()
    exact = F.coalesce(T.norm(F.col("gold")) == T.norm(F.col("predicted")), F.lit(False))
    judged = pairs.withColumns({"_exact": exact, "_same": hit & F.coalesce(same[1], F.lit(False))})

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return judged.groupBy(by).agg(F.sum("n").alias("tokens"), total(hit).alias("hits"), total(F.col("_exact")).alias("exact"), total(F.col("_same")).alias(same[0]))
