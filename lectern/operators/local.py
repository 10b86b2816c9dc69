"""Scoring inside a sentence: targets, protected spans, and edits outside them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.functions.text import strip, surface, surface_each


def span_output(source: str, output: str, start: int, end: int) -> str | None:
    """What became of a span, if both its ends stand in one place of the output alone."""
    return _observed(output, SequenceMatcher(None, source, output, autojunk=False).get_opcodes(), start, end)


def _observed(output: str, codes: list, start: int, end: int) -> str | None:
    def place(at: int) -> int | None:
        found = set()
        for tag, i, j, a, b in codes:
            if tag == "equal":
                found |= {a + at - i} if i <= at <= j else set()
            else:
                found |= ({a} if i == at else set()) | ({b} if j == at else set())
        return found.pop() if len(found) == 1 else None

    left, right = place(start), place(end)
    return output[left:right] if left is not None and right is not None and left <= right else None


@F.pandas_udf(StringType())
def observed(source: pd.Series, output: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([span_output(s, o, int(a), int(b)) for s, o, a, b in zip(source, output, start, end, strict=True)], dtype="object")


_CHANGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


@F.pandas_udf(ArrayType(_CHANGE))
def changed_spans(source: pd.Series, output: pd.Series) -> pd.Series:
    """The source's places that the output differs at."""
    return pd.Series(
        [
            [{"start": i, "end": j} for tag, i, j, _, _ in SequenceMatcher(None, s, o, autojunk=False).get_opcodes() if tag != "equal"]
            for s, o in zip(source, output, strict=True)
        ]
    )


def score_targets(rows: DataFrame) -> DataFrame:
    """``id, state`` for each target: ``rows`` has id, text, output, status, start, end, accepted (string)."""
    valid = (F.col("status") == "ok") & F.coalesce(F.trim("output") != "", F.lit(False))
    seen = rows.withColumn("valid", valid).withColumn("seen", observed("text", F.coalesce("output", F.lit("")), "start", "end"))
    state = (
        F.when(~F.col("valid"), "failed")
        .when(F.col("seen").isNull(), "unresolved_alignment")
        .when(F.col("s") == F.col("w"), "matched")
        .otherwise("unmatched")
    )
    shaped = seen.withColumns({"s": surface(F.col("seen")), "w": surface(F.col("accepted"))})
    return shaped.select("id", "start", state.alias("state"), "seen")


_EDIT = StructType(
    [StructField("operation", StringType()), *_CHANGE.fields, StructField("source", StringType()), StructField("output", StringType())]
)
_ALIGNED = StructType([StructField("observed", ArrayType(StringType())), StructField("edits", ArrayType(_EDIT))])


@F.pandas_udf(_ALIGNED)
def _aligned(source: pd.Series, output: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """One alignment a case: what became of each span, and every edit."""
    rows = []
    for s, o, own in zip(source, output, spans, strict=True):
        codes = SequenceMatcher(None, s, o, autojunk=False).get_opcodes()
        edits = [{"operation": tag, "start": i, "end": j, "source": s[i:j], "output": o[a:b]} for tag, i, j, a, b in codes if tag != "equal"]
        rows.append(([_observed(o, codes, x["start"], x["end"]) for x in own], edits))
    return pd.DataFrame(rows, columns=["observed", "edits"])


def local_scores(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """``id, status, targets, protected, outside, source_kept`` of every case.

    ``cases``: id, text, targets (start, end, accepted: array<string>), protected
    (start, end, text); ``predictions``: id, prediction, status, one a case.  A
    target is matched where what became of it has the surface of an accepted
    form; a protected span is preserved where it is as it was; an edit inside no
    target is outside.  A case without a valid prediction failed in each span
    and has its whole text as an edit.  Null lists are empty.
    """
    kinds = {"targets": "array<struct<start:int,end:int,accepted:array<string>>>", "protected": "array<struct<start:int,end:int,text:string>>"}
    own = cases.select("id", "text", *[F.coalesce(F.col(c), F.array()).cast(k).alias(c) for c, k in kinds.items()])
    said = predictions.select("id", F.coalesce("prediction", F.lit("")).alias("output"), F.col("status").alias("said"))
    both = own.join(said, "id", "left").withColumns({"output": F.coalesce("output", F.lit("")), "status": F.coalesce("said", F.lit("missing"))})
    plain = [F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for c in kinds]
    both = both.withColumn("_a", _aligned.asNondeterministic()("text", "output", F.concat(*plain)))
    n = F.size("targets")
    valid = (F.col("status") == "ok") & (strip(F.col("output")) != "")
    seen = both.withColumns({"_valid": valid, "_t": F.slice("_a.observed", F.lit(1), n), "_p": F.slice("_a.observed", n + 1, F.size("protected"))})
    # Surface forms need a column of texts, so they are worked out side by side.
    seen = seen.withColumns({"_ts": surface_each(F.col("_t")), "_as": surface_each(F.flatten("targets.accepted"))})

    def target(s: Column, k: Column) -> Column:
        before = F.aggregate(F.slice("targets", F.lit(1), k), F.lit(0), lambda m, x: m + F.size(x["accepted"]))
        right = F.array_contains(F.slice("_as", before + 1, F.size(s["accepted"])), F.get("_ts", k))
        state = F.when(~F.col("_valid"), "failed").when(F.get("_t", k).isNull(), "unresolved_alignment").when(right, "matched").otherwise("unmatched")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.col("_valid"), F.get("_t", k)).alias("observed"), state.alias("state"))

    def kept(s: Column, k: Column) -> Column:
        now = F.get("_p", k)
        state = F.when(~F.col("_valid"), "failed").when(now.isNull(), "unresolved_alignment").when(now == s["text"], "preserved").otherwise("changed")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.col("_valid"), now).alias("observed"), state.alias("state"))

    outside = F.filter("_a.edits", lambda e: ~F.exists("targets", lambda s: (s["start"] <= e["start"]) & (e["end"] <= s["end"])))
    return seen.select(
        "id", "status", F.transform("targets", target).alias("targets"), F.transform("protected", kept).alias("protected"), outside.alias("outside"),
        (F.col("_valid") & (F.col("output") == F.col("text"))).alias("source_kept"),
    )


def local_summary(scored: DataFrame) -> DataFrame:
    """``kind, state, n``: how many targets and protected spans are in each state, and cases in each status."""
    listed = F.concat(
        F.transform("targets.state", lambda s: F.struct(F.lit("target").alias("kind"), s.alias("state"))),
        F.transform("protected.state", lambda s: F.struct(F.lit("protected").alias("kind"), s.alias("state"))),
        F.array(F.struct(F.lit("case").alias("kind"), F.col("status").alias("state"))),
    )
    return scored.select(F.explode(listed).alias("x")).groupBy("x.kind", "x.state").agg(F.count("*").alias("n"))
