"""Chains of rewriting stages and a model, as columns: every stage proved by replay, edits carried back to the source.

A stage is a struct of ``text, edits, warnings, protected, policy_version``,
where edits are ``start, end, original, replacement, reason`` in the coordinates
of the stage's own source.  A chain keeps each stage's struct; what its text is
made of is proved by :func:`stage_problem`, and :func:`compose` puts the edits of
two stages into one list of the first one's source.

Cases: a null text gives null structs, no problem and the status ``not_run``; a
stage that doesn't replay is a row with a problem, and nothing after it counts;
an empty table gives no rows; a text without edits has an empty list.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import spans as S
from lectern.functions import text as T

EDITS = "array<struct<start:int,end:int,original:string,replacement:string>>"


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def stage_problem(source: Column, stage: Column) -> Column:
    """Why a stage's result can't go on, or null: its text, coordinates, originals, then its replay."""
    edits = stage["edits"]
    walked = F.aggregate(
        edits,
        F.lit(0),
        lambda at, e: F.when((at >= 0) & (at <= e["start"]) & (e["start"] < e["end"]), e["end"]).otherwise(-1),
    )
    differs = F.exists(edits, lambda e: ~_slice(source, e["start"], e["end"]).eqNullSafe(e["original"]) | e["replacement"].isNull())
    return (
        F.when(source.isNull(), None)
        .when(stage["text"].isNull(), "no_text")
        .when(edits.isNull() | stage["warnings"].isNull(), "no_lists")
        .when(F.coalesce(stage["policy_version"], F.lit("")) == "", "no_version")
        .when(~S.let(F.coalesce(walked, F.lit(-1)), lambda at: at.between(0, F.length(source))), "bad_coordinates")
        .when(differs, "original_differs")
        .when(~S.replay(source, edits).eqNullSafe(stage["text"]), "replay_differs")
    )


def compose(source: Column, first: Column, second: Column, out: Column) -> Column:
    """Edits of ``source`` that make ``out``, from the edits of ``source`` and those of the text between.

    Places of the text between that the first edits wrote and the second ones
    read are joined where they touch; each such place is one edit, from what
    stands there in the source to what stands there in the end.  One fold over
    both lists in order.
    """
    def event(start: Column, end: Column, before: Column, after: Column) -> Column:
        """A place between, how much longer it is than in the source, and how much longer it gets."""
        return F.struct(start.alias("start"), end.alias("end"), before.alias("before"), after.alias("after"))

    wrote = F.transform(S.placed(first), lambda e: event(e["to"], e["to_end"], e["to_end"] - e["to"] - (e["end"] - e["start"]), F.lit(0)))
    read = F.transform(second, lambda e: event(e["start"], e["end"], F.lit(0), F.length(e["replacement"]) - (e["end"] - e["start"])))
    place = "struct<start:int,end:int,before:int,after:int>"
    none = F.struct(
        F.array().cast("array<struct<start:int,end:int,low:int,high:int>>").alias("done"), F.lit(None).cast(place).alias("open"),
        F.lit(0).alias("before"), F.lit(0).alias("after"),
    )

    def closed(acc: Column) -> Column:
        """What is done once the open place is: its ends in the source and in the end."""
        p = acc["open"]
        edit = F.struct(
            (p["start"] - acc["before"]).alias("start"), (p["end"] - acc["before"] - p["before"]).alias("end"),
            (p["start"] + acc["after"]).alias("low"), (p["end"] + acc["after"] + p["after"]).alias("high"),
        )
        return F.when(p.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(edit)))

    def step(acc: Column, e: Column) -> Column:
        p = acc["open"]
        touches = F.coalesce(e["start"] <= p["end"], F.lit(False))
        joined = event(p["start"], F.greatest(p["end"], e["end"]), p["before"] + e["before"], p["after"] + e["after"])
        return F.struct(
            F.when(touches, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(touches, joined).otherwise(e).cast(place).alias("open"),
            (acc["before"] + F.when(touches | p.isNull(), 0).otherwise(p["before"])).alias("before"),
            (acc["after"] + F.when(touches | p.isNull(), 0).otherwise(p["after"])).alias("after"),
        )

    places = F.aggregate(F.array_sort(F.concat(wrote, read).cast(f"array<{place}>")), none, step, closed)
    edits = F.transform(
        places,
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"),
            _slice(source, p["start"], p["end"]).alias("original"), _slice(out, p["low"], p["high"]).alias("replacement"),
        ),
    )
    return F.filter(edits, lambda e: e["original"] != e["replacement"]).cast(EDITS)


def _bare(edits: Column) -> Column:
    return F.transform(edits, lambda e: F.struct(*[e[c].alias(c) for c in ("start", "end", "original", "replacement")])).cast(EDITS)


def rule(pattern: str, replacement: str, reason: str, version: str):
    """A stage that puts ``replacement`` where a regular expression matches, as a native column function."""

    def step(text: Column) -> Column:
        each = F.lit(rf"(?s)\G(.*?)({pattern})")  # without \G the rest would be searched from each of its places
        found = F.zip_with(
            F.regexp_extract_all(text, each, F.lit(1)), F.regexp_extract_all(text, each, F.lit(2)),
            lambda before, own: F.struct(before.alias("before"), own.alias("own")),
        )
        kind = EDITS.replace("replacement:string", "replacement:string,reason:string")

        def add(before: Column, m: Column) -> Column:
            start = F.coalesce(before["end"], F.lit(0)) + F.length(m["before"])
            return F.struct(start, start + F.length(m["own"]), m["own"], F.lit(replacement), F.lit(reason))

        edits = S.scan(found, add, kind.removeprefix("array<").removesuffix(">"))
        return F.struct(
            F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", replacement)).alias("text"), edits.alias("edits"),
            F.array().cast("array<string>").alias("warnings"), F.array().cast(S.SPANS).alias("protected"), F.lit(version).alias("policy_version"),
        )

    # Bound to a name, so that a plan which looks at several parts of a result works it out once.
    return lambda text: S.let(text, step)


def run_stages(rows: DataFrame, stages: dict, *, keep_written: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (``id, text`` and others) with a struct column for each stage, then ``edits``, ``final``, ``protected`` and ``problem``.

    ``stages`` maps names to functions of a text column.  ``edits`` lead from
    ``text`` to ``final`` and are composed stage by stage.  ``protected`` are the
    spans of ``final`` that any stage protects, carried through the later ones;
    those of ``keep_written`` protect all they write.  A stage that doesn't
    replay, or cuts what an earlier one protects, makes the row's ``problem``
    ``stage:reason``; the other three are null then.
    """
    out, before = rows, F.col("text")
    edits = spans = problem = None
    for name, step in stages.items():
        out = out.withColumn(name, step(before))
        own = F.col(name)
        said = F.concat(F.lit(f"{name}:"), stage_problem(before, own))
        kept = [own["protected"].cast(S.SPANS)]
        if name in keep_written:
            kept.append(F.filter(S.output_spans(own["edits"]), lambda s: s["end"] > s["start"]))
        if edits is None:
            edits, spans, problem = _bare(own["edits"]), S.merge(F.concat(*kept)), said
        else:
            carried = S.remap(F.col("_spans"), own["edits"])
            problem = F.coalesce(F.col("_problem"), said, F.when(carried.isNull() & before.isNotNull(), F.lit(f"{name}:cuts_protected")))
            edits, spans = compose(F.col("text"), F.col("_edits"), own["edits"], own["text"]), S.merge(F.concat(carried, *kept))
        out = out.withColumns({"_edits": edits, "_spans": spans, "_problem": problem})
        before = own["text"]
    sound = F.col("_problem").isNull()
    return out.withColumns({
        "edits": F.when(sound, F.col("_edits")), "final": F.when(sound, before), "protected": F.when(sound, F.col("_spans")), "problem": F.col("_problem"),
    }).drop("_edits", "_spans", "_problem")


def rules_status(final: Column) -> Column:
    """``ok``, or ``empty_after_policy`` where nothing is left for a model."""
    return F.when(final.isNull(), "not_run").when(T.strip(final) == "", "empty_after_policy").otherwise("ok")


def merge_model(rules: DataFrame, answers: DataFrame, reasons: Column) -> DataFrame:
    """Rules' texts with a model's answers, by id: what is taken, and why not.

    ``rules`` has ``id, rules_prediction``; ``answers`` is as the slot gives it,
    for the ids whose rules' text isn't blank.  ``reasons`` is the guard's
    column over ``rules_prediction, raw_output, tn_prediction``.  An id that was
    sent and isn't answered is ``missing``; one answered several times is
    ``repeated_answer`` and nothing of it is taken.
    """
    renamed = {"prediction": "tn_prediction", "status": "tn_status"}
    own = answers.withColumnsRenamed(renamed).groupBy("id")
    names = [c for c in answers.withColumnsRenamed(renamed).columns if c != "id"]
    single = own.agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in names])
    blank = rules_status(F.col("rules_prediction")) != "ok"
    status = (
        F.when(blank, F.lit("not_run_empty_after_policy"))
        .when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "repeated_answer")
        .otherwise(F.col("tn_status"))
    )
    judged = rules.join(single, "id", "left").withColumn("tn_status", status)
    taken = F.col("tn_status") == "ok"
    judged = judged.withColumn("tn_guard_reasons", F.when(taken, reasons).otherwise(F.array().cast("array<string>")))
    sound = taken & (F.size("tn_guard_reasons") == 0)
    return judged.withColumns({
        "prediction": F.when(sound, F.col("tn_prediction")).when(taken | blank, F.col("rules_prediction")).otherwise(F.coalesce("tn_prediction", F.lit(""))),
        "status": F.when(blank, rules_status(F.col("rules_prediction"))).when(taken & ~sound, "tn_guard_rejected").otherwise(F.col("tn_status")),
    }).drop("_n")


def audit_candidates(rules: DataFrame, candidates: DataFrame, reasons: Column) -> DataFrame:
    """Given answers looked at without a model: ``status`` and ``prediction`` of every row of ``rules``.

    A row without a candidate has ``rules_only``; else ``candidate_not_ok``,
    ``candidate_rejected`` by the guard, or ``candidate_guard_accepted``.
    """
    both = rules.join(candidates.withColumnsRenamed({"prediction": "tn_prediction", "status": "tn_status"}), "id", "left")
    there, fine = F.col("tn_status").isNotNull(), F.col("tn_status") == "ok"
    not_ok = F.array(F.lit("candidate_status_not_ok"))
    judged = both.withColumn("tn_guard_reasons", F.when(fine, reasons).when(there, not_ok).otherwise(F.array().cast("array<string>")))
    accepted = fine & (F.size("tn_guard_reasons") == 0)
    status = F.when(~there, "rules_only").when(~fine, "candidate_not_ok").when(accepted, "candidate_guard_accepted").otherwise("candidate_rejected")
    return judged.withColumn("status", status).withColumn("prediction", F.when(accepted, F.col("tn_prediction")).otherwise(F.col("rules_prediction")))


def versions(rows: DataFrame, stages: list[str]) -> DataFrame:
    """``stage, versions``: how many policy versions each stage's rows name; more than one is a change while it ran."""
    counts = [F.struct(F.lit(s).alias("stage"), F.count_distinct(F.col(s)["policy_version"]).alias("versions")) for s in stages]
    return rows.agg(F.array(*counts).alias("own")).select(F.explode("own").alias("own")).select("own.*")


def inverse_holds(source: Column, edits: Column, final: Column) -> Column:
    """Whether edits lead to ``final`` and their inverse leads back."""
    return reduce(lambda a, b: a & b, [S.replay(source, edits).eqNullSafe(final), S.replay(final, S.inverse(source, edits)).eqNullSafe(source)])
