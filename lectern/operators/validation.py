"""Rules that cases, annotations, draft samples, training sets and runs must keep.

Every rule is a column, and what breaks it is a row: nothing stops at the first
fault, and a table of any size is judged in one pass.  Faults that concern many
rows at once (a repeated id, a group on two sides) are counted, not listed row by
row, so a hot key stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import spans as S
from lectern.functions import text as T
from lectern.operators.components import connected_components

ROLES = ("train", "validation")
#: Fixed values of draft samples.
TRACKS = ("core_tn", "context_reading", "preservation")
OPERATIONS = ("transform", "preserve")
#: Groups that a skill needs in each role.
LEAST_GROUPS = {"train": 2, "validation": 1}
#: Rows that a role of a training set may have.
MOST_ROWS = {"train": 256, "validation": 64}


def _blank(text: Column) -> Column:
    return F.coalesce(T.strip(text) == "", F.lit(True))


def _bad_list(texts: Column) -> Column:
    return F.coalesce((F.size(texts) <= 0) | F.exists(texts, _blank), F.lit(True))


def _broken(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def _counted(rows: DataFrame, problems: Column) -> DataFrame:
    return rows.select("id", F.explode(problems).alias("problem")).groupBy("id", "problem").agg(F.count("*").alias("n"))


def _repeated(rows: DataFrame, key: str, problem: str, *by: str) -> DataFrame:
    per = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))
    return per.where("n > 1").select(*by, F.col(key).alias("id"), F.lit(problem).alias("problem"), "n")


def case_problems(cases: DataFrame) -> DataFrame:
    """``id, problem, n`` for cases of ``id, text, family, track, refs``.

    References are non-blank texts, at least one; those of a preservation case
    have the source's surface.  An empty table has the one problem ``no_cases``.
    """
    surfaces = T.surface_each(F.col("refs"))
    own = T.surface(F.col("text"))
    rows = cases.withColumns({"_refs": surfaces, "_own": own})
    missing = F.lit(False)
    for name in ("family", "track", "text"):
        missing = missing | F.coalesce(F.col(name) == "", F.lit(True))
    found = _counted(
        rows,
        _broken(
            ("missing_id", F.coalesce(F.col("id") == "", F.lit(True))),
            ("bad_references", _bad_list(F.col("refs"))),
            ("missing_field", missing),
            ("preservation_changes", (F.col("track") == "preservation") & F.exists("_refs", lambda r: r != F.col("_own"))),
        ),
    )
    none = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no_cases").alias("problem"), "n")
    return found.unionByName(_repeated(cases.where("id <> ''"), "id", "repeated_id")).unionByName(none)


def annotation_problems(cases: DataFrame) -> DataFrame:
    """``id, problem, n`` for cases whose ``targets`` (start, end, source, outputs) and ``protected`` (start, end, text) mark ``text``.

    Targets lie in order and apart, say what stands there, and replay to the
    first of ``refs`` by their first outputs.
    """
    text, targets, protected = F.col("text"), F.col("targets"), F.col("protected")

    def slice_(s: Column) -> Column:
        return F.substring(text, s["start"] + 1, s["end"] - s["start"])

    walked = F.aggregate(
        targets,
        F.lit(0),
        lambda at, s: F.when((at >= 0) & (at <= s["start"]) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)), s["end"]).otherwise(-1),
    )
    edits = F.transform(
        targets, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(s["outputs"], F.lit(1)).alias("replacement"))
    )
    outside = F.exists(protected, lambda s: ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (slice_(s) == s["text"])))
    problems = _broken(
        ("bad_offsets", walked < 0),
        ("source_differs", F.exists(targets, lambda s: slice_(s) != s["source"])),
        ("no_replacement", F.exists(targets, lambda s: F.coalesce((F.size(s["outputs"]) <= 0) | F.exists(s["outputs"], lambda o: o.isNull()), F.lit(True)))),
        ("replay_differs", (walked >= 0) & (S.replay(text, edits) != F.try_element_at("refs", F.lit(1)))),
        ("bad_protected", outside),
    )
    return _counted(cases, problems)


def sample_problems(rows: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """``id, problem, n`` for draft samples, by the schema of a sample and what its operation and track promise."""
    rules = [(f"missing:{c}", _blank(F.col(c))) for c in ("id", "skill_id", "group_id", "text", "target", "rationale")]
    for c, allowed in (("proposed_role", ROLES), ("track", TRACKS), ("operation", OPERATIONS)):
        rules.append((f"invalid:{c}", ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))))
    outputs = F.col("acceptable_outputs")
    rules += [
        ("bad_outputs", _bad_list(outputs) | ~F.coalesce(F.array_contains(outputs, F.col("target")), F.lit(False))),
        ("preserve_changes_text", (F.col("operation") == "preserve") & ~F.col("target").eqNullSafe(F.col("text"))),
        ("transform_keeps_text", (F.col("operation") == "transform") & F.col("target").eqNullSafe(F.col("text"))),
        ("preservation_needs_preserve", (F.col("track") == "preservation") & ~F.col("operation").eqNullSafe(F.lit("preserve"))),
        ("ready_draft", ~F.col("training_ready").eqNullSafe(F.lit(False))),
        ("bad_provenance", _unlike(F.col("provenance"), provenance)),
    ]
    return _counted(rows, _broken(*rules))


def _unlike(found: Column, expected: dict[str, str]) -> Column:
    out = found.isNull()
    for key, value in expected.items():
        out = out | ~F.try_element_at(found, F.lit(key)).eqNullSafe(F.lit(value))
    return out


def coverage_problems(rows: DataFrame, *, group: str = "group_id", only_transform: tuple[str, ...] = ()) -> DataFrame:
    """``kind, skill_id, group_id, role, n`` for valid samples: groups on both sides, and skills without enough of either.

    ``group`` may be the component after a merge, as groups that were declared
    apart may turn out to be one.  Skills in ``only_transform`` need no row that
    preserves.
    """
    null = F.lit(None).cast("string")
    changes, keeps = (F.count_if(F.col("operation") == o) for o in OPERATIONS)
    across = rows.groupBy(group).agg(F.count_distinct("proposed_role").alias("n")).where("n > 1")
    across = across.select(F.lit("group_cross_role").alias("kind"), null.alias("skill_id"), F.col(group).alias("group_id"), null.alias("role"), "n")
    skills = rows.groupBy("skill_id").agg(changes.alias("t"), keeps.alias("p"), F.count("*").alias("n"))
    lacking = skills.where((F.col("t") == 0) | ((F.col("p") == 0) & ~F.col("skill_id").isin(*only_transform)))
    lacking = lacking.select(F.lit("missing_operation").alias("kind"), "skill_id", null.alias("group_id"), null.alias("role"), "n")
    # Each skill in each role, also where it has no row.
    per = rows.groupBy("skill_id", F.col("proposed_role").alias("role")).agg(F.count_distinct(group).alias("n"), changes.alias("t"))
    wanted = skills.select("skill_id", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    per = wanted.join(per, ["skill_id", "role"], "left").na.fill(0, ["n", "t"])
    least = F.when(F.col("role") == "train", LEAST_GROUPS["train"]).otherwise(LEAST_GROUPS["validation"])
    short = _broken(("insufficient_groups", F.col("n") < least), ("missing_transform", F.col("t") == 0))
    short = per.select(F.explode(short).alias("kind"), "skill_id", null.alias("group_id"), "role", "n")
    return across.unionByName(lacking).unionByName(short)


def training_problems(rows: DataFrame, provenance: dict[str, str], *, most: dict[str, int] | None = None) -> DataFrame:
    """``role, id, problem, n`` for a registered training set of two roles.

    Rows are judged by themselves, then ids and sources (by digest) that repeat
    in a role, roles that are empty or too large, and ids, groups and sources
    that both roles have; those have no role.
    """
    keyed = rows.withColumn("source", F.sha2(T.squeezed(F.col("text")).cast("binary"), 256))
    rules = [(f"missing:{c}", _blank(F.col(c))) for c in ("id", "text", "target", "track", "family", "group_id")]
    outputs = F.col("acceptable_outputs")
    rules.append(("bad_outputs", _bad_list(outputs) | ~F.coalesce(F.array_contains(outputs, F.col("target")), F.lit(False))))
    assigned = F.try_element_at("provenance", F.lit("assigned_role")).eqNullSafe(F.col("role"))
    rules.append(("bad_provenance", _unlike(F.col("provenance"), provenance) | ~assigned))
    own = keyed.select("role", "id", F.explode(_broken(*rules)).alias("problem")).groupBy("role", "id", "problem").agg(F.count("*").alias("n"))
    found = own.unionByName(_repeated(keyed, "id", "repeated_id", "role")).unionByName(_repeated(keyed, "source", "repeated_source", "role"))
    limits = most or MOST_ROWS
    sizes = rows.agg(*[F.count_if(F.col("role") == r).alias(r) for r in ROLES])
    sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("n"), F.lit(limits[r]).alias("most")) for r in ROLES])).alias("s"))
    sizes = sizes.select("s.*").where("n = 0 or n > most").select("role", F.lit(None).cast("string").alias("id"), F.lit("row_count").alias("problem"), "n")
    found = found.unionByName(sizes)
    for key in ("id", "group_id", "source"):
        both = rows_in_both(keyed, key).select(F.lit(None).cast("string").alias("role"), F.col(key).alias("id"), F.lit(f"overlap:{key}").alias("problem"), "n")
        found = found.unionByName(both)
    return found


def rows_in_both(rows: DataFrame, key: str) -> DataFrame:
    """``key, n``: keys that both roles have, with their rows; one aggregation."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("role").alias("roles"), F.count("*").alias("n"))
    return per.where("roles > 1").select(key, "n")


def identity_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``run, key, actual`` where a run's metadata isn't among the values allowed for a key, or lacks the key.

    Both have ``run, key, value``; a key allowed as null must be null, and keys
    that nothing is said of are left alone.
    """
    allowed = expected.select("run", "key", F.col("value").alias("wanted")).distinct()
    # A value for each run and key; a set of allowed ones is short.
    judged = allowed.join(actual.select("run", "key", F.col("value").alias("actual")), ["run", "key"], "left")
    per = judged.groupBy("run", "key", "actual").agg(F.bool_or(F.col("wanted").eqNullSafe(F.col("actual"))).alias("ok"))
    return per.where("not ok").select("run", "key", "actual")


def integrity(checks: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``run, eligible, failed`` from ``run, name, holds``: all required checks must be there and hold."""
    per = checks.where(F.col("name").isin(*required)).groupBy("run", "name").agg(F.bool_and(F.coalesce("holds", F.lit(False))).alias("holds"))
    # At most as many names as are required.
    held = per.where("holds").groupBy("run").agg(F.collect_set("name").alias("held"))
    runs = checks.select("run").distinct().join(held, "run", "left")
    names = F.array(*[F.lit(n) for n in sorted(required)])
    failed = F.array_except(names, F.coalesce("held", F.array().cast("array<string>")))
    return runs.select("run", (F.size(failed) == 0).alias("eligible"), F.array_join(failed, ",").alias("failed"))


def reference_coverage(cases: DataFrame) -> DataFrame:
    """``scored, pending``: cases with references and without."""
    has = F.coalesce(F.size("refs") > 0, F.lit(False))
    return cases.agg(F.count_if(has).alias("scored"), F.count_if(~has).alias("pending"))


def alternative_groups(labels: DataFrame) -> DataFrame:
    """``key, forms, groups``: how many accepted sets a surface has, once sets that share a form are one.

    ``labels`` has ``key, accepted`` (array<string>); nulls in it are ignored.
    """
    rows = labels.select("key", F.array_distinct(F.array_compact("accepted")).alias("accepted")).where("key is not null and size(accepted) > 0")
    named = rows.select("key", F.transform("accepted", lambda a: F.concat(F.col("key"), F.lit("\0"), a)).alias("own"))
    # A star for each set: its first form and all of them, itself included.
    edges = named.select(F.col("own")[0].alias("a"), F.explode("own").alias("b")).distinct()
    found = connected_components(edges, "a", "b")
    per = found.groupBy(F.substring_index("node", "\0", 1).alias("key"))
    return per.agg(F.count("*").alias("forms"), F.count_if(F.col("node") == F.col("component")).alias("groups"))


def sampling_problems(config: dict) -> list[str]:
    """What is wrong with a sampling configuration: dates in order, whole numbers, something to sample."""
    found = []
    if not str(config["since"]) < str(config["until"]):
        found.append("since_not_before_until")
    sizes = {k: config[k] for k in ("seed", "candidates", "controls")}
    found += [f"not_whole:{k}" for k, v in sizes.items() if type(v) is not int]
    found += [f"negative:{k}" for k in ("candidates", "controls") if type(sizes[k]) is int and sizes[k] < 0]
    if not found and not config["candidates"] + config["controls"]:
        found.append("empty_sample")
    return found
