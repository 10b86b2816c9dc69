"""What draft samples repeat: among themselves, of a historical set, and of held-out inputs.

Rows are taken by class: equal texts, equal keys, texts equal but for numbers
(templates), and templates that are near.  A template has one finding of a kind
if any two of its rows make it, near templates speak through the first row of
each role (and group), so a class of any size makes a few findings, and every two
classes that match are in one.

``rows`` and ``historical`` have ``id, text, key, template, role``, rows also
``grp``; ``held_out`` has ``id, text, key, template``.  Ids order the rows; the
earlier row is the left one.  Between tables the sample is left.

Cases: rows with a null text, key or template match nothing; a null role or
group is one of its own; empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.near import near_pairs

_FOUND = ("kind", "blocks", "left", "right", "match_kind", "similarity")


def _finding(rows: DataFrame, kind: Column, blocks: Column, match: Column, similarity: Column) -> DataFrame:
    return rows.select(kind.alias("kind"), blocks.alias("blocks"), "left", "right", match.alias("match_kind"), similarity.cast("double").alias("similarity"))


def _speakers(rows: DataFrame, *by: str) -> DataFrame:
    """The first row of each template and ``by``."""
    first = F.min(F.struct("id", "text", "key"))
    return rows.where("text is not null and key is not null and template is not null").groupBy("template", *by).agg(first.alias("f")).select("template", *by, "f.*")


def _equal_kind(left: str, right: str) -> Column:
    """How rows of one template are equal."""
    same = F.col(f"{left}.text") == F.col(f"{right}.text")
    return F.when(same, "exact").when(F.col(f"{left}.key") == F.col(f"{right}.key"), "normalized").otherwise("numeric_template")


def _near(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """``left, right, similarity`` of speakers of near templates."""
    sides = [t.select(F.col("id").alias("pos"), F.col("template").alias("key")) for t in (left, right) if t is not None]
    return near_pairs(*sides).select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("ratio").alias("similarity"))


def _unlike_pairs(units: DataFrame, by: list[str], what: str) -> DataFrame:
    """``left, right, a, b``: a pair of other texts and other ``what`` in each class (``by``) that has one.

    The first row, or else a row of its text, stands in it: if no row differs
    from the first in both, one that differs in ``what`` and one that differs
    in text differ from each other in both.
    """
    row = F.struct("id", "text", "key", what)
    first = units.groupBy(*by).agg(F.min(row).alias("a")).withColumnsRenamed({c: f"_{c}" for c in by})
    same_class = F.lit(True)
    for c in by:
        same_class = same_class & F.col(c).eqNullSafe(F.col(f"_{c}"))
    other, reworded = ~F.col(what).eqNullSafe(F.col(f"a.{what}")), F.col("text") != F.col("a.text")
    per = units.join(first, same_class).groupBy(*by).agg(
        F.any_value("a").alias("a"), F.min(F.when(other & reworded, row)).alias("c"), F.min(F.when(other & ~reworded, row)).alias("x"), F.min(F.when(~other & reworded, row)).alias("y"),
    )
    pair = F.when(F.col("c").isNotNull(), F.array("a", "c")).when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array_sort(F.array("x", "y")))
    found = per.select(pair.alias("p")).where("p is not null").select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return found.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), "a", "b")


def own_findings(rows: DataFrame) -> DataFrame:
    """Findings among ``rows``: copies block, likeness across roles blocks, likeness across groups of a role is a warning."""
    many = rows.where("text is not null").groupBy("text").agg(F.min("id").alias("left"), F.max("id").alias("right")).where("left < right")
    out = _finding(many, F.lit("duplicate_text"), F.lit(True), F.lit("exact"), F.lit(1.0))

    units = rows.where("text is not null and key is not null and template is not null")
    units = units.groupBy("template", "role", "grp", "text").agg(F.min(F.struct("id", "key")).alias("f")).select("template", "role", "grp", "text", "f.*")
    for kind, by, what in (("seed_cross_role_similarity", ["template"], "role"), ("seed_same_role_similarity", ["template", "role"], "grp")):
        met = _unlike_pairs(units, by, what)
        blocks = kind == "seed_cross_role_similarity"
        out = out.unionByName(_finding(met, F.lit(kind), F.lit(blocks), _equal_kind("a", "b"), F.lit(1.0)))

    per = _speakers(rows, "role", "grp")
    ends = [per.select(F.col("id").alias(s), F.col("role").alias(f"r_{s}"), F.col("grp").alias(f"g_{s}")) for s in ("left", "right")]
    near = _near(per, None).join(ends[0], "left").join(ends[1], "right")
    across = ~F.col("r_left").eqNullSafe(F.col("r_right"))
    kinds = F.when(across, "seed_cross_role_similarity").when(~F.col("g_left").eqNullSafe(F.col("g_right")), "seed_same_role_similarity")
    near = near.withColumns({"k": kinds, "x": across}).where("k is not null")
    return out.unionByName(_finding(near, F.col("k"), F.col("x"), F.lit("near_phrase"), F.col("similarity")))


def historical_findings(rows: DataFrame, historical: DataFrame) -> DataFrame:
    """Likeness to a historical set: across roles it blocks, within a role it is a warning."""
    one, two = _speakers(rows, "role"), _speakers(historical, "role")
    across = ~F.col("a.role").eqNullSafe(F.col("b.role"))
    equal = one.alias("a").join(two.alias("b"), "template").select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), across.alias("x"), _equal_kind("a", "b").alias("m"), F.lit(1.0).alias("s"))
    ends = [t.select(F.col("id").alias(s), F.col("role").alias(f"r_{s}")) for t, s in ((one, "left"), (two, "right"))]
    near = _near(one, two).join(ends[0], "left").join(ends[1], "right")
    near = near.select("left", "right", (~F.col("r_left").eqNullSafe(F.col("r_right"))).alias("x"), F.lit("near_phrase").alias("m"), F.col("similarity").alias("s"))
    kind = F.when(F.col("x"), "v1_cross_role_similarity").otherwise("v1_same_role_similarity")
    return _finding(equal.unionByName(near), kind, F.col("x"), F.col("m"), F.col("s"))


def held_out_findings(rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Likeness to held-out inputs always blocks."""
    one, two = _speakers(rows), _speakers(held_out)
    equal = one.alias("a").join(two.alias("b"), "template").select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), _equal_kind("a", "b").alias("m"), F.lit(1.0).alias("s"))
    near = _near(one, two).select("left", "right", F.lit("near_phrase").alias("m"), F.col("similarity").alias("s"))
    return _finding(equal.unionByName(near), F.lit("old_heldout_similarity"), F.lit(True), F.col("m"), F.col("s"))


def findings(rows: DataFrame, historical: DataFrame | None = None, held_out: DataFrame | None = None) -> DataFrame:
    """``kind, blocks, left, right, match_kind, similarity``: all that blocks ``rows`` or is to be looked at."""
    out = own_findings(rows)
    if historical is not None:
        out = out.unionByName(historical_findings(rows, historical))
    if held_out is not None:
        out = out.unionByName(held_out_findings(rows, held_out))
    return out


def status(found: DataFrame) -> DataFrame:
    """``status, blockers, warnings``: blocked by any finding that blocks."""
    blockers, warnings = F.count_if("blocks"), F.count_if(~F.col("blocks"))
    return found.agg(F.when(blockers > 0, "blocked").otherwise("draft_checks_passed").alias("status"), blockers.alias("blockers"), warnings.alias("warnings"))
