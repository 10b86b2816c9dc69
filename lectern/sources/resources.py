"""Readers of the resource files that policies are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Subgroups of the emoji list whose pictures are moods or gestures.
SUBGROUPS = r"^(?:face-.*|cat-face|monkey-face|person-gesture|hand-.*|hands)$"


#: Lines that are put in order together.
STRETCH = 4096


def carried_down(lines: DataFrame, own: Column, name: str) -> DataFrame:
    """``lines`` (with ``n``) and in ``name`` the last value of ``own`` that isn't null, up to each line.

    Within stretches of lines by a window, and over the stretches' last values
    by another, which has one row for each.
    """
    said = F.when(own.isNotNull(), F.struct("n", own.alias("own")))
    rows = lines.withColumns({"_said": said, "_stretch": F.floor(F.col("n") / STRETCH)})
    ends = rows.groupBy("_stretch").agg(F.max("_said").alias("_end"))
    before = F.max("_end").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    here = F.max("_said").over(Window.partitionBy("_stretch").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_here", here).join(ends.select("_stretch", before.alias("_before")), "_stretch")
    return both.withColumn(name, F.coalesce("_here", "_before")["own"]).drop("_said", "_stretch", "_here", "_before")


def emoji_test(lines: DataFrame) -> DataFrame:
    """``picture, subgroup, status`` from ``n, value`` lines of an emoji list; components are left out."""
    own = F.nullif(F.regexp_extract("value", r"^# subgroup: (.*\S)\s*$", 1), F.lit(""))
    rows = carried_down(lines, own, "subgroup").where(F.col("value").rlike(r"^[0-9A-F]"))
    status = F.regexp_extract("value", r";\s*([a-z-]+)", 1)
    points = F.split(F.trim(F.substring_index("value", ";", 1)), " +")
    # Code points beyond the first plane need two units; UTF-32 has one for each.
    picture = F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(p, 8, "0")), "")), "UTF-32")
    return rows.select(picture.alias("picture"), "subgroup", status.alias("status")).where(
        (F.col("status") != "component") & F.col("subgroup").rlike(SUBGROUPS))


def platform_emotes(packages: DataFrame) -> DataFrame:
    """``name``: bare names of bracketed emotes in a nested listing ``data.packages[].emote[].text``."""
    each = packages.select(F.explode("data.packages").alias("p")).select(F.explode("p.emote").alias("e")).select(F.col("e.text").alias("t"))
    return each.where(F.col("t").rlike(r"\A\[[^\[\]\r\n]+\]\z")).select(F.expr("substring(t, 2, length(t) - 2)").alias("name")).distinct()


def cldr_names(spark: SparkSession, path: str) -> DataFrame:
    """``picture, name`` of spoken names in an annotation file."""
    rows = spark.read.format("xml").option("rowTag", "annotation").option("attributePrefix", "_").load(path)
    return rows.where("_type = 'tts'").select(F.col("_cp").alias("picture"), F.col("_VALUE").cast("string").alias("name"))


def token_rows(rows: DataFrame) -> DataFrame:
    """``context, pos, text, canonical, is_nc`` of nested token lists."""
    t = F.posexplode("tokens").alias("pos", "t")
    return rows.select(F.col("text").alias("context"), t).select("context", "pos", "t.text", "t.canonical", "t.is_nc")
