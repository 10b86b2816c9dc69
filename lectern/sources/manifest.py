"""Manifests of files, and checks of directories and archive members against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.review import manifest_diff


def binary_files(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def manifest(files: DataFrame) -> DataFrame:
    """``path, bytes, sha256`` of ``path, content`` rows."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changes(files: DataFrame, expected: DataFrame) -> DataFrame:
    return manifest_diff(expected, manifest(files))


def safe_path(path: Column) -> Column:
    """A relative path that stays where it is put."""
    bad = path.rlike(r"^/|^[A-Za-z]:|\\|\x00|(^|/)\.{1,2}(/|$)|//|/$") | (path == "")
    return ~bad


def member_problems(members: DataFrame, *, most_bytes: int, suffixes: tuple[str, ...], parts: tuple[str, ...]) -> DataFrame:
    """``path, problem`` for archive members that may not be shipped."""
    low = F.lower("path")
    bad_part = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(p) for p in parts]))
    bad_suffix = F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: low.endswith(s))
    problem = F.when(~safe_path(F.col("path")), "unsafe_path").when(bad_part, "forbidden_part").when(bad_suffix, "forbidden_suffix").when(
        F.col("bytes") > most_bytes, "too_large")
    each = members.select("path", problem.alias("problem")).where("problem is not null")
    twice = members.groupBy(low.alias("path")).count().where("count > 1").select("path", F.lit("repeated").alias("problem"))
    return each.unionByName(twice)


def directory_totals(files: DataFrame) -> DataFrame:
    """Files and bytes by first part of the path."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(top.alias("top")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
