"""Dataset packages: several tables published as one, bound by hashes, and read only as they are bound.

A package is a folder of versions and one small file, ``current.json``, that
names a version and the digest of its manifest.  A version is written in full
under its own name first: tables, then the manifest, a table of the size and
digest of every file (by a scan on the executors).  Only then is ``current.json``
renamed over the old one, the one step that readers can see; whatever stops the
writer before it leaves the old package, and what lies in a version that nothing
names is never read.

Cases: an empty table is a table without rows; a package that was never
published, a digest that differs, a file that is missing or that no manifest
lists, and a table that the manifest doesn't name are errors, before a row is
read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import validation as V
from lectern.sources import sinks

CURRENT, MANIFEST = "current.json", "manifest"
_ENTRIES = "path string, bytes long, sha256 string"


class PackageError(ValueError):
    """A package that isn't what its manifest says."""


def _files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``path, bytes, sha256`` of the data files of tables, paths relative to the version."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{n}" for n in names])
    # Hadoop writes checksums and markers that hold no data.
    kept = rows.where(~F.regexp_extract("path", "[^/]+$", 0).rlike(r"^[._]"))
    own = F.substring_index("path", f"/{folder.rsplit('/', 1)[1]}/", -1)
    return kept.select(own.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _bound(spark: SparkSession, folder: str) -> list[dict]:
    """The manifest's own files; it is written as one."""
    return [r.asDict() for r in _files(spark, folder, [MANIFEST]).orderBy("path").limit(2).collect()]


def publish(spark: SparkSession, target: str, tables: dict[str, DataFrame], about: dict) -> str:
    """Publish ``tables`` as the package's new version, whose name is returned."""
    version = uuid.uuid4().hex
    folder = f"{target}/versions/{version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    # One file of entries; the tables themselves are read by as many tasks as they need.
    _files(spark, folder, list(tables)).repartition(1).write.mode("errorifexists").parquet(f"{folder}/{MANIFEST}")
    current = {"version": version, "about": about, "tables": sorted(tables), "manifest": _bound(spark, folder)}
    sinks.publish_json(spark, f"{target}/{CURRENT}", current)
    return version


def current_of(spark: SparkSession, target: str) -> dict:
    """What the package's present version is, its manifest bound by size and digest."""
    current = sinks.read_json(spark, f"{target}/{CURRENT}")
    if _bound(spark, f"{target}/versions/{current['version']}") != current["manifest"]:
        raise PackageError("the manifest isn't the published one")
    return current


def problems(spark: SparkSession, target: str, current: dict) -> DataFrame:
    """``path, problem`` of files that the manifest doesn't bind as they are."""
    folder = f"{target}/versions/{current['version']}"
    listed = spark.read.schema(_ENTRIES).parquet(f"{folder}/{MANIFEST}")
    both = listed.alias("l").join(_files(spark, folder, current["tables"]).alias("f"), "path", "full")
    problem = (
        F.when(F.col("l.sha256").isNull(), "unlisted")
        .when(F.col("f.sha256").isNull(), "missing")
        .when((F.col("l.bytes") != F.col("f.bytes")) | (F.col("l.sha256") != F.col("f.sha256")), "differs")
    )
    return both.select("path", problem.alias("problem")).where("problem is not null")


def read(spark: SparkSession, target: str, *names: str) -> dict[str, DataFrame]:
    """Tables of the package's present version, which is verified as a whole first."""
    current = current_of(spark, target)
    if unknown := set(names) - set(current["tables"]):
        raise PackageError(f"no table {min(unknown)}")
    bad = problems(spark, target, current).orderBy("path").limit(3).collect()
    if bad:
        raise PackageError("; ".join(f"{r['path']}: {r['problem']}" for r in bad))
    # Every file below is listed, and every listed one is there.
    return {n: spark.read.parquet(f"{target}/versions/{current['version']}/{n}") for n in names}


def registered_training(spark: SparkSession, target: str, provenance: dict[str, str], *, most: dict[str, int] | None = None) -> DataFrame:
    """``role`` and the columns of a package's two role tables, if they keep every rule of a training set.

    Only the two roles are read, whatever else the package holds.
    """
    train, validation = (df.withColumn("role", F.lit(role)) for role, df in read(spark, target, *V.ROLES).items())
    rows = train.unionByName(validation)
    bad = V.training_problems(rows, provenance, most=most).orderBy("problem", "id").limit(3).collect()
    if bad:
        raise PackageError("; ".join(f"{r['problem']} {r['id']}" for r in bad))
    return rows
