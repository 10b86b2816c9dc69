"""Archived runs found by their files, and snapshots proved byte for byte.

A run's results lie either beside it, ``run/name.jsonl`` with
``run/name.meta.json``, or wrapped, ``run/name/predictions.jsonl`` with a
``run.json`` that binds them by digest.  Both at once are an error row, and so is
a wrapped run that isn't complete, is labelled otherwise, or whose files differ.

Cases: files that belong to no layout are left out; a ``run.json`` that is no
JSON is incomplete; a null content is a missing file; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.review import manifest_diff
from lectern.sources.manifest import manifest

#: Evidence that a run may bind, with the fields of its file and digest.
EVIDENCE = (
    ("inputs.original.jsonl", "original_input_file", "original_input_sha256"),
    ("inputs.runner.jsonl", "runner_input_file", "runner_input_sha256"),
    ("model_manifest.json", "model_manifest_file", "model_manifest_sha256"),
)


def _said(state: Column, name: str) -> Column:
    return F.try_variant_get(state, f"$.{name}", "string")


def discover(files: DataFrame) -> DataFrame:
    """``run, name, layout, predictions_sha256, problem`` of the results among ``path, content`` files.

    Paths are ``run/file`` or ``run/name/file``.  The first fault is the row's
    ``problem``; a sound row has none.
    """
    parts = F.split("path", "/")
    wrapped = F.size(parts) == 3
    kinds = F.when(F.size(parts) == 2, F.regexp_extract(parts[1], r"\A(.+?)\.(jsonl|meta\.json)\z", 1)).when(wrapped, parts[1])
    kind = F.when(F.size(parts) == 2, F.concat(F.lit("legacy."), F.regexp_extract(parts[1], r"\A.+?\.(jsonl|meta\.json)\z", 1))).otherwise(parts[F.size(parts) - 1])
    digest = F.sha2("content", 256)
    own = files.where(F.size(parts).isin(2, 3)).select(parts[0].alias("run"), kinds.alias("name"), kind.alias("kind"), digest.alias("sha256"),
                                                       F.when((F.size(parts) == 3) & (parts[2] == "run.json"), F.try_parse_json(F.decode("content", "UTF-8"))).alias("state"))
    known = ("legacy.jsonl", "legacy.meta.json", "predictions.jsonl", "run.json", *[f for f, _, _ in EVIDENCE])
    per = own.where((F.col("name") != "") & F.col("kind").isin(*known)).groupBy("run", "name").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("sha256"))).alias(f"h{n}") for n, k in enumerate(known)],
        F.any_value("state", ignoreNulls=True).alias("state"),
    )
    legacy, results, state = F.col("h0"), F.col("h2"), F.col("state")
    evidence = F.lit(None)
    for n, (file, field, hash_) in enumerate(EVIDENCE, 4):
        there = _said(state, field)
        bad = F.when(there != file, F.lit(f"evidence_path:{field}")).when(~F.coalesce(F.col(f"h{n}") == _said(state, hash_), F.lit(False)), F.lit(f"evidence_differs:{field}"))
        evidence = F.coalesce(evidence, F.when(there.isNotNull(), bad))
    problem = (
        F.when(legacy.isNotNull() & results.isNotNull(), "ambiguous_layout")
        .when(results.isNull(), F.when(F.col("h1").isNull(), "missing_metadata"))
        .when(~_said(state, "status").eqNullSafe(F.lit("complete")), "incomplete")
        .when(~_said(state, "baseline").eqNullSafe(F.col("name")), "mislabeled")
        .when(~_said(state, "predictions_sha256").eqNullSafe(results), "predictions_differ")
        .otherwise(evidence)
    )
    found = per.where(legacy.isNotNull() | results.isNotNull())
    layout = F.when(problem.eqNullSafe(F.lit("ambiguous_layout")), "both").when(results.isNotNull(), "wrapped").otherwise("legacy")
    return found.select("run", "name", layout.alias("layout"), F.coalesce(results, legacy).alias("predictions_sha256"), problem.alias("problem"))


def snapshot(files: DataFrame, target: str) -> None:
    """Keep ``path, content`` files as they are now, as a table of their bytes."""
    files.select("path", "content").write.mode("errorifexists").parquet(target)


def snapshot_problems(spark: SparkSession, files: DataFrame, target: str) -> DataFrame:
    """``path, problem``: files that a snapshot lacks, has beyond them, or has with other bytes; digests of both are worked out anew."""
    return manifest_diff(manifest(files), manifest(spark.read.parquet(target)))
