"""Outputs: new folders only, a manifest of what was written, and a record of the run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step: readers see the old one or the new one, never none."""
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = next(x for x in kind.getEnumConstants() if x.toString() == "OVERWRITE")
    (old, _), (new, _) = _path(spark, source), _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(old), context.makeQualified(new), options)


def publish_json(spark: SparkSession, path: str, document: dict) -> None:
    """One small document, whole or not at all: written beside its place, then renamed over it."""
    folder, _, name = path.rpartition("/")
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    part, fs = _path(spark, own)
    body = json.dumps(document, ensure_ascii=False, sort_keys=True, allow_nan=False, indent=2) + "\n"
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    replace(spark, own, path)


def read_json(spark: SparkSession, path: str) -> dict:
    """One small document, strictly: a repeated key is an error."""
    text = spark.read.text(path, wholetext=True).first()

    def once(pairs: list) -> dict:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError(f"repeated key in {path}")
        return found

    return json.loads(text["value"], object_pairs_hook=once)


def require_new(spark: SparkSession, output: str, sources: list[str]) -> None:
    """The output doesn't exist, and is no source, nor in one, nor around one."""
    target, fs = _path(spark, output)
    if fs.exists(target):
        raise FileExistsError(output)
    own = output.rstrip("/") + "/"
    for source in sources:
        other = source.rstrip("/") + "/"
        if own.startswith(other) or other.startswith(own):
            raise ValueError(f"output {output} overlaps source {source}")


def run_recorded(spark: SparkSession, output: str, sources: list[str], tables: Callable[[], dict[str, DataFrame]]) -> dict:
    """Write each table to its folder under ``output``; run.json says started, then complete or failed."""
    require_new(spark, output, sources)
    state = {"status": "started", "started_at": datetime.now(UTC).isoformat(), "sources": sources}
    publish_json(spark, f"{output}/run.json", state)
    try:
        for name, df in tables().items():
            df.write.mode("errorifexists").parquet(f"{output}/{name}")
        state |= {"status": "complete", "manifest": written_files(spark, output)}
    except Exception as e:
        state |= {"status": "failed", "error": type(e).__name__}
        raise
    finally:
        publish_json(spark, f"{output}/run.json", state | {"ended_at": datetime.now(UTC).isoformat()})
    return state


def written_files(spark: SparkSession, output: str) -> dict[str, int]:
    """Number and bytes of the data files below ``output``, by a scan of their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(output)
    row = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return {"files": row["files"], "bytes": row["bytes"]}


def markdown_list(rows: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """``ordinal, value``: a report's lines, a heading and one list item a row in order of id."""
    parts = []
    for f in fields:
        shown = F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("-")), r"[\r\n]+", " ")
        parts += [F.lit(f"{f}: "), shown, F.lit("; ")]
    item = F.concat(F.lit("- "), *parts[:-1])
    head = rows.sparkSession.createDataFrame([(None, f"# {title}")], "ordinal string, value string")
    return head.unionByName(rows.select(F.col("id").cast("string").alias("ordinal"), item.alias("value")))
