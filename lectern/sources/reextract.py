"""Extraction over a captured corpus again, offline, in batches that a stopped run goes on from.

A batch is the documents whose id's digest falls to it.  Its bodies are hashed
in the rows that are extracted, so bytes that differ from the capture stop the
batch before it is committed.  A batch's items are written beside their place
and renamed into it, and a receipt that names the run is published last; what
has no receipt of this run is done again, whatever lies there.  The result is
read from receipts alone, and of equal items the first by document and place
stays, so it is one table however often the run was stopped.

Cases: a body that is missing, or whose size or digests differ, stops the run
with its path; a null text of an item is no item; documents that repeat are
extracted once; an empty capture gives an empty table; batches may be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import sinks
from lectern.sources.capture import differs
from lectern.storage import exists

ITEMS = "id string, place int, item string"


class CaptureChanged(ValueError):
    """The capture isn't the one the run was begun on."""


def batch_of(id_: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(id_.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def capture_digest(documents: DataFrame) -> str:
    """A digest of what is listed, in any order: sums over digests of rows, in two halves."""
    row = F.sha2(F.concat_ws("\0", "id", "path", F.col("bytes").cast("string"), "sha256", "git_blob_sha").cast("binary"), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31)]
    found = documents.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]).cast("binary"), 256).alias("d"))
    return found.first()["d"]


def verified_texts(documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """``id, text`` of listed documents; a body that isn't as listed raises in its row."""
    both = documents.dropDuplicates(["id"]).join(bodies.select("path", "content"), "path", "left")
    problem = F.when(F.col("content").isNull(), "missing").otherwise(differs(F.col("bytes"), F.col("sha256"), F.col("git_blob_sha"), F.col("content")))
    text = F.when(problem.isNull(), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat_ws(": ", F.lit("capture changed"), "path", problem)))
    return both.select("id", text.alias("text"))


def _receipt(output: str, batch: int) -> str:
    return f"{output}/receipts/batch-{batch}.json"


def _done(spark: SparkSession, output: str, batch: int, run: str) -> bool:
    path = _receipt(output, batch)
    return exists(spark, path) and sinks.read_json(spark, path)["run"] == run


def reextract(documents: DataFrame, bodies: DataFrame, extract: Callable[[DataFrame], DataFrame], output: str, *, revision: str, batches: int = 8) -> DataFrame:
    """``id, place, item`` of ``documents`` (``id, path, bytes, sha256, git_blob_sha``), from ``bodies`` (``path, content``).

    ``extract`` makes ``id, place, item`` of ``id, text``; ``revision`` tells one
    such function from another.  Call it again with the same arguments to go on.
    """
    spark = documents.sparkSession
    run = f"{revision}:{batches}:{capture_digest(documents)}"
    for batch in range(batches):
        if _done(spark, output, batch, run):
            continue
        own = documents.where(batch_of(F.col("id"), batches) == batch)
        place, staged = f"{output}/items/batch-{batch}", f"{output}/items/.batch-{batch}"
        extract(verified_texts(own, bodies)).where("item is not null").select("id", "place", "item").write.mode("overwrite").parquet(staged)
        old, fs = sinks._path(spark, place)
        fs.delete(old, True)  # without a receipt of this run it counts for nothing
        new, _ = sinks._path(spark, staged)
        if not fs.rename(new, old):
            raise OSError(f"could not place {place}")
        sinks.publish_json(spark, _receipt(output, batch), {"run": run, "batch": batch})
    return result(spark, output, run, batches)


def result(spark: SparkSession, output: str, run: str, batches: int) -> DataFrame:
    """The items of a whole run, each once."""
    if missing := [b for b in range(batches) if not _done(spark, output, b, run)]:
        raise CaptureChanged(f"batches without receipt: {missing}")
    rows = spark.read.schema(ITEMS).parquet(*[f"{output}/items/batch-{b}" for b in range(batches)])
    first = rows.groupBy("item").agg(F.min(F.struct("id", "place")).alias("f"))
    return first.select("f.id", "f.place", "item")
