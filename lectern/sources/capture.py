"""Captured CSV files: verified by hash before any is parsed, then rows with their places."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.text import git_blob_sha1
from lectern.sources.manifest import safe_path

#: The columns that a capture must have.
REQUIRED = ("bv_id", "oid", "rpid", "root_rpid", "parent_rpid", "ctime", "message")
#: 2009-01-01 in China, as epoch seconds.
EARLIEST = 1230739200
PARSED = "path string, record_number int, line_start int, line_end int, n_fields int, n_header int, " + ", ".join(
    f"{c} string" for c in REQUIRED
)


class CaptureError(ValueError):
    """A capture that can't be trusted: nothing of it is used."""


def differs(bytes_: Column, sha256: Column, git_blob_sha: Column, content: Column) -> Column:
    """How a content differs from what a manifest says of it, or null."""
    return (
        F.when(F.octet_length(content) != bytes_, "size")
        .when(F.sha2(content, 256) != sha256, "sha256")
        .when(git_blob_sha1(content) != git_blob_sha, "git_blob")
    )


def bad_entry() -> Column:
    """What is wrong with a manifest's entry by itself, or null."""
    bad = (F.col("bytes") < 0) | ~F.col("sha256").rlike(r"\A[0-9a-f]{64}\z") | ~F.col("git_blob_sha").rlike(r"\A[0-9a-f]{40}\z")
    return F.when(F.coalesce(~safe_path(F.col("path")) | F.col("path").contains(":"), F.lit(True)), "unsafe_path").when(F.coalesce(bad, F.lit(True)), "bad_entry")


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, problem`` for every file that differs from the manifest, by either hash or size, and every entry that is none.

    ``files`` has ``path, content``; ``manifest`` has ``path, bytes, sha256,
    git_blob_sha``.  The content stays in the same frame, so it is read once.
    """
    own = files.select("path", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("h"), git_blob_sha1(F.col("content")).alias("g"))
    both = manifest.join(own, "path", "full")
    problem = (
        F.when(F.col("bytes").isNull() & F.col("sha256").isNull() & F.col("n").isNotNull(), "unlisted")
        .when(bad_entry().isNotNull(), bad_entry())
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") != F.col("bytes"), "size")
        .when(F.col("h") != F.col("sha256"), "sha256")
        .when(F.col("g") != F.col("git_blob_sha"), "git_blob")
    )
    twice = manifest.groupBy(F.lower("path").alias("path")).count().where("count > 1").select("path", F.lit("listed_twice").alias("problem"))
    return both.select("path", problem.alias("problem")).where("problem is not null").unionByName(twice)


#: Bytes of files whose rows are handed back at a time; one longer file is by itself.
PIECE_BYTES = 512 * 1024


def capture_of(path: Column) -> Column:
    """A capture is a folder of files: the first part of their paths."""
    return F.lower(F.substring_index(path, "/", 1))


def trusted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, content`` of the data files of captures that their manifest binds in full.

    One problem anywhere in a capture keeps all of it out: what is parsed depends
    on the verification of every file, as an aggregate by capture.  The bytes are
    looked at again in the row that is parsed, so a file that changes between the
    two reads stops the job and is never parsed.  A manifest may have a ``role``;
    files of the role evidence are verified and not returned.
    """
    bad = verify(files, manifest).select(capture_of(F.col("path")).alias("_capture")).distinct()
    listed = manifest.select("path", "bytes", "sha256", "git_blob_sha", F.col("role") if "role" in manifest.columns else F.lit("data").alias("role"))
    # Captures are few and large: they are kept out among the entries, and contents are dealt out by path alone.
    kept = listed.where("role = 'data'").withColumn("_capture", capture_of(F.col("path"))).join(bad, "_capture", "left_anti").drop("_capture")
    bound = files.select("path", "content").join(kept, "path")
    now = differs(F.col("bytes"), F.col("sha256"), F.col("git_blob_sha"), F.col("content"))
    changed = F.raise_error(F.concat(F.lit("capture changed while it was read: "), F.col("path"))).cast("binary")
    content = F.when(now.isNull(), F.col("content")).otherwise(changed)
    return bound.select("path", content.alias("content"))


def require_trusted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, content`` of data files; any problem of any file stops the job before a row is parsed."""
    found = verify(files, manifest).agg(F.concat_ws(", ", F.count("*").cast("string"), F.min(F.concat_ws(":", "path", "problem"))).alias("m"), F.count("*").alias("n"))
    said = found.where("n > 0").select("m").scalar()
    checked = F.when(said.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("capture not verified: "), said)).cast("boolean"))
    return trusted(files.where(checked), manifest)


def parse_file(path: str, content: bytes) -> list[tuple]:
    """Rows of one file with record numbers (the header is 1) and physical lines."""
    try:
        reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True)
        header = next(reader, [])
        if len(set(header)) != len(header) or not set(REQUIRED) <= set(header):
            raise CaptureError(f"missing or repeated columns: {path}")
        places = [header.index(c) for c in REQUIRED]
        rows, line = [], reader.line_num
        for number, row in enumerate(reader, 2):
            fields = [row[p] for p in places] if len(row) == len(header) else [None] * len(places)
            rows.append((path, number, line + 1, reader.line_num, len(row), len(header), *fields))
            line = reader.line_num
    except (UnicodeDecodeError, csv.Error) as e:
        raise CaptureError(f"unreadable capture: {path}") from e
    return rows


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "record_number", "line_start", "line_end", "n_fields", "n_header", *REQUIRED]
    for frame in frames:
        rows, size = [], 0
        for p, c in zip(frame["path"], frame["content"], strict=True):
            # Rows are handed back by a few files, so that a worker's memory doesn't grow with the batch.
            if rows and size + len(c) > PIECE_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
            rows += parse_file(p, bytes(c))
            size += len(c)
        yield pd.DataFrame(rows, columns=names)


def scan(files: DataFrame) -> DataFrame:
    """All rows of all files."""
    return files.select("path", "content").mapInPandas(_parse, PARSED)


@F.udtf(returnType=PARSED)
class ParseCapture:
    """Rows of one file, for a lateral join in SQL."""

    def eval(self, path: str, content: bytes):
        yield from parse_file(path, bytes(content))


def register(spark: SparkSession) -> None:
    """``parse_capture(path, content)`` as a table function of SQL."""
    spark.udtf.register("parse_capture", ParseCapture)


def parsed(files: DataFrame) -> DataFrame:
    """All rows of all files by the table function; the content stays behind."""
    return files.lateralJoin(ParseCapture(F.col("path").outer(), F.col("content").outer()).toDF("file", *[p.split()[0] for p in PARSED.split(", ")[1:]])).drop(
        "content", "file"
    )


def records(judged: DataFrame, source_id: str) -> DataFrame:
    """Accepted rows as canonical records: identifiers joined, local time, where they stand, and flags of their text."""
    text = F.col("message")
    flags = F.array_compact(F.array(
        F.when(text.rlike(r"[\r\n]"), "multiline_text"),
        F.when(text != T.strip(text), "boundary_whitespace"),
        F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters"),
    ))
    return judged.where(F.size("reasons") == 0).select(
        F.concat_ws(":", F.lit(source_id), "bv_id", "rpid").alias("id"), text.alias("text"), F.col("bv_id").alias("video_id"), F.col("rpid").alias("comment_id"),
        F.col("root_rpid").alias("root_id"), F.col("parent_rpid").alias("parent_id"), F.col("ts").alias("ctime"),
        T.china_time(F.col("ts")).alias("comment_time"),
        F.struct(F.lit(source_id).alias("source_id"), "path", "record_number", "line_start", "line_end").alias("source"), flags.alias("quality_flags"),
    )


def judge(rows: DataFrame, *, before: int) -> DataFrame:
    """``rows`` with every reason against each; a row without any is accepted."""
    positive, natural = r"\A[1-9][0-9]*\z", r"\A(?:0|[1-9][0-9]*)\z"
    scientific = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]+\z"
    width = F.col("n_fields") != F.col("n_header")

    def identifier(name: str, pattern: str):
        bad = ~F.col(name).rlike(pattern)
        return F.when(bad & F.col(name).rlike(scientific), f"scientific_notation:{name}").when(bad, f"invalid_identifier:{name}")

    stamp = F.when(F.col("ctime").rlike(natural), F.expr("try_cast(ctime as bigint)"))
    checks = [
        F.when(~F.col("bv_id").rlike(r"\ABV[1-9A-HJ-NP-Za-km-z]{10}\z"), "invalid_bv_id"),
        *[identifier(c, positive if c in ("oid", "rpid") else natural) for c in ("oid", "rpid", "root_rpid", "parent_rpid")],
        F.when(stamp.isNull(), "invalid_timestamp"),
        F.when((stamp < EARLIEST) | (stamp >= before), "timestamp_out_of_range"),
        F.when(~F.col("message").rlike(r"(?U)[^\s\x{1c}-\x{1f}]"), "empty_text"),
    ]
    reasons = F.when(width, F.array(F.lit("column_count_mismatch"))).otherwise(F.array_compact(F.array(*checks)))
    return rows.withColumn("ts", stamp).withColumn("reasons", reasons)
