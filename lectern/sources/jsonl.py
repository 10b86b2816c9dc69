"""JSON lines: strict reading and byte-exact writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import escape_separators, strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines that end at LF alone, so other separators stay data."""
    return spark.read.option("lineSep", "\n").text(path)


def strict_objects(lines: DataFrame) -> DataFrame:
    """``value, object, problem``: repeated keys, NaN and anything but an object are problems."""
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    problem = F.when(parsed.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object")
    return lines.select("value", parsed.alias("object"), problem.alias("problem"))


def inference_inputs(lines: DataFrame) -> DataFrame:
    """``id, text, problem``: exactly these two fields, ids once, texts not blank."""
    row = strict_objects(lines)
    fields = F.array_sort(F.json_object_keys("value"))
    out = row.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.text").alias("text"),
        F.coalesce("problem", F.when(fields != F.array(F.lit("id"), F.lit("text")), "unexpected_fields")).alias("problem"),
    )
    many = out.groupBy(F.col("id").alias("own")).agg(F.count("*").alias("n"))
    checked = out.join(many, F.col("id").eqNullSafe(F.col("own")), "left")
    blank = F.coalesce(strip(F.col("id")) == "", F.lit(True)) | F.coalesce(strip(F.col("text")) == "", F.lit(True))
    problem = F.coalesce("problem", F.when(blank, "blank_field").when(F.col("n") > 1, "duplicate_id"))
    return checked.select("id", "text", problem.alias("problem"))


def to_lines(df: DataFrame, *, sort_keys: bool = False) -> DataFrame:
    """``value``: one compact JSON object a row, without characters that readers take for line ends."""
    names = sorted(df.columns) if sort_keys else df.columns
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.select(escape_separators(line).alias("value"))


def write_lines(df: DataFrame, path: str, *, order: list[str], sort_keys: bool = False) -> None:
    """New files only; rows in a stated order within and across them."""
    ordered = df.orderBy(*order)
    to_lines(ordered, sort_keys=sort_keys).write.mode("errorifexists").option("lineSep", "\n").text(path)


def _canonical(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        text = [json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, allow_nan=False) + "\n" for v in frame["value"]]
        yield pd.DataFrame({"id": frame["id"], "canonical": text})


def canonical_hashes(rows: DataFrame) -> DataFrame:
    """``id, sha256`` of each JSON text with sorted keys and spaced separators, one line end after it."""
    shaped = rows.select(F.col("id").cast("string").alias("id"), "value").mapInPandas(_canonical, "id string, canonical string")
    return shaped.select("id", F.sha2(F.col("canonical").cast("binary"), 256).alias("sha256"))
