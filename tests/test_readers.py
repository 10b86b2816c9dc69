"""Readers, writers and streams on literal rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.sources import jsonl, resources
from lectern.streaming import reviews


def test_lines_are_written_and_read(spark, tmp_path):
    rows = [(2, "b \u0085\r x"), (1, 'a"\n'), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    jsonl.write_lines(df, f"{tmp_path}/out", order=["id"], sort_keys=True)
    lines = jsonl.read_lines(spark, f"{tmp_path}/out")
    assert sorted(r["value"] for r in lines.collect())[0] == '{"id":1,"text":"a\\"\\n"}'
    back = jsonl.strict_objects(lines).select(F.try_variant_get("object", "$.id", "long").alias("id"), F.try_variant_get("object", "$.text", "string").alias("text"), "problem")
    assert sorted(map(tuple, back.collect())) == sorted((i, t, None) for i, t in rows)
    with pytest.raises(Exception, match="already exists"):
        jsonl.write_lines(df, f"{tmp_path}/out", order=["id"])


def test_token_rows(spark):
    df = spark.sql("select 's' as text, array(named_struct('text', 'a', 'canonical', 'A', 'is_nc', true), named_struct('text', 'b', 'canonical', 'b', 'is_nc', false)) as tokens")
    assert [tuple(r) for r in resources.token_rows(df).orderBy("pos").collect()] == [("s", 0, "a", "A", True), ("s", 1, "b", "b", False)]


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_values_are_carried_down(spark, monkeypatch, stretch):
    monkeypatch.setattr(resources, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = [(n, rng.choice([None, None, None, f"v{n}"])) for n in range(40)]
    df = spark.createDataFrame(rows, "n long, v string").repartition(3)
    last, want = None, []
    for n, v in rows:
        last = v or last
        want.append((n, last))
    assert [(r["n"], r["w"]) for r in resources.carried_down(df, F.col("v"), "w").orderBy("n").collect()] == want


def stream_of(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k long, t timestamp, kind string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_first_seen_stream(spark, tmp_path):
    rows = [(k % 3, datetime(2026, 10, 1, 0, k), f"a{k}") for k in range(6)]
    reviews.run_once(reviews.first_seen_stream(stream_of(spark, tmp_path, rows), key="k", time="t"), "first_seen", f"{tmp_path}/cp", "append")
    assert sorted(r["k"] for r in spark.table("first_seen").collect()) == [0, 1, 2]


def test_windowed_counts(spark, tmp_path):
    rows = [(k, datetime(2026, 10, 1, k // 4, k), "x" if k % 2 else "y") for k in range(8)]
    reviews.run_once(reviews.windowed_counts(stream_of(spark, tmp_path, rows), time="t", kind="kind"), "counted", f"{tmp_path}/cp")
    assert sorted((r["window"]["start"].hour, r["kind"], r["n"]) for r in spark.table("counted").collect()) == [(0, "x", 2), (0, "y", 2), (1, "x", 2), (1, "y", 2)]
