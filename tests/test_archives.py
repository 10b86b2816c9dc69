"""Stopped runs go on, changed captures stop, and layouts are told apart."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import git_blob_sha1
from lectern.plans.archives import sentences
from lectern.sources import reextract as R
from lectern.sources import runs, sinks


def capture(spark):
    rows = [(f"d{k}", f"raw/d{k}", bytearray(f"One {k}. Same here. Two {k}! tail".encode())) for k in range(12)] + [("e", "raw/e", bytearray(b""))]
    docs = spark.createDataFrame(rows, "id string, path string, content binary")
    listed = docs.select("id", "path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), git_blob_sha1(F.col("content")).alias("git_blob_sha"))
    return listed, docs


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    listed, docs = capture(spark)
    whole = rows_of(R.reextract(listed, docs, sentences, f"{tmp_path}/whole", revision="1", batches=4))
    assert len(whole) == 12 * 2 + 1 and len({r[2] for r in whole}) == len(whole)
    publish, calls = sinks.publish_json, []

    def stop(*args):
        calls.append(args)
        if len(calls) == 3:
            raise OSError("stopped")
        publish(*args)

    monkeypatch.setattr(sinks, "publish_json", stop)
    out = f"{tmp_path}/stopped"
    with pytest.raises(OSError, match="stopped"):
        R.reextract(listed, docs, sentences, out, revision="1", batches=4)
    monkeypatch.undo()
    seen = []

    def counted(texts):
        seen.append(1)
        return sentences(texts)

    assert rows_of(R.reextract(listed, docs, counted, out, revision="1", batches=4)) == whole
    assert len(seen) == 2  # the batch that was written without a receipt, and the one after it
    assert rows_of(R.reextract(listed, docs, counted, out, revision="1", batches=4)) == whole and len(seen) == 2
    # Another revision, or another capture, is another run.
    R.reextract(listed, docs, counted, out, revision="2", batches=4)
    assert len(seen) == 6
    R.reextract(listed.where("id <> 'e'"), docs, counted, out, revision="2", batches=4)
    assert len(seen) == 10


@pytest.mark.parametrize(("change", "problem"), [("bytes", "size"), ("sha256", "sha256"), ("git_blob_sha", "git_blob"), (None, "missing")])
def test_a_changed_body_stops_the_run(spark, tmp_path, change, problem):
    listed, docs = capture(spark)
    if change:
        listed = listed.withColumn(change, F.when(F.col("id") == "d3", F.lit(1 if change == "bytes" else "0")).otherwise(F.col(change)))
    else:
        docs = docs.where("id <> 'd3'")
    with pytest.raises(Exception, match=f"capture changed: raw/d3: {problem}"):
        R.reextract(listed, docs, sentences, f"{tmp_path}/out", revision="1", batches=2)


def test_nothing_to_extract(spark, tmp_path):
    listed, docs = capture(spark)
    assert R.reextract(listed.limit(0), docs, sentences, f"{tmp_path}/out", revision="1", batches=2).count() == 0
    with pytest.raises(R.CaptureChanged):
        R.result(spark, f"{tmp_path}/out", "other", 2)


def test_layouts(spark):
    import hashlib

    sha = hashlib.sha256(b"p").hexdigest()
    good = {"status": "complete", "baseline": "b", "predictions_sha256": sha}
    files = {"r0/b.jsonl": b"p", "r0/b.meta.json": b"{}", "r1/b.jsonl": b"p", "r2/b/predictions.jsonl": b"p", "r2/b/run.json": json.dumps(good).encode(),
             "r3/b/predictions.jsonl": b"p", "r4/b/predictions.jsonl": b"p", "r4/b/run.json": b"{", "r5/b/predictions.jsonl": b"p",
             "r5/b/run.json": json.dumps(good | {"model_manifest_file": "model_manifest.json", "model_manifest_sha256": sha}).encode(), "r5/b/model_manifest.json": b"p",
             "r6/b/predictions.jsonl": b"p", "r6/b/run.json": json.dumps(good | {"model_manifest_file": "model_manifest.json", "model_manifest_sha256": sha}).encode(),
             "r7/b/run.json": json.dumps(good).encode(), "r8/a/b/c/predictions.jsonl": b"p", "r9/readme.txt": b"p"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    found = {r["run"]: (r["layout"], r["problem"]) for r in runs.discover(df).collect()}
    assert found == {
        "r0": ("legacy", None), "r1": ("legacy", "missing_metadata"), "r2": ("wrapped", None), "r3": ("wrapped", "incomplete"), "r4": ("wrapped", "incomplete"),
        "r5": ("wrapped", None), "r6": ("wrapped", "evidence_differs:model_manifest_file"),
    }


def test_snapshots(spark, tmp_path):
    _, docs = capture(spark)
    runs.snapshot(docs, f"{tmp_path}/s")
    assert runs.snapshot_problems(spark, docs, f"{tmp_path}/s").count() == 0
    changed = docs.where("id <> 'd1'").withColumn("content", F.when(F.col("id") == "d2", F.lit(b"x")).otherwise(F.col("content")))
    assert {tuple(r) for r in runs.snapshot_problems(spark, changed, f"{tmp_path}/s").collect()} == {("raw/d1", "extra"), ("raw/d2", "changed")}
    with pytest.raises(Exception, match="already exists"):
        runs.snapshot(docs, f"{tmp_path}/s")
