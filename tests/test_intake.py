"""Captures and packages: nothing is read that isn't bound."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import intake
from lectern.sources import capture, package, sinks

HEADER = "bv_id,oid,rpid,root_rpid,parent_rpid,ctime,message\n"


def captures(spark, **wrong):
    """Three files in two captures; ``wrong`` replaces a column of the manifest's entry for b/2."""
    files = [(p, bytearray((HEADER + f'BV1aaaaaaaaa,7,{k},0,0,1600000000,"line\n{k}"\n').encode())) for k, p in enumerate(("a/1", "b/1", "b/2"), 1)]
    df = spark.createDataFrame(files, "path string, content binary")
    listed = df.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), T.git_blob_sha1(F.col("content")).alias("git_blob_sha"))
    for name, value in wrong.items():
        listed = listed.withColumn(name, F.when(F.col("path") == "b/2", F.lit(value)).otherwise(F.col(name)))
    return df, listed


@pytest.mark.parametrize(("wrong", "problem"), [({"bytes": 5}, "size"), ({"sha256": "0" * 64}, "sha256"), ({"git_blob_sha": "0" * 40}, "git_blob"),
                                                ({"sha256": "x"}, "bad_entry"), ({"bytes": -1}, "bad_entry")])
def test_one_bad_file_keeps_its_capture_out(spark, wrong, problem):
    files, listed = captures(spark, **wrong)
    assert [tuple(r) for r in capture.verify(files, listed).collect()] == [("b/2", problem)]
    assert {r["path"] for r in capture.parsed(capture.trusted(files, listed)).collect()} == {"a/1"}
    with pytest.raises(Exception, match="capture not verified: 1, b/2:" + problem):
        capture.scan(capture.require_trusted(files, listed)).collect()


def test_unlisted_missing_and_unsafe(spark):
    files, listed = captures(spark)
    found = {tuple(r) for r in capture.verify(files.where("path <> 'a/1'"), listed.where("path <> 'b/1'")).collect()}
    assert found == {("a/1", "missing"), ("b/1", "unlisted")}
    assert capture.trusted(files.where("path <> 'a/1'"), listed.where("path <> 'b/1'")).count() == 0
    moved = listed.withColumn("path", F.when(F.col("path") == "a/1", "a/../b/1").otherwise(F.col("path")))
    assert ("a/../b/1", "unsafe_path") in {tuple(r) for r in capture.verify(files, moved).collect()}


def test_verified_captures_become_records(spark):
    files, listed = captures(spark)
    rows = capture.require_trusted(files, listed.withColumn("role", F.when(F.col("path") == "b/1", "evidence").otherwise("data")))
    found = capture.records(capture.judge(capture.parsed(rows), before=1_700_000_000), "s").orderBy("id").collect()
    assert [(r["id"], r["text"], r["source"]["path"], r["source"]["line_start"], r["source"]["line_end"], r["quality_flags"]) for r in found] == [
        ("s:BV1aaaaaaaaa:1", "line\n1", "a/1", 2, 3, ["multiline_text"]),
        ("s:BV1aaaaaaaaa:3", "line\n3", "b/2", 2, 3, ["multiline_text"]),
    ]
    assert found[0]["comment_time"] == "2020-09-13T20:26:40+08:00"
    assert capture.scan(files).count() == capture.parsed(files).count() == 3


def test_table_function_in_sql(spark):
    files, _ = captures(spark)
    capture.register(spark)
    files.createOrReplaceTempView("capture_files")
    rows = spark.sql("select p.rpid, p.line_end from capture_files f, lateral parse_capture(f.path, f.content) p order by 1").collect()
    assert [tuple(r) for r in rows] == [("1", 3), ("2", 3), ("3", 3)]


def test_identifiers(spark):
    rows = [("BV1aaaaaaaaa", "7", ".5e3", "0", "0", "1600000000", "x"), ("BV1aaaaaaaa0", "+1E2", "1", "0", "-1", "x", " ")]
    body = HEADER + "".join(",".join(r) + "\n" for r in rows)
    df = spark.createDataFrame([("f", bytearray(body.encode()))], "path string, content binary")
    got = [r["reasons"] for r in capture.judge(capture.scan(df), before=1_700_000_000).orderBy("record_number").collect()]
    assert got == [["scientific_notation:rpid"], ["invalid_bv_id", "scientific_notation:oid", "invalid_identifier:parent_rpid", "invalid_timestamp", "empty_text"]]


def versions(spark, tmp_path):
    target = f"{tmp_path}/package"
    old, new = (spark.createDataFrame([(f"{v}{k}", f"text {v} {k}") for k in range(4)], "id string, text string") for v in ("o", "n"))
    package.publish(spark, target, {"train": old, "validation": old.limit(1)}, {"revision": 1})
    return target, old, new


def ids(spark, target):
    return sorted(r["id"] for r in package.read(spark, target, "train")["train"].collect())


STEPS = ("table", "manifest", "pointer", "rename")


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_leaves_the_old_package(spark, tmp_path, monkeypatch, step):
    target, _, new = versions(spark, tmp_path)

    def crash(*args, **kwargs):
        raise OSError("lost")

    if step == "table":
        new = new.withColumn("text", F.raise_error(F.lit("lost")))
    elif step == "manifest":
        monkeypatch.setattr(package, "_files", crash)
    elif step == "pointer":
        monkeypatch.setattr(sinks, "publish_json", crash)
    else:
        monkeypatch.setattr(sinks, "replace", crash)
    with pytest.raises(Exception, match="lost"):
        package.publish(spark, target, {"train": new, "validation": new}, {"revision": 2})
    monkeypatch.undo()
    assert ids(spark, target) == ["o0", "o1", "o2", "o3"]
    _, _, new = versions(spark, tmp_path / "other")
    package.publish(spark, target, {"train": new, "validation": new.limit(1)}, {"revision": 3})
    assert ids(spark, target) == ["n0", "n1", "n2", "n3"]


@pytest.mark.parametrize("change", ["edit", "remove", "add", "manifest"])
def test_only_what_is_bound_is_read(spark, tmp_path, change):
    target, old, _ = versions(spark, tmp_path)
    version = package.current_of(spark, target)["version"]
    folder = tmp_path / "package" / "versions" / version
    file = next(p for p in (folder / "validation").iterdir() if p.name.startswith("part"))
    if change == "edit":
        file.write_bytes(file.read_bytes() + b"x")
    elif change == "remove":
        file.unlink()
    elif change == "add":
        old.write.mode("append").parquet(f"{folder}/train")
    else:
        spark.range(1).selectExpr("'a' as path", "1L as bytes", "'b' as sha256").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    # A fault in either table keeps both from being read.
    with pytest.raises(Exception, match="Checksum" if change == "edit" else None) as e:
        package.read(spark, target, "train")
    assert change == "edit" or e.type is package.PackageError


def test_unknown_table_and_no_package(spark, tmp_path):
    target, _, _ = versions(spark, tmp_path)
    with pytest.raises(package.PackageError, match="no table extra"):
        package.read(spark, target, "extra")
    with pytest.raises(Exception, match="current.json"):
        package.read(spark, f"{tmp_path}/none", "train")


def test_registered_training(spark, tmp_path):
    from lectern.operators import validation as V

    def rows(role, n):
        return spark.createDataFrame([(f"{role}{k}", f"{role} text {k}", "t", ["t"], "core_tn", "f", f"{role}{k}", {"origin": "own", "assigned_role": role}) for k in range(n)],
            "id string, text string, target string, acceptable_outputs array<string>, track string, family string, group_id string, provenance map<string,string>")

    target = f"{tmp_path}/training"
    package.publish(spark, target, {r: rows(r, 3) for r in V.ROLES} | {"pending": rows("pending", 1)}, {})
    assert package.registered_training(spark, target, {"origin": "own"}).groupBy("role").count().count() == 2
    package.publish(spark, target, {r: rows("train", 3) for r in V.ROLES}, {})
    with pytest.raises(package.PackageError):
        package.registered_training(spark, target, {"origin": "own"})


def test_publishing_replaces_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/doc.json"
    sinks.publish_json(spark, path, {"a": 1})
    sinks.publish_json(spark, path, {"a": 2})
    assert sinks.read_json(spark, path) == {"a": 2}
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["doc.json"]
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeated key"):
        sinks.read_json(spark, f"{tmp_path}/twice.json")


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_no_content_is_dealt_out_by_capture_or_language(spark):
    files, listed = intake._captures(spark, "/root/testdata/sf0.001")
    for df, key in ((capture.trusted(files, listed), "_capture"), (listed, "lang")):
        joins = [n for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and f"({key}#" in n.simpleString(1000)]
        assert joins and not any("content" in n.output().mkString(",") for n in joins)


def test_a_manifest_is_made_by_more_than_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda *_: pytest.fail("all files in one task"))
    package.publish(spark, str(tmp_path / "p"), {"a": spark.range(40).repartition(4), "b": spark.range(0)}, {})
    assert package.read(spark, str(tmp_path / "p"), "a")["a"].count() == 40
