"""Each of the nine checks fails alone; nothing stays eligible under a failed one."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import integrity as I


def evidence(spark, broken=None, lost=None):
    """Facts of one run where everything agrees, but for the check ``broken``; the check ``lost`` has no evidence."""
    sha = "a" * 64

    def files(k):
        return spark.createDataFrame([("r", "f", 1, sha, 1, "b" * 64 if broken == k else sha), ("r", "g", 2, sha, 2, sha)],
                                     "run string, path string, bytes long, sha256 string, found_bytes long, found_sha256 string")

    def frozen(k, name, required=()):
        rows = [("r", "d", f, sha) for f in ("cases.jsonl", "inputs.jsonl")]
        kind = "run string, dataset string, file string, sha256 string"
        return I.frozen_files(spark.createDataFrame(rows, kind), spark.createDataFrame(rows[: 1 if broken == k else 2], kind), name, required)

    clip = spark.createDataFrame([("r", "c", bytearray(b"wav"), "no" if broken == 2 else None, "t", None)], "run string, clip_id string, wav binary, wav_sha256 string, text string, text_sha256 string")
    clip = clip.withColumn("wav_sha256", F.coalesce("wav_sha256", F.sha2("wav", 256)))
    fields = spark.createDataFrame([("r", "i", ["text", "id"] + ["target"] * (broken == 5))], "run string, file string, fields array<string>")
    times = "run string, name string, read_at timestamp"
    reads = spark.createDataFrame([("r", "n", None)], times).select("run", "name", F.timestamp_seconds(F.lit(5 if broken == 6 else 20)).alias("read_at"))
    batch = reads.select("run", F.timestamp_seconds(F.lit(10)).alias("finished_at"))
    export = spark.createDataFrame([("r", "e", sha, None if broken == 7 else sha)], "run string, export string, submitted_sha256 string, current_sha256 string")
    kind = "run string, place int, id string, outputs array<string>"
    before = spark.createDataFrame([("r", 1, "a", ["x"]), ("r", 2, "b", None)], kind)
    after = spark.createDataFrame([("r", 1, "a", ["x"]), ("r", 2, "c" if broken == 8 else "b", None)], kind)
    parts = [
        I.unchanged_files(files(0), I.CHECKS[0]), I.unchanged_files(files(1), I.CHECKS[1]), I.feedback_clips(clip), frozen(3, I.CHECKS[3]),
        frozen(4, I.CHECKS[4], ("cases.jsonl", "inputs.jsonl")), I.gold_free_inputs(fields), I.read_after(reads, batch), I.export_current(export), I.readings_unchanged(before, after),
    ]
    out = None
    for k, part in enumerate(parts):
        if k != lost:
            out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("broken", [None, *range(9)])
def test_each_check_fails_alone(spark, broken):
    facts = evidence(spark, broken)
    want = "" if broken is None else I.CHECKS[broken]
    assert [tuple(r) for r in I.audit(facts).collect()] == [("r", broken is None, want)]
    assert {r["name"] for r in I.counted(facts).where("failures > 0").collect()} == ({want} if want else set())


@pytest.mark.parametrize("lost", [0, 5, 8])
def test_a_check_without_evidence_fails(spark, lost):
    assert I.audit(evidence(spark, lost=lost)).first()["failed"] == I.CHECKS[lost]


def test_a_required_file_must_be_declared(spark):
    rows = spark.createDataFrame([("r", "d", "cases.jsonl", "a" * 64)], "run string, dataset string, file string, sha256 string")
    found = {r["key"]: r["holds"] for r in I.frozen_files(rows, rows, "n", ("cases.jsonl", "inputs.jsonl")).collect()}
    assert found == {"d/cases.jsonl": True, "cases.jsonl": True, "inputs.jsonl": False}
    twice = rows.unionByName(rows.withColumn("sha256", F.lit("b" * 64)))
    assert not I.frozen_files(twice, rows, "n").first()["holds"]


def test_failed_audits_block(spark):
    items = spark.createDataFrame([("r", "1", I.RETAINED), ("r", "2", "needs_review"), ("x", "3", I.RETAINED)], "run string, id string, disposition string")
    for broken, want in ((None, [True, False, False]), (3, [False, False, False])):
        found = I.dispositions(items, I.audit(evidence(spark, broken))).orderBy("id").collect()
        assert [r["eligible"] for r in found] == want
        assert found[2]["blockers"] == ["audit_integrity_failed"] and found[1]["blockers"][0] == "needs_review"


def test_candidates(spark):
    kind = "run string, place int, id string, text string, refs array<string>"
    rows = [("r", 1, "a", "t", ["x"]), ("r", 2, "a", "t", ["x"]), ("r", 3, "b", "t", ["x"]), ("r", 4, "c", "u", ["x"]), ("r", 5, "d", "t", ["y"]), ("r", 6, "e", "t", ["x"]),
            ("r", 7, " ", "t", ["x"]), ("r", 8, "f", "t", [" "]), ("r", 9, "g", "t", ["x"]), ("r", 10, "h", None, ["x"])]
    candidates = spark.createDataFrame(rows, kind)
    kept = [("a", I.RETAINED, True), ("c", I.RETAINED, True), ("d", I.RETAINED, True), ("e", "withdrawn_for_future_use", False), ("g", I.RETAINED, False)]
    audited = spark.createDataFrame([("r", *k) for k in kept], "run string, id string, disposition string, eligible boolean")
    audited = audited.select("*", F.sha2(F.lit("t").cast("binary"), 256).alias("text_sha256"), F.sha2(F.lit('["x"]').cast("binary"), 256).alias("refs_sha256"))
    found = {(r["place"]): r["reason"] for r in I.candidate_problems(candidates, audited).collect()}
    assert found == {
        2: "duplicate_candidate_id", 3: "untracked_reference_requires_review", 4: "source_text_changed_since_audit", 5: "reference_changed_since_audit",
        6: "withdrawn_for_future_use", 7: "invalid_candidate_row", 8: "invalid_candidate_row", 9: "audit_integrity_not_verified", 10: "invalid_candidate_row",
    }


def test_metrics_of_the_plan(spark):
    from pyspark.sql import Observation

    seen = Observation("integrity")
    facts = evidence(spark, 3)
    I.audit(facts.observe(seen, F.count("*").alias("checked"), F.count_if(~F.col("holds")).alias("failures"))).collect()
    assert seen.get["failures"] == 1 and seen.get["checked"] == facts.count()
    assert I.observed(facts, "again").count() == facts.count()
