"""The model slot, chains of stages and what is taken of a model's answers."""

import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from lectern.operators import chains as C
from lectern.operators import slot
from lectern.operators.policies import audited, columns
from lectern.operators.policies.tables import resources


@dataclass(frozen=True)
class Shout:
    """Upper case; fails on what holds ``bad``, gives too little on ``few``, stops on ``long``."""

    folder: str
    name: str = "shout"
    revision: str = "1"

    def load(self):
        import os
        import uuid

        open(f"{self.folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def infer(texts):
            open(f"{self.folder}/call-{uuid.uuid4().hex}", "w").write(str([len(t) for t in texts]))
            if any("device lost" in t for t in texts):
                raise slot.Fatal("device lost")
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            if any("few" in t for t in texts):
                return []
            return [slot.Answer(t.upper(), t.upper() if "void" not in t else " ", "long" not in t, len(t), len(t)) for t in texts]

        return infer


def test_slot(spark, tmp_path):
    texts = ["plain", "", None, " \n", "bad one", "few", "long one", "void", "plain", "x" * 20_000, *[f"t{k}" for k in range(150)]]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string").repartition(2)
    got = {r["id"]: r for r in slot.predict(df, Shout(str(tmp_path))).collect()}
    assert len(got) == len(texts)
    want = {"0": "ok", "1": slot.SKIPPED, "2": slot.SKIPPED, "3": slot.SKIPPED, "4": "error", "5": "error", "6": "truncated", "7": "empty_output", "8": "ok", "9": "ok"}
    assert {k: got[k]["status"] for k in want} == want
    assert all(got[str(k)]["prediction"] == f"T{k - 10}" for k in range(10, 160))
    assert (got["4"]["error_type"], got["4"]["error"], got["5"]["error_type"]) == ("ValueError", "bad text", "TypeError")
    assert (got["6"]["prediction"], got["6"]["raw_output"], got["6"]["generated_tokens"]) == ("", "LONG ONE", 8)
    calls = [eval(p.read_text()) for p in tmp_path.iterdir() if p.name.startswith("call")]
    assert max(map(len, calls)) > 10 and all(len(c) == 1 or max(c) * len(c) <= slot.BATCH_CHARS and len(c) <= slot.BATCH_TEXTS for c in calls)
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir() if p.name.startswith("load")]
    assert len(loads) == len(set(loads))


def test_slot_refuses_more_than_text(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "ref")], "id string, text string, reference string")
    with pytest.raises(ValueError, match="nothing else"):
        slot.predict(df, Shout(str(tmp_path)))
    with pytest.raises(ValueError, match="nothing else"):
        slot.predict(df.selectExpr("cast(id as long) as id", "text"), Shout(str(tmp_path)))
    assert slot.predict(df.select("text", "id").limit(0), Shout(str(tmp_path))).count() == 0
    assert not list(tmp_path.iterdir())


def test_a_fatal_error_fails_the_task(spark, tmp_path):
    df = spark.createDataFrame([("1", "device lost"), ("2", "x")], "id string, text string")
    with pytest.raises(Exception, match="device lost"):
        slot.predict(df, Shout(str(tmp_path))).collect()


def test_batches_go_by_length():
    texts = ["a" * n for n in (1, 9000, 3, 9000, 2)] + [None, " "]
    assert list(slot.batches(texts)) == [[0, 4, 2], [1], [3]]


def random_edits(rng, text):
    """Edits of a text, apart and in order, and what they make of it."""
    cuts = sorted(rng.sample(range(len(text) + 1), min((len(text) + 1) // 2, rng.randrange(0, 4)) * 2))
    out, at, edits = [], 0, []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        said = "".join(rng.choice("xyz😊") for _ in range(rng.randrange(0, 4)))
        edits.append((a, b, text[a:b], said, "r"))
        out += [text[at:a], said]
        at = b
    return edits, "".join(out) + text[at:]


STAGE = "struct<text:string,edits:array<struct<start:int,end:int,original:string,replacement:string,reason:string>>,warnings:array<string>,protected:array<struct<start:int,end:int>>,policy_version:string>"


def given(spark, rows, n):
    """Rows of a source and of ``n`` stages' results, and stages that hand them out."""
    df = spark.createDataFrame(rows, f"id int, text string, {', '.join(f's{k} {STAGE}' for k in range(n))}")
    return df.withColumnsRenamed({f"s{k}": f"given{k}" for k in range(n)}), {f"s{k}": (lambda _, k=k: F.col(f"given{k}")) for k in range(n)}


def test_composed_edits_replay(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        text = first = "".join(rng.choice("abc字") for _ in range(rng.randrange(0, 12)))
        stages = []
        for _ in range(3):
            edits, text = random_edits(rng, text)
            stages.append((text, edits, [], [], "v"))
        rows.append((i, first, *stages))
    df, stages = given(spark, rows, 3)
    found = C.run_stages(df, stages)
    back = found.select("id", "final", "problem", C.S.replay(F.col("text"), F.col("edits")).alias("again"), "edits", "text").collect()
    for r in back:
        want = rows[r["id"]][4][0]
        assert (r["problem"], r["final"], r["again"]) == (None, want, want)
        assert all(r["text"][e["start"] : e["end"]] == e["original"] and e["original"] != e["replacement"] for e in r["edits"])


def test_stages_that_do_not_replay_are_rows(spark):
    fine = ("xb", [(0, 1, "a", "x", "r")], [], [], "v")
    bad = {
        "no_text": (None, [], [], [], "v"),
        "no_lists": ("ab", None, [], [], "v"),
        "no_version": ("ab", [], [], [], ""),
        "bad_coordinates": ("xb", [(0, 3, "ab", "x", "r")], [], [], "v"),
        "original_differs": ("xb", [(0, 1, "b", "x", "r")], [], [], "v"),
        "replay_differs": ("xx", [(0, 1, "a", "x", "r")], [], [], "v"),
    }
    order = ("xyb", [(0, 1, "a", "x", "r"), (0, 1, "a", "y", "r")], [], [], "v")
    rows = [(k, "ab", stage, ("zb", [(0, 1, "x", "z", "r")], [], [], "v")) for k, stage in enumerate([fine, *bad.values(), order])]
    rows.append((9, None, (None, None, None, None, None), (None, None, None, None, None)))
    cut = ("xb", [(0, 1, "a", "x", "r")], [], [(0, 2)], "v")
    rows.append((10, "ab", cut, ("b", [(0, 1, "x", "", "r")], [], [], "v")))
    df, stages = given(spark, rows, 2)
    got = {r["id"]: (r["problem"], r["final"], r["edits"]) for r in C.run_stages(df, stages).collect()}
    assert got[0][:2] == (None, "zb") and [tuple(e) for e in got[0][2]] == [(0, 1, "a", "z")]
    assert [got[k][0] for k in range(1, 8)] == [f"s0:{x}" for x in [*bad, "bad_coordinates"]]
    assert all(got[k][1:] == (None, None) for k in range(1, 8))
    assert got[9] == (None, None, None) and got[10] == ("s1:cuts_protected", None, None)


def test_policy_chain_as_columns(spark):
    """The chain on DataFrames gives the texts and protected spans of the row-wise chain, and edits that lead there."""
    texts = ["回复 @甲：JDK17一把🔨，u1s1 985高校[微笑]", "学费211元，像🐶一样。", "", "plain 12 text", "用API 3.14 版本 https://a.b/c?d=1", "回复 @乙：[微笑]"]
    stages = {n: columns.policy(p) for n, p in (("comment", "comment_v2"), ("semantic", "semantic"), ("reading", "reading"), ("context", "context_v3"))}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in C.run_stages(df, stages).withColumn("again", C.S.replay(F.col("text"), F.col("edits"))).collect():
        final, spans, _ = audited.chained(texts[r["id"]], resources(), 3, True)
        assert (r["problem"], r["final"], r["again"], [tuple(s) for s in r["protected"]]) == (None, final, final, list(spans))


def test_native_rule(spark):
    step = C.rule(r"[0-9]+", "$1\\", "number", "v")
    row = spark.createDataFrame([("a1\n22😊3",)], "text string").select(step(F.col("text")).alias("r")).select("r.*").first()
    assert row["text"] == "a$1\\\n$1\\😊$1\\" and [tuple(e)[:3] for e in row["edits"]] == [(1, 2, "1"), (3, 5, "22"), (6, 7, "3")]


def test_merge(spark):
    rules = spark.createDataFrame([(c, " " if c == "a" else "t") for c in "abcdef"] + [("g", None)], "id string, rules_prediction string")
    answers = [("b", "p", "raw", "ok"), ("c", "p", "no", "ok"), ("d", "", "raw", "truncated"), ("e", "p", "raw", "ok"), ("e", "q", "raw", "ok")]
    df = spark.createDataFrame(answers, "id string, prediction string, raw_output string, status string")
    reasons = F.when(F.col("raw_output") == "no", F.array(F.lit("refused"))).otherwise(F.array().cast("array<string>"))
    got = {r["id"]: (r["status"], r["tn_status"], r["prediction"]) for r in C.merge_model(rules, df, reasons).collect()}
    assert got == {
        "a": ("empty_after_policy", "not_run_empty_after_policy", " "), "b": ("ok", "ok", "p"), "c": ("tn_guard_rejected", "ok", "t"),
        "d": ("truncated", "truncated", ""), "e": ("repeated_answer", "repeated_answer", "p") if got["e"][2] == "p" else ("repeated_answer", "repeated_answer", "q"),
        "f": ("missing", "missing", ""), "g": ("not_run", "not_run_empty_after_policy", None),
    }


def test_versions(spark):
    df = spark.createDataFrame([(1, ("v1",)), (2, ("v2",)), (3, ("v1",))], "id int, s struct<policy_version:string>")
    assert [tuple(r) for r in C.versions(df, ["s"]).collect()] == [("s", 2)]
