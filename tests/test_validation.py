"""Rules of cases, annotations, samples and runs on literal rows, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import validation as V

CASE = "id string, text string, family string, track string, refs array<string>"
SPANS = "array<struct<start:int,end:int,source:string,outputs:array<string>>>"


def found(df):
    return {tuple(r) for r in df.select("id", "problem").collect()}


def test_cases(spark):
    rows = [
        ("a", "x  1", "f", "preservation", ["x 1"]),
        ("b", "x", "f", "preservation", ["y"]),
        ("b", "x", "f", "core_tn", ["y"]),
        (None, "x", "f", "core_tn", None),
        ("", "x", None, "core_tn", ["　"]),
    ]
    assert found(V.case_problems(spark.createDataFrame(rows, CASE))) == {
        ("b", "preservation_changes"), ("b", "repeated_id"), (None, "missing_id"), (None, "bad_references"),
        ("", "missing_id"), ("", "bad_references"), ("", "missing_field"),
    }
    assert found(V.case_problems(spark.createDataFrame([], CASE))) == {(None, "no_cases")}


def test_annotations(spark):
    schema = f"id string, text string, refs array<string>, targets {SPANS}, protected array<struct<start:int,end:int,text:string>>"
    rows = [
        ("good", "a1b", ["aoneb"], [(1, 2, "1", ["one"])], [(0, 1, "a")]),
        ("none", "a1b", [], [], []),
        ("null", "a1b", None, None, None),
        ("apart", "a1b", ["x"], [(1, 2, "1", ["one"]), (1, 3, "1b", ["y"])], []),
        ("past", "a1b", ["x"], [(2, 4, "b", ["y"])], []),
        ("other", "a1b", ["x"], [(1, 2, "1", ["one"])], [(0, 1, "b"), (2, 2, "")]),
        ("empty", "a1b", ["x"], [(1, 2, "1", [])], []),
    ]
    assert found(V.annotation_problems(spark.createDataFrame(rows, schema))) == {
        ("apart", "bad_offsets"), ("past", "bad_offsets"), ("other", "replay_differs"), ("other", "bad_protected"), ("empty", "no_replacement"),
    }


def test_integrity_needs_every_check(spark):
    rows = [(1, "a", True), (1, "b", True), (2, "a", True), (3, "a", None), (3, "b", True), (4, "c", True)]
    got = V.integrity(spark.createDataFrame(rows, "run int, name string, holds boolean"), ("b", "a"))
    assert {tuple(r) for r in got.collect()} == {(1, True, ""), (2, False, "b"), (3, False, "a"), (4, False, "a,b")}


def test_accepted_sets_meet(spark):
    rows = [("k", ["a", "b"]), ("k", ["b", "c"]), ("k", ["d"]), ("m", ["a", None]), ("n", None), (None, ["a"]), ("k", ["d"])]
    got = V.alternative_groups(spark.createDataFrame(rows, "key string, accepted array<string>"))
    assert {tuple(r) for r in got.collect()} == {("k", 4, 2), ("m", 1, 1)}


def test_squeezed_is_the_same_natively(spark):
    texts = ["A b\x1cC\t", "Ｆ　ull ß", "", None, "İ", "\x85x"]
    import unicodedata

    want = [None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.s for r in df.select("i", T.squeezed(F.col("t")).alias("s")).orderBy("i").collect()] == want


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, []), ({"until": "2026-01-01"}, ["since_not_before_until"]), ({"seed": True}, ["not_whole:seed"]), ({"controls": -1}, ["negative:controls"]),
     ({"candidates": 0, "controls": 0}, ["empty_sample"])],
)
def test_sampling_configuration(change, want):
    config = {"since": "2026-01-01", "until": "2026-02-01", "seed": -1, "candidates": 3, "controls": 0} | change
    assert V.sampling_problems(config) == want
