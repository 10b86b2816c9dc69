"""Batches of texts are worked off in pieces, with the same rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.policies import columns as P


def test_pieces_hold_few_texts():
    texts = [None, "", *("一" * 1000 for _ in range(500)), "x" * (3 * P.PIECE_BYTES), "y"]
    own = list(P.pieces([(pa.array(texts), pa.array(texts)), (pa.array([], pa.string()),) * 2]))
    assert [t for piece in own for t in piece[0]] == texts and all(a == b for a, b in own)
    sizes = [sum(len((t or "").encode()) for t in a + b) for a, b in own]
    assert all(n <= P.PIECE_BYTES or len(piece[0]) == 1 for n, piece in zip(sizes, own, strict=True))
    assert len(own) > 20


@pytest.mark.parametrize("name", ["reading", "context_v3", "audited"])
def test_a_policy_hands_back_every_piece(spark, monkeypatch, name):
    """One batch of many texts, nulls among them, against the policy itself; results come in more than one piece."""
    monkeypatch.setattr(P, "PIECE_BYTES", 64)
    texts = [None if k % 7 == 0 else f"用JDK{k}和API word{k} u1s1 985高校" * (k % 3) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {r.k: r.r for r in rows.select("k", P.policy(name)(F.col("t")).alias("r")).collect()}
    for k, t in enumerate(texts):
        want = P._STAGES[name](t) if t is not None else dict.fromkeys(P.RESULT.fieldNames())
        assert got[k].asDict(recursive=True) == want


def test_policies_in_one_function_are_those_one_by_one(spark):
    stages = {"comment": "comment_v2", "semantic": "semantic", "reading": "reading", "context": "context_v3"}
    texts = [None, "", "回复 @用户1：好 [微笑]一把🔨，像🐶一样😊；JDK8用API，u1s1 985高校、211本科，学费211元。"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", P.policies(stages)(F.col("t")).alias("r")).collect():
        text = r.t
        for name, own in stages.items():
            want = P._STAGES[own](text) if text is not None else dict.fromkeys(P.RESULT.fieldNames())
            assert r.r[name].asDict(recursive=True) == want
            text = want["text"]


def test_chain_of_policies_has_one_worker(spark):
    from lectern.plans import models

    plan = models.chain_edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_prose_and_captures_are_handed_back_in_pieces(spark, monkeypatch):
    """Rows of a batch come by a few, all of them and in order."""
    import pandas as pd

    from lectern.sources import capture, prose

    head = ",".join(capture.REQUIRED)
    body = ",".join("1" for _ in capture.REQUIRED)
    files = pd.DataFrame({"path": [f"p{k}" for k in range(9)], "content": [f"{head}\n{body}\n".encode()] * 9})
    whole = pd.concat(capture._parse(iter([files])), ignore_index=True)
    monkeypatch.setattr(capture, "PIECE_BYTES", 3 * len(files["content"][0]))
    parts = list(capture._parse(iter([files])))
    assert [len(p) for p in parts] == [3, 3, 3] and pd.concat(parts, ignore_index=True).equals(whole)

    monkeypatch.setattr(prose, "PIECE_ROWS", 4)
    docs = spark.createDataFrame([(k, None if k == 3 else "This is a sentence. " * k) for k in range(12)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.start) for r in prose.prose_sentences(docs, ends=".", least_han=0).collect())
    want = [(k, x[3]) for k in range(12) if k != 3 for x in prose.extract("This is a sentence. " * k, ends=".", least_han=0)]
    assert got == sorted(want) and len(got) > 50


@pytest.mark.parametrize("step", [T._nfc, T.casefold, T.normalized_key, T._squeezed])
def test_text_functions_hand_texts_back_in_pieces(step):
    texts = [None, *["\u0130" * 1000] * 500]
    got = list(step.func(iter([pa.array(texts)])))
    assert max(map(len, got)) < 100 and sum(map(len, got)) == 501
    assert [x is None for g in got for x in g.to_pylist()] == [True] + [False] * 500


def test_lists_of_texts_are_handed_back_in_pieces():
    lists = [None, [], [None, "e\u0301"], *[["e\u0301" * 1000] * 10] * 50]
    got = list(T._nfc_each.func(iter([pa.array(lists)])))
    assert len(got) > 5
    assert [x for g in got for x in g.to_pylist()] == [None, [], [None, "\u00e9"], *[["\u00e9" * 1000] * 10] * 50]
