"""A row, with its path, for each fault of an envelope, its items and their audits."""

import hashlib
import json
from copy import deepcopy

import pytest

from lectern.operators import suggestions as S

CONTRACT = S.Contract("assistant", ("v1",), ("v3", "v5", "v6"), ("v5", "v6"))
TEXT = "看aa😊aa!"
SHA = hashlib.sha256(TEXT.encode()).hexdigest()


def span(**more):
    return {"start": 1, "end": 3, "surface": "aa", "occurrence": 1, "mode": "letters_en", "reading": "x", "reason": "y"} | more


def item(id_="a", **more):
    audit = {"status": "needs_reading_annotation", "summary": "s", "spans": [span(), span(start=4, end=6, occurrence=2)], "issues": []}
    return {"id": id_, "text_sha256": SHA, "decision": "edit", "acceptable_outputs": ["said"], "track": "core_tn", "family": "f", "context_required": False,
            "reason": "because", "flags": ["f"], "reading_audit": audit} | more


def envelope(*items, **more):
    return {"schema_version": 2, "prepared_manifest_sha256": "m", "generator": "assistant", "human_reviewed": False, "policy_version": "v6",
            "created_at_utc": "2026-10-01T00:00:00Z", "items": list(items)} | more


def audited(**more):
    own = item()
    own["reading_audit"] |= more
    return own


def without(own, *names):
    return {k: v for k, v in own.items() if k not in names}


CASES = [
    (envelope(item(), item("b")), []),
    (envelope(), []),
    (envelope(without(item(decision="keep", track="preservation", acceptable_outputs=[TEXT]), "reading_audit"), schema_version=1, policy_version="v1"), []),
    (envelope(item(), schema_version=1), [("$.schema_version", "not_of_policy")]),
    (envelope(item(), schema_version="2"), [("$.schema_version", "not_integer")]),
    (envelope(item(), schema_version=2.5), [("$.schema_version", "not_integer")]),
    (envelope(item(), human_reviewed=True), [("$.human_reviewed", "not_false")]),
    (envelope(item(), human_reviewed=0), [("$.human_reviewed", "not_false")]),
    (envelope(item(), generator="other"), [("$.generator", "unknown_generator")]),
    (envelope(item(), prepared_manifest_sha256="n"), [("$.prepared_manifest_sha256", "other_package")]),
    (envelope(item(), created_at_utc="2026-10-01T00:00:00+08:00"), [("$.created_at_utc", "not_utc_time")]),
    (envelope(item(), created_at_utc="2026-13-01T00:00:00Z"), [("$.created_at_utc", "not_utc_time")]),
    (envelope(item(), created_at_utc=5), [("$.created_at_utc", "not_utc_time")]),
    (envelope(item(), created_at_utc="2026-10-01T00:00:00.123+00:00"), []),
    (envelope(items={"a": 1}), [("$.items", "not_a_list")]),
    (envelope(item(), extra=1), [("$", "fields")]),
    (without(envelope(item()), "generator"), [("$", "fields")]),
    ([1], [("$", "fields")]),
    (None, [("$", "fields")]),
    ('{"a":', [("$", "invalid_json")]),
    ('{"items": 1, "items": 2}', [("$", "invalid_json")]),
    (envelope(5), [("$.items[0]", "fields")]),
    (envelope(without(item(), "flags")), [("$.items[0]", "fields")]),
    (envelope(item("z")), [("$.items[0].id", "unknown_id")]),
    (envelope(item(), item()), [("$.items[1].id", "duplicate_id")]),
    (envelope(item(text_sha256="0")), [("$.items[0].text_sha256", "text_differs")]),
    (envelope(item(decision="maybe")), [("$.items[0].decision", "unknown")]),
    (envelope(item(decision=1)), [("$.items[0].decision", "unknown")]),
    (envelope(item(track="other")), [("$.items[0].track", "unknown")]),
    (envelope(item(family=None)), [("$.items[0].family", "not_text")]),
    (envelope(item(family=" ")), [("$.items[0]", "missing_family")]),
    (envelope(item(context_required="no")), [("$.items[0].context_required", "not_boolean")]),
    (envelope(item(context_required=True)), [("$.items[0]", "context_required")]),
    (envelope(item(reason=" ")), [("$.items[0].reason", "blank")]),
    (envelope(item(flags=["x", ""])), [("$.items[0].flags", "not_texts")]),
    (envelope(item(flags="x")), [("$.items[0].flags", "not_texts")]),
    (envelope(item(acceptable_outputs=[1])), [("$.items[0].acceptable_outputs", "not_texts")]),
    (envelope(item(acceptable_outputs=[])), [("$.items[0]", "missing_outputs")]),
    (envelope(item(decision="keep")), [("$.items[0]", "keep_changes_text")]),
    (envelope(item(track="preservation", acceptable_outputs=[TEXT])), [("$.items[0]", "edit_as_preservation")]),
    (envelope(item(decision="excluded", track="", family="", acceptable_outputs=[])), []),
    (envelope(item(reading_audit=5)), [("$.items[0].reading_audit", "fields")]),
    (envelope(audited(status="fine")), [("$.items[0].reading_audit.status", "unknown_status")]),
    (envelope(audited(summary="")), [("$.items[0].reading_audit.summary", "blank")]),
    (envelope(audited(issues=[""])), [("$.items[0].reading_audit.issues", "not_texts")]),
    (envelope(audited(spans=5)), [("$.items[0].reading_audit.spans", "not_a_list")]),
    (envelope(audited(status="text_only_ok")), [("$.items[0].reading_audit.status", "ok_with_findings")]),
    (envelope(audited(status="needs_decision")), [("$.items[0].reading_audit.status", "undecided_without_issue")]),
    (envelope(audited(spans=[span(mode="loud")])), [("$.items[0].reading_audit.spans[0]", "span_fields")]),
    (envelope(audited(spans=[span(start=1.5)])), [("$.items[0].reading_audit.spans[0]", "span_fields")]),
    (envelope(audited(spans=[span(reading=" ")])), [("$.items[0].reading_audit.spans[0]", "span_fields")]),
    (envelope(audited(spans=[span(), span()])), [("$.items[0].reading_audit.spans[1]", "span_order")]),
    (envelope(audited(spans=[span(end=99)])), [("$.items[0].reading_audit.spans[0]", "span_order")]),
    (envelope(audited(spans=[span(surface="ab")])), [("$.items[0].reading_audit.spans[0]", "surface_differs")]),
    (envelope(audited(spans=[span(occurrence=2)])), [("$.items[0].reading_audit.spans[0]", "occurrence_differs")]),
    (envelope(audited(spans=[span(occurrence=0)])), [("$.items[0].reading_audit.spans[0]", "occurrence_differs")]),
    (envelope(audited(spans=[span(start=3, end=4, surface="😊")])), []),
]


def test_every_fault_has_its_path(spark):
    bodies = [(k, c if isinstance(c, str) else json.dumps(c, ensure_ascii=False), "m") for k, (c, _) in enumerate(deepcopy(CASES))]
    rows = spark.createDataFrame(bodies, "round int, body string, manifest_sha256 string").repartition(3)
    texts = spark.createDataFrame([(k, i, TEXT) for k in range(len(CASES)) for i in "ab"], "round int, id string, text string")
    found = {}
    for r in S.envelope_problems(rows, texts, CONTRACT).collect():
        found.setdefault(r["round"], []).append((r["path"], r["reason"]))
    assert {k: sorted(found.get(k, [])) for k in range(len(CASES))} == {k: sorted(want) for k, (_, want) in enumerate(CASES)}


def test_an_envelope_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BYTES", 100)
    rows = spark.createDataFrame([(1, json.dumps(envelope(item())), "m"), (2, None, "m")], "round int, body string, manifest_sha256 string")
    texts = spark.createDataFrame([], "round int, id string, text string")
    assert {tuple(r) for r in S.envelope_problems(rows, texts, CONTRACT).collect()} == {(1, "$", "oversized"), (2, "$", "invalid_json")}


RECEIPT = "20261001T000000000000Z-000000000000000"
NONE = (None, None, None)


@pytest.mark.parametrize(
    ("offers", "archive", "want"),
    [
        ([], [], ("unreviewed", "no_committed_receipt", None)),
        ([("now", None, "v1")], [], ("reviewed", "matching_committed_receipt", "current_bundle_sha256")),
        ([("now", "other", "v6")], [], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("old", "item", "v5")], [], ("reviewed", "matching_committed_receipt", "unchanged_item_sha256")),
        ([("old", "item", "v3")], [], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("old", "other", "v5")], [("old", True, "v5", "item")], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("old", None, "v5")], [("old", True, "v5", "item")], ("reviewed", "matching_committed_receipt", "verified_archived_bundle")),
        ([("old", None, "v5")], [("old", False, "v5", "item")], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),  # forged
        ([("old", None, "v5")], [("old", True, "v6", "item")], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("old", None, "v5")], [("old", True, "v5", "then")], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),  # stale
        ([("old", None, "v5")], [], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),  # missing
        ([("old", None, "v5")], [("old", True, "v5", "item"), ("old", True, "v5", "then")], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("now", None, "v6"), ("gone", None, "v6")], [], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
        ([("gone", None, "v6"), ("now", None, "v6")], [], ("reviewed", "matching_committed_receipt", "current_bundle_sha256")),
        ([NONE], [], ("unreviewed", "receipt_does_not_match_snapshot_or_suggestion", None)),
    ],
)
def test_confirmations(spark, offers, archive, want):
    rows = spark.createDataFrame([(1, "a", "approved", "r")], "round int, id string, status string, review_sha256 string")
    offered = spark.createDataFrame([(1, "a", "item", "v6", "now")], "round int, id string, item_sha256 string, policy_version string, bundle_sha256 string")
    saves = [(1, f"{RECEIPT}{k}", "committed", "a", "r", *o) for k, o in enumerate(offers)]
    saves += [(1, f"{RECEIPT}9", "conflict", "a", "r", "now", None, "v6"), (1, "notes", "committed", "a", "r", "now", None, "v6")]
    receipts = spark.createDataFrame(saves, "round int, name string, status string, id string, saved_review_sha256 string, bundle_sha256 string, item_sha256 string, policy_version string")
    kept = spark.createDataFrame([(1, b, s, p, "a", i) for b, s, p, i in archive], "round int, bundle_sha256 string, sound boolean, policy_version string, id string, item_sha256 string")
    assert tuple(S.confirmations(rows, offered, receipts, kept, CONTRACT).first())[2:] == want
    pending = rows.selectExpr("round", "id", "'pending' as status", "review_sha256")
    state = S.confirmations(pending, offered, receipts, kept, CONTRACT).first()["state"]
    assert state == ("draft" if want[0] == "reviewed" else "unreviewed")
    changed = rows.selectExpr("round", "id", "status", "'later' as review_sha256")
    assert S.confirmations(changed, offered, receipts, kept, CONTRACT).first()["state"] == "unreviewed"
