"""Suggestion envelopes: every fault with its path, audited spans, and which saved review confirms a suggestion.

An envelope is JSON text, one a round, held as a variant; rules are columns over
it, and what breaks one is a row of ``path`` and ``reason``.  Items are exploded
and judged beside their own texts, so a round of any size is judged in parallel.

Cases: text that is no JSON, or repeats a key, is ``invalid_json`` at ``$`` and
nothing else; what has the wrong type is reported once, and rules that need it
are left out; ids that repeat are judged against their first item; an envelope
over :data:`MOST_BYTES` is ``oversized``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.review import TRACKS, review_problem

#: Fixed values of the format.
MOST_BYTES = 8 * 1024 * 1024
ENVELOPE = ("created_at_utc", "generator", "human_reviewed", "items", "policy_version", "prepared_manifest_sha256", "schema_version")
ITEM = ("acceptable_outputs", "context_required", "decision", "family", "flags", "id", "reason", "text_sha256", "track")
AUDIT = ("issues", "spans", "status", "summary")
SPAN = ("end", "mode", "occurrence", "reading", "reason", "start", "surface")
DECISIONS = ("keep", "edit", "uncertain", "excluded")
AUDIT_STATUSES = ("text_only_ok", "needs_reading_annotation", "needs_decision", "exclude_suggested")
MODES = ("letters_en", "word_en", "mixed", "number_zh", "digits_zh", "omit", "symbol_reading", "pinyin_to_hanzi", "handle", "url", "needs_decision")


@dataclass(frozen=True)
class Contract:
    """Who may suggest, and under which policies: plain ones, audited ones, and those whose receipts may outlive a bundle."""

    generator: str
    plain: tuple[str, ...]
    audited: tuple[str, ...]
    single_confirm: tuple[str, ...] = field(default=())


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _kind(v: Column, name: str) -> Column:
    """The type of a field: STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>; null if it isn't there."""
    return F.schema_of_variant(_at(v, name))


def _is(v: Column, name: str, kind: str) -> Column:
    return F.coalesce(F.startswith(_kind(v, name), F.lit(kind)), F.lit(False))


def _text(v: Column, name: str) -> Column:
    return F.when(_is(v, name, "STRING"), _at(v, name, "string"))


def _has(v: Column, names) -> Column:
    """An object with exactly these fields."""
    found = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    there = F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & (F.array_sort(found) == F.array(*[F.lit(n) for n in sorted(names)]))
    return F.coalesce(there, F.lit(False))


def _blank(text: Column) -> Column:
    return F.coalesce(T.strip(text) == "", F.lit(True))


def _texts(v: Column, name: str) -> Column:
    """A list of texts, or null if it is anything else."""
    each = _at(v, name, "array<variant>")
    fine = _is(v, name, "ARRAY") & F.forall(each, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(fine, _at(v, name, "array<string>"))


def _faults(*rules: tuple[str, str, Column]) -> Column:
    """``path, reason`` of each rule that is broken; an unknown rule counts as kept."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"))) for path, reason, broken in rules
    ]))


def _prefixed(faults: Column, prefix: Column) -> Column:
    return F.transform(faults, lambda f: F.struct(F.concat(prefix, f["path"]).alias("path"), f["reason"].alias("reason")))


def parsed(envelopes: DataFrame) -> DataFrame:
    """``envelopes`` (``round, body``) with ``v``, the body as a variant; null if it is no JSON or repeats a key."""
    small = F.octet_length("body") <= MOST_BYTES
    return envelopes.withColumn("v", F.when(small, F.try_parse_json("body")))


def _envelope_faults(contract: Contract) -> Column:
    v = F.col("v")
    policy = _text(v, "policy_version")
    known = policy.isin(*contract.plain, *contract.audited)
    wanted = F.when(policy.isin(*contract.audited), 2).otherwise(1)
    stamp = _text(v, "created_at_utc")
    utc = stamp.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?(Z|[+-]00:00)\z")
    inner = _faults(
        (".schema_version", "not_integer", ~_is(v, "schema_version", "BIGINT")),
        (".human_reviewed", "not_false", ~(_is(v, "human_reviewed", "BOOLEAN") & ~_at(v, "human_reviewed", "boolean"))),
        (".generator", "unknown_generator", ~_text(v, "generator").eqNullSafe(F.lit(contract.generator))),
        (".policy_version", "unknown_policy", ~F.coalesce(known, F.lit(False))),
        (".schema_version", "not_of_policy", known & _is(v, "schema_version", "BIGINT") & (_at(v, "schema_version", "long") != wanted)),
        (".prepared_manifest_sha256", "other_package", ~_text(v, "prepared_manifest_sha256").eqNullSafe(F.col("manifest_sha256"))),
        (".created_at_utc", "not_utc_time", ~F.coalesce(utc & F.try_to_timestamp(F.regexp_replace(stamp, r"(Z|[+-]00:00)\z", "")).isNotNull(), F.lit(False))),
        (".items", "not_a_list", ~_is(v, "items", "ARRAY")),
    )
    one = F.when(F.octet_length("body") > MOST_BYTES, "oversized").when(v.isNull(), "invalid_json").when(~_has(v, ENVELOPE), "fields")
    return F.when(one.isNull(), inner).otherwise(F.array(F.struct(F.lit("").alias("path"), one.alias("reason"))))


def _nth(text: Column, surface: Column, n: Column) -> Column:
    """Where the n-th occurrence starts, from 0, overlapping ones counted; -1 if there are fewer."""

    def next_(at: Column, _: Column) -> Column:
        here = F.call_function("locate", surface, text, at + 1)
        return F.when((at < 0) | (here == 0), -1).otherwise(here)

    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0), next_) - 1


def span_faults(spans: Column, text: Column) -> Column:
    """``path, reason`` of audited spans (array<variant>) of a text: their fields, then order, then what stands there."""
    numbers, words = ("start", "end", "occurrence"), ("surface", "reading", "reason")

    def typed(s: Column) -> Column:
        fine = _has(s, SPAN)
        for n in numbers:
            fine = fine & _is(s, n, "BIGINT")
        for n in words:
            fine = fine & ~_blank(_text(s, n))
        return fine & F.coalesce(_text(s, "mode").isin(*MODES), F.lit(False))

    def plain(s: Column) -> Column:
        return F.struct(*[_at(s, n, "long").alias(n) for n in numbers], _text(s, "surface").alias("surface"), typed(s).alias("typed"))

    values = F.transform(spans, plain)

    def fault(s: Column, k: Column) -> Column:
        before = F.when(k > 0, F.coalesce(F.get(values, k - 1)["end"], F.lit(0))).otherwise(0)
        ordered = (before <= s["start"]) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))
        stands = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")) == s["surface"]
        counted = (s["occurrence"] >= 1) & (s["occurrence"] <= F.length(text))
        placed = F.when(counted, _nth(text, s["surface"], s["occurrence"]) == s["start"]).otherwise(False)
        reason = F.when(~s["typed"], "span_fields").when(~ordered, "span_order").when(~stands, "surface_differs").when(~placed, "occurrence_differs")
        return F.struct(F.concat(F.lit(".spans["), k.cast("string"), F.lit("]")).alias("path"), reason.alias("reason"))

    return F.filter(F.transform(values, fault), lambda f: f["reason"].isNotNull())


def audit_faults(audit: Column, text: Column) -> Column:
    """``path, reason`` of a reading audit (variant) of a text."""
    status, issues, spans = _text(audit, "status"), _texts(audit, "issues"), _at(audit, "spans", "array<variant>")
    listed = _is(audit, "spans", "ARRAY")
    own = _faults(
        (".status", "unknown_status", ~F.coalesce(status.isin(*AUDIT_STATUSES), F.lit(False))),
        (".summary", "blank", _blank(_text(audit, "summary"))),
        (".issues", "not_texts", F.coalesce(F.exists(issues, _blank), F.lit(True))),
        (".spans", "not_a_list", ~listed),
        (".status", "ok_with_findings", (status == "text_only_ok") & ((F.size(issues) > 0) | (F.size(spans) > 0))),
        (".status", "undecided_without_issue", (status == "needs_decision") & (F.size(issues) == 0)),
    )
    inner = F.concat(own, F.when(listed, span_faults(spans, text)).otherwise(F.array().cast("array<struct<path:string,reason:string>>")))
    return F.when(_has(audit, AUDIT), inner).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("fields").alias("reason"))))


def _item_faults() -> Column:
    v, text = F.col("item"), F.col("text")
    id_, decision, track = _text(v, "id"), _text(v, "decision"), _text(v, "track")
    outputs, flags = _texts(v, "acceptable_outputs"), _texts(v, "flags")
    status = F.when(decision.isin("keep", "edit"), "approved").otherwise(decision)
    typed = decision.isin(*DECISIONS) & track.isin(*TRACKS, "") & _text(v, "family").isNotNull() & _is(v, "context_required", "BOOLEAN") & ~_blank(_text(v, "reason"))
    review = review_problem(text, status, F.lit("validation"), F.coalesce(outputs, F.array().cast("array<string>")), track, _text(v, "family"), _at(v, "context_required", "boolean"), _text(v, "reason"))
    known = text.isNotNull()
    own = _faults(
        (".id", "unknown_id", ~known),
        (".id", "duplicate_id", F.col("place") > F.col("first")),
        (".text_sha256", "text_differs", known & ~_text(v, "text_sha256").eqNullSafe(F.sha2(text.cast("binary"), 256))),
        (".decision", "unknown", ~F.coalesce(decision.isin(*DECISIONS), F.lit(False))),
        (".track", "unknown", ~F.coalesce(track.isin(*TRACKS, ""), F.lit(False))),
        (".family", "not_text", _text(v, "family").isNull()),
        (".context_required", "not_boolean", ~_is(v, "context_required", "BOOLEAN")),
        (".reason", "blank", _blank(_text(v, "reason"))),
        (".flags", "not_texts", F.coalesce(F.exists(flags, _blank), F.lit(True))),
        (".acceptable_outputs", "not_texts", outputs.isNull()),
        ("", "keep_changes_text", known & typed & (decision == "keep") & ((track != "preservation") | ~outputs.eqNullSafe(F.array(text)))),
        ("", "edit_as_preservation", typed & (decision == "edit") & (track == "preservation")),
    )
    reviewed = F.when(known & F.coalesce(typed, F.lit(False)) & outputs.isNotNull() & review.isNotNull(), F.array(F.struct(F.lit("").alias("path"), review.alias("reason"))))
    none = F.array().cast("array<struct<path:string,reason:string>>")
    audit = F.when(F.col("audited") & known, _prefixed(audit_faults(_at(v, "reading_audit"), text), F.lit(".reading_audit")))
    inner = F.concat(own, F.coalesce(reviewed, none), F.coalesce(audit, none))
    fields = F.when(F.col("audited"), _has(v, (*ITEM, "reading_audit"))).otherwise(_has(v, ITEM))
    return F.when(fields, inner).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("fields").alias("reason"))))


def items(envelopes: DataFrame, contract: Contract) -> DataFrame:
    """``round, place, item, id, policy_version, audited``: the items of envelopes that are lists."""
    policy = _text(F.col("v"), "policy_version")
    listed = F.when(_is(F.col("v"), "items", "ARRAY"), _at(F.col("v"), "items", "array<variant>"))
    audited = F.coalesce(policy.isin(*contract.audited), F.lit(False))
    each = parsed(envelopes).select("round", policy.alias("policy_version"), audited.alias("audited"), F.posexplode(listed).alias("place", "item"))
    return each.withColumn("id", _text(F.col("item"), "id"))


def envelope_problems(envelopes: DataFrame, templates: DataFrame, contract: Contract) -> DataFrame:
    """``round, path, reason`` for every fault of every envelope.

    ``envelopes`` has ``round, body, manifest_sha256`` (the package it must be
    bound to); ``templates`` has ``round, id, text``.
    """
    own = parsed(envelopes).select("round", F.explode(_prefixed(_envelope_faults(contract), F.lit("$"))).alias("f")).select("round", "f.*")
    each = items(envelopes.join(_sound(envelopes), "round"), contract)
    first = each.where("id is not null").groupBy("round", "id").agg(F.min("place").alias("first"))
    judged = each.join(first, ["round", "id"], "left").join(templates.select("round", "id", "text"), ["round", "id"], "left")
    prefix = F.concat(F.lit("$.items["), F.col("place").cast("string"), F.lit("]"))
    found = judged.select("round", F.explode(_prefixed(_item_faults(), prefix)).alias("f")).select("round", "f.*")
    return own.unionByName(found)


def _sound(envelopes: DataFrame) -> DataFrame:
    """Rounds whose envelope has the fields of one."""
    return parsed(envelopes).where(_has(F.col("v"), ENVELOPE)).select("round")


#: What a receipt must be named like to count: its time, then a number of its own.
RECEIPT = r"\A[0-9]{8}T[0-9]{12}Z-[0-9a-f]{16}\z"


def confirmations(rows: DataFrame, suggestions: DataFrame, receipts: DataFrame, archives: DataFrame, contract: Contract) -> DataFrame:
    """``round, id, state, basis, kind``: whether the last committed save of each suggested row confirms its suggestion.

    ``rows``: ``round, id, status, review_sha256``.  ``suggestions``: ``round,
    id, item_sha256, policy_version, bundle_sha256``, of the present bundle.
    ``receipts``: ``round, name, status, id, saved_review_sha256`` and what was
    offered then, ``bundle_sha256, item_sha256, policy_version`` (null where not
    recorded).  ``archives``: ``round, bundle_sha256, sound, policy_version, id,
    item_sha256``, a row for each item of each older bundle; ``sound`` says that
    its body has that digest and no fault.

    The last committed receipt alone counts: an older match can't hide a later
    save.  It matches by the present bundle, by an unchanged item, or by an
    archived bundle whose item is the same; the last two need policies of the
    contract's ``single_confirm`` on both sides.
    """
    named = receipts.where((F.col("status") == "committed") & F.col("name").rlike(RECEIPT))
    payload = ["saved_review_sha256", "bundle_sha256", "item_sha256", "policy_version"]
    last = named.groupBy("round", "id").agg(F.max(F.struct("name", *payload)).alias("r")).select("round", "id", F.col("r.name").alias("receipt"), *[F.col(f"r.{p}").alias(f"r_{p}") for p in payload])
    # Of an archive an item counts once, and only if all that is said of it agrees.
    per = archives.groupBy("round", "bundle_sha256", "id").agg(
        F.bool_and(F.coalesce("sound", F.lit(False))).alias("a_sound"), F.min("policy_version").alias("a_policy"), F.min("item_sha256").alias("a_item"),
        (F.count_distinct("policy_version", "item_sha256") == 1).alias("a_one"),
    )
    per = per.withColumnRenamed("bundle_sha256", "r_bundle_sha256")
    own = suggestions.select("round", "id", *[F.col(c).alias(f"s_{c}") for c in ("item_sha256", "policy_version", "bundle_sha256")])
    both = rows.join(own, ["round", "id"]).join(last, ["round", "id"], "left").join(per, ["round", "r_bundle_sha256", "id"], "left")
    single = F.col("r_policy_version").isin(*contract.single_confirm) & F.col("s_policy_version").isin(*contract.single_confirm)
    item = F.col("r_item_sha256")
    archived = F.col("a_sound") & F.col("a_one") & (F.col("a_policy") == F.col("r_policy_version")) & (F.col("a_item") == F.col("s_item_sha256"))
    kind = (
        F.when(F.col("r_bundle_sha256") == F.col("s_bundle_sha256"), F.when(item.isNull() | (item == F.col("s_item_sha256")), "current_bundle_sha256"))
        .when(~F.coalesce(single, F.lit(False)), None)
        .when(item.isNotNull(), F.when(item == F.col("s_item_sha256"), "unchanged_item_sha256"))
        .when(F.coalesce(archived, F.lit(False)), "verified_archived_bundle")
    )
    matched = kind.isNotNull() & F.coalesce(F.col("r_saved_review_sha256") == F.col("review_sha256"), F.lit(False))
    basis = F.when(F.col("receipt").isNull(), "no_committed_receipt").when(matched, "matching_committed_receipt").otherwise("receipt_does_not_match_snapshot_or_suggestion")
    state = F.when(~matched, "unreviewed").when(F.col("status") == "pending", "draft").otherwise("reviewed")
    return both.select("round", "id", state.alias("state"), basis.alias("basis"), F.when(matched, kind).alias("kind"))
