"""Operators on literal rows and against plain restatements."""

import hashlib
import random
from difflib import SequenceMatcher
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lectern.functions import spans as S
from lectern.functions import text as T
from lectern.operators import canonical, near, review, splits
from lectern.operators.components import connected_components
from lectern.operators.local import span_output
from lectern.plans.sampling import balanced_sample
from lectern.sources import capture, jsonl, prose


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 80)],
        "empty": [],
        "loops": [(5, 5), (7, 8), (8, 8)],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == brute_components(edges)


def test_balanced_sample_takes_turns(spark):
    rows = [(f"{p}{v}{i}", p, f"v{v}") for p, n in (("c", 2), ("k", 1)) for v in range(7) for i in range(n)]
    got = balanced_sample(spark.createDataFrame(rows, "id string, pool string, grp string"), size=14).collect()
    per = {}
    for r in got:
        per.setdefault((r["pool"], r["grp"]), []).append(r["turn"])
    assert all(sorted(t) == ([1, 2] if p == "c" else [1]) for (p, _), t in per.items())
    assert len([r for r in got if r["pool"] == "k"]) == 7


def test_surface(spark):
    rows = [("金额１２元，已收。", "金额12元,已收."), ("使用 WiFi 上传", "使用WiFi上传"), ("user_id", "user_id"), ("Thank  you", "Thank you")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(r[0] == r[1] for r in df.select(T.surface(F.col("a")), "b").collect())


def test_spans(spark):
    df = spark.sql("""select array(named_struct('start', 5, 'end', 7), named_struct('start', 0, 'end', 2),
        named_struct('start', 2, 'end', 3)) as s, 'abcdefgh' as t,
        array(named_struct('start', 0, 'end', 2, 'replacement', 'xyz')) as e""")
    row = df.select(S.merge(F.col("s")).alias("m"), S.replay(F.col("t"), F.col("e")).alias("r"), S.mask(F.col("t"), F.col("s")).alias("k"),
                    S.remap(F.array(S.span(F.lit(5), F.lit(7))), F.col("e")).alias("p"),
                    S.remap(F.array(S.span(F.lit(1), F.lit(3))), F.col("e")).alias("bad")).first()
    assert [tuple(x) for x in row["m"]] == [(0, 3), (5, 7)]
    assert row["r"] == "xyzcdefgh" and row["k"] == "   de  h"
    assert [tuple(x) for x in row["p"]] == [(6, 8)] and row["bad"] is None


def brute_near(left, right=None):
    """``{(a, b): ratio}`` over all pairs, of one list or of two."""
    out = {}
    for i, a in enumerate(left):
        for j, b in enumerate(left if right is None else right):
            if (right is not None or i < j) and a is not None and b is not None and a != b:
                ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
                if ratio >= 0.82:
                    out[i, j] = round(ratio, 6)
    return out


def phrases(seed, n, alphabet, least, most):
    """Phrases with variants: letters dropped, put in, swapped, whole ends moved; some of them equal."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(least, most))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(5):
            s = list(t)
            for _ in range(rng.randrange(0, max(2, len(t) // 5))):
                k = rng.randrange(len(s) + 1)
                change = rng.randrange(3)
                s[k : k + (change != 1)] = rng.choice(alphabet) if change else ""
            out.append("".join(s))
        out.append(t[len(t) // 5 :] + t[: len(t) // 5])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("alphabet", "least", "most", "n"), [("abcdefghij ", 8, 60, 40), ("ab", 1, 14, 12), ("aab😊é字 ", 1, 12, 15), ("abcdefghijklmnopqrstuvwxyz", 1, 9, 40)])
def test_near_pairs_lose_none(spark, alphabet, least, most, n):
    texts = [*phrases(5, n, alphabet, least, most), "", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos long, key string").repartition(3)
    got = {(r["a"], r["b"]): r["ratio"] for r in near.near_pairs(rows).collect()}
    assert got == brute_near(texts) and len(got) > 60
    half = len(texts) // 2
    left, right = texts[:half], texts[half:]
    sides = [spark.createDataFrame(list(enumerate(t)), "pos long, key string") for t in (left, right)]
    assert {(r["a"], r["b"]): r["ratio"] for r in near.near_pairs(*sides).collect()} == brute_near(left, right)
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    linked = {tuple(sorted((first[texts[a]], first[texts[b]]))) for a, b in brute_near(texts)}
    assert {tuple(sorted((r["a"], r["b"]))) for r in near.near_classes(rows).collect()} == linked


def test_near_candidates_are_few(spark):
    """Filters leave a small part of all pairs, each once, and no near pair is lost."""
    texts = sorted(set(phrases(11, 90, "abcdefghijklmnopqrstuvwxyz ", 15, 60)))
    rows = spark.createDataFrame(list(enumerate(texts)), "pos long, key string")
    keys = near._keys(rows, None)
    found = near.candidates(keys)
    pairs = [tuple(r) for r in found.collect()]
    left = near._counted(found, keys).count()
    hits, everything = len(brute_near(texts)), len(texts) * (len(texts) - 1) // 2
    assert len(set(pairs)) == len(pairs) and hits > 300
    assert len(pairs) < everything // 20 and hits <= left < 2 * hits + 50


def test_near_pairs_of_nothing(spark):
    rows = spark.createDataFrame([], "pos long, key string")
    assert near.near_pairs(rows).count() == near.near_classes(rows).count() == near.near_pairs(rows, rows).count() == 0


def test_match_kinds(spark):
    seeds = ["版本12可用", "Ａbc  12.5 ok", "total 7 items", "a phrase of some length", "apart"]
    other = ["版本12可用", "abc 12.5 OK", "abc 9 ok", "total 12.50 items", "a phrase of same length", "zzz", "a phrase of some length"]
    sides = [spark.createDataFrame(list(enumerate(t)), "id long, text string").select("id", "text", T.normalized_key(F.col("text")).alias("key"), T.numeric_template(F.col("text")).alias("template")) for t in (seeds, other)]
    got = {(r["left"], r["right"]): (r["kind"], r["similarity"]) for r in near.matches(*sides).collect()}
    ratio = round(SequenceMatcher(None, "aphraseofsomelength", "aphraseofsamelength", autojunk=False).ratio(), 6)
    assert got == {(0, 0): ("exact", 1.0), (1, 1): ("normalized", 1.0), (1, 2): ("numeric_template", 1.0), (2, 3): ("numeric_template", 1.0),
                   (3, 4): ("near_phrase", ratio), (3, 6): ("exact", 1.0)}


def taken_one_by_one(groups, seed, share, most):
    """The allocation as its definition puts it, over a list."""
    order = sorted(groups, key=lambda g: hashlib.sha256(f"{seed}\0{g['group_id']}".encode()).hexdigest())
    total = sum(g["rows"] for g in groups)
    tracks = {t: sum(g["tracks"].get(t, 0) for g in groups) for g in groups for t in g["tracks"]}
    target, side = round(total * share), []

    def may(g):
        rows = sum(x["rows"] for x in side) + g["rows"]
        return g not in side and rows < total and rows <= most and all(sum(x["tracks"].get(t, 0) for x in side) + n < tracks[t] for t, n in g["tracks"].items())

    for g in order:
        have = sum(x["rows"] for x in side)
        if abs(have + g["rows"] - target) < abs(have - target) and may(g):
            side.append(g)
    for t in sorted(tracks):
        if not any(x["tracks"].get(t) for x in side):
            fits = [g for g in groups if g["tracks"].get(t) and may(g)]
            side += [min(fits, key=lambda g: (g["rows"], g["group_id"]))] if fits else []
    return sorted(g["group_id"] for g in side)


@pytest.mark.parametrize(("n", "share", "most", "ahead"), [(20, 0.2, 64, 512), (60, 0.3, 16, 4), (60, 0.3, 64, 7), (5, 0.9, 64, 2), (1, 0.5, 64, 3)])
def test_allocation(spark, monkeypatch, n, share, most, ahead):
    monkeypatch.setattr(splits, "_LOOK_AHEAD", ahead)
    rng = random.Random(n)
    groups = []
    for i in range(n):
        tracks = {t: rng.randrange(1, 4) for t in rng.sample("abcd", rng.randrange(1, 3))}
        groups.append({"group_id": f"g{i}", "rows": sum(tracks.values()), "tracks": tracks})
    df = spark.createDataFrame([(g["group_id"], g["rows"], g["tracks"]) for g in groups], "group_id string, rows long, tracks map<string,long>")
    assert splits.allocate(df, seed=1, share=share, most=most) == taken_one_by_one(groups, 1, share, most)
    assert splits.allocate(df.limit(0), seed=1) == []


def test_linked_groups(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", "r")], "id long, k string, l string")
    got = {r["id"]: r["component"] for r in splits.linked_groups(rows, ["k", "l"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_parent_chain_issues(spark):
    rows = [("s", "1", "0", "0", "a"), ("s", "2", "1", "1", "b"), ("s", "3", "4", "1", "c"), ("s", "4", "3", "1", "d"), ("s", "5", "9", "1", "e"), ("s", "6", "2", "5", "f")]
    df = spark.createDataFrame(rows, "scope string, own string, parent string, root string, id string")
    got = {r["id"]: (r["chain_length"], r["context_issue"]) for r in canonical.parent_chains(spark, df).collect()}
    assert got == {"a": (0, None), "b": (1, None), "c": (1, "context_cycle"), "d": (1, "context_cycle"), "e": (0, "incomplete_context"), "f": (2, "context_root_mismatch")}


def test_parent_chains_of_any_length(spark):
    """A thread of 200 replies, and a tail of 70 that leads into a cycle of 90."""
    rows = [("s", str(k), str(k - 1), "0" if k == 1 else "1", f"s{k}") for k in range(1, 201)]
    rows += [("c", str(k), str(k - 1 if k > 1 else 90), "0", f"c{k}") for k in range(1, 161)]
    df = spark.createDataFrame(rows, "scope string, own string, parent string, root string, id string")
    got = {r["id"]: (r["chain_length"], r["top_id"], r["context_issue"]) for r in canonical.parent_chains(spark, df).collect()}
    want = {f"s{k}": (k - 1, "s1" if k > 1 else None, None) for k in range(1, 201)}
    want |= {f"c{k}": (89, f"c{k + 1 if k < 90 else 1}", "context_cycle") for k in range(1, 91)}
    want |= {f"c{k}": (k - 1, "c1", "context_cycle") for k in range(91, 161)}
    assert got == want


def test_capture_lines_and_reasons(spark):
    text = "﻿bv_id,oid,rpid,root_rpid,parent_rpid,ctime,message\r\nBV1234567891,1,2,0,0,1600000000,ok\r\nBV1234567891,1,3,0,0,1600000000,\"a\nb\nc\"\r\nbad,1,1E+5,0,0,5,\r\n"
    df = spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")
    rows = capture.judge(capture.scan(df), before=1_700_000_000).orderBy("record_number").collect()
    assert [(r["record_number"], r["line_start"], r["line_end"]) for r in rows] == [(2, 2, 2), (3, 3, 5), (4, 6, 6)]
    assert rows[0]["reasons"] == [] == rows[1]["reasons"]
    assert rows[2]["reasons"] == ["invalid_bv_id", "scientific_notation:rpid", "timestamp_out_of_range", "empty_text"]
    with pytest.raises(capture.CaptureError):
        capture.parse_file("f", b"a,b\n1,2\n")


def test_strict_json(spark):
    lines = ['{"id":"1","text":"x"}', '{"id":"1","text":"y"}', '{"id":"2","id":"3","text":"x"}', "[1]", '{"id":"4","text":" "}', '{"id":"5","text":"x","z":1}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [r["problem"] for r in jsonl.inference_inputs(df).collect()]
    assert sorted(map(str, got)) == ["blank_field", "duplicate_id", "duplicate_id", "invalid_json", "not_an_object", "unexpected_fields"]


def test_prose():
    doc = "---\ntitle: x\n---\n# 标题\n\n服务器返回 **`404`**，请查阅[这份说明](https://a.b/(c))。\n\n> 引用。\n继续\n\n```\n代码。\n```\n\n这里有 <b>标签</b>。\n"
    got = list(prose.extract(doc))
    assert [(g[0], g[2], g[5], g[6]) for g in got] == [(6, "标题", "服务器返回 404，请查阅这份说明。", None), (15, "标题", None, "non_link_html")]


def test_span_output():
    assert span_output("预算12元。", "预算十二元。", 2, 4) == "十二"
    assert span_output("aXb", "aXb", 1, 2) == "X"


def test_review_rules(spark):
    rows = [("t", "approved", "r", ["t"], "preservation", "f", False, ""), ("t", "approved", "r", ["u"], "preservation", "f", False, ""),
            ("t", "approved", " ", ["t"], "core_tn", "f", False, ""), ("t", "excluded", "r", [], "", "", None, ""), ("t", "pending", "", [], "", "", None, ""),
            ("t", "approved", "r", ["t"], "core_tn", "f", None, ""), ("t", "odd", "r", ["t"], "core_tn", "f", False, "")]
    names = "text string, status string, reviewer string, refs array<string>, track string, family string, context_required boolean, notes string"
    df = spark.createDataFrame(rows, names)
    got = [r[0] for r in df.select(review.review_problem(*[F.col(c) for c in df.columns])).collect()]
    assert got == [None, "preservation_changed", "missing_reviewer", "missing_notes", None, "context_required", "unknown_status"]


def test_streams(spark, tmp_path):
    from lectern.streaming import reviews

    spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 6, "c")], "k long, t long, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t long, v string").parquet(f"{tmp_path}/in")
    reviews.run_once(reviews.latest_state(stream, key="k", order=["t"], payload=["v"]), "latest", f"{tmp_path}/cp")
    assert {(r["k"], r["v"]) for r in spark.table("latest").collect()} == {(1, "b"), (2, "c")}


def test_changes_need_the_present_version(spark):
    from lectern.operators import store

    current = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    base = {r["id"]: r["x"] for r in current.select("id", store.version(["v"]).alias("x")).collect()}
    changes = [(1, "c", base[1], 1), (1, "d", base[1], 2), (2, "e", "old", 1), (3, "f", "x", 1)]
    after, receipts = store.apply_changes(current, spark.createDataFrame(changes, "id long, v string, base string, seq int"), payload=["v"])
    assert {(r["id"], r["v"]) for r in after.collect()} == {(1, "c"), (2, "b")}
    assert {(r["id"], r["seq"], r["status"]) for r in receipts.collect()} == {(1, 1, "committed"), (1, 2, "conflict"), (2, 1, "conflict"), (3, 1, "failed")}


def test_outputs_are_new_and_recorded(spark, tmp_path):
    import json

    from lectern.sources import sinks

    df = spark.createDataFrame([(1, "a\nb")], "id long, v string")
    out = f"{tmp_path}/out"
    state = sinks.run_recorded(spark, out, [f"{tmp_path}/in"], lambda: {"rows": df})
    assert state["status"] == "complete" and state["manifest"]["files"] >= 1
    assert json.load(open(f"{out}/run.json"))["status"] == "complete"
    with pytest.raises(FileExistsError):
        sinks.run_recorded(spark, out, [], lambda: {})
    with pytest.raises(ValueError):
        sinks.require_new(spark, f"{tmp_path}/in/x", [f"{tmp_path}/in"])
    lines = [r["value"] for r in sinks.markdown_list(df, "T", ["id", "v"]).orderBy(F.col("ordinal").asc_nulls_first()).collect()]
    assert lines == ["# T", "- id: 1; v: a b"]


def test_resource_readers(spark, tmp_path):
    from lectern.sources import resources

    text = ["# subgroup: face-smiling", "1F600 ; fully-qualified # x", "# subgroup: food", "1F34E ; fully-qualified # y", "# subgroup: hands", "1F44F 1F3FB ; fully-qualified # z", "1F3FB ; component # c"]
    df = spark.createDataFrame(list(enumerate(text)), "n long, value string")
    assert {r["picture"] for r in resources.emoji_test(df).collect()} == {"😀", "👏🏻"}
    (tmp_path / "a.xml").write_text('<ldml><annotations><annotation cp="🔨" type="tts">锤子</annotation><annotation cp="🔨">工具</annotation></annotations></ldml>', encoding="utf-8")
    assert [tuple(r) for r in resources.cldr_names(spark, f"{tmp_path}/a.xml").collect()] == [("🔨", "锤子")]
    nested = spark.read.json(spark.sparkContext.parallelize(['{"data":{"packages":[{"emote":[{"text":"[doge]"},{"text":"plain"}]}]}}']))
    assert [r["name"] for r in resources.platform_emotes(nested).collect()] == ["doge"]


@pytest.mark.parametrize("seed", range(3))
def test_long_lists_of_spans_and_edits(spark, seed):
    """Lists beyond a chunk of a scan, against plain Python and against each span held against all edits."""
    rng = random.Random(seed)
    text, at, spans, edits = "", 0, [], []
    for _ in range(300):
        word = "w" * rng.randint(1, 9)
        own = (at, at + len(word))
        if rng.random() < 0.4:
            edits.append((*own, "x" * rng.randint(1, 12)))
        if rng.random() < 0.7:
            spans.append((own[0] - 1, own[1] + 1) if rng.random() < 0.2 and at and seed else own)
        text, at = text + word + " " * 3, at + len(word) + 3
    out = text
    for a, b, r in reversed(edits):
        out = out[:a] + r + out[b:]
    kinds = "t string, s array<struct<start:int,end:int>>, e array<struct<start:int,end:int,replacement:string>>"
    cases = [(text, spans, edits), (text, [(a + 1, b + 2) for a, b in spans], edits), (text, spans, [(a, b, "") for a, b, _ in edits]), ("", [], []), (None, None, None)]
    df = spark.createDataFrame(cases, kinds)
    got = df.select("t", "s", "e", S.replay(F.col("t"), F.col("e")).alias("r"), S.remap(F.col("s"), F.col("e")).alias("m"), S._remap_each(F.col("s"), F.col("e")).alias("all"),
                    S.replay(S.replay(F.col("t"), F.col("e")), S.inverse(F.col("t"), F.col("e"))).alias("back"), S.scan(F.col("s"), lambda b, x: F.struct(F.coalesce(b["k"], F.lit(0)) + x["end"]), "struct<k:int>").alias("sums"))
    rows = {i: r for i, r in enumerate(got.collect())}
    assert all(r.m == r["all"] and r.back == r.t for r in rows.values())
    assert rows[0].r == out and rows[0].m is not None and rows[1].m is None and rows[2].m is None
    assert [x.k for x in rows[0].sums] == list(accumulate(b for _, b in spans))
