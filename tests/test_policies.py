"""The policies' acceptance cases, and the invariants of every result."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.policies import audited, comment, context, guard, reading, semantic
from lectern.operators.policies.base import Draft, Edit, RemapError, SpanSet
from lectern.operators.policies.literals import brackets, cluster_ends, closed_to_edits
from lectern.operators.policies.tables import CONTEXTS, EMOTES, NAMES, resources


def said(text, version=3):
    return context.rewrite(text, CONTEXTS, version).text


@pytest.mark.parametrize(
    "text, expected",
    [("a[微笑]b", "a b"), ("1[微笑][微笑]2", "1 2"), ("中[微笑]文", "中文"), ("中😊", "中"), ("`[微笑]`", "`[微笑]`"), ("一把[微笑]", "一把[微笑]")],
)
@pytest.mark.parametrize("version", [1, 2])
def test_emotes(text, expected, version):
    assert comment.rewrite(text, EMOTES, version).text == expected


def test_reply_prefix_keeps_the_body():
    assert comment.rewrite(" \t回复 @某个昵称 ： \t正文  保留…", EMOTES).text == "正文  保留…"
    assert comment.rewrite("回复 @ ：正文", EMOTES).text == "回复 @ ：正文"
    assert comment.rewrite("回复 @a：\n正文", EMOTES).text == "\n正文"


def test_versions_differ_on_unknown_pictures():
    old, new = (comment.rewrite("好🎃", EMOTES, v) for v in (1, 2))
    assert not old.warnings and not list(old.protected)
    assert new.warnings == ["needs_review:unknown_unicode_emote:1:2"] and list(new.protected) == [(1, 2)]


def test_larger_sequences_are_not_cut():
    assert comment.rewrite("好👍🏿", EMOTES).text == "好👍🏿"
    assert comment.rewrite("好👍🏽", EMOTES).text == "好"
    assert cluster_ends("👨‍👩‍👧x") == [0, 5, 6]


def test_version_names():
    words = reading.Lexicon((reading.Entry("klm", "version_stem", spelled=True), reading.Entry("badger", "version_stem")))
    assert reading.rewrite("klm12Badger3.10.007继续", words).text == "K L M 十二 Badger 三点十点零零七继续"
    assert reading.rewrite("klm12x", words).warnings == ["needs_review:unknown_ascii_token:0:6"]


@pytest.mark.parametrize(
    "digits, expected",
    [("100010001", "一亿零一万零一"), ("0010", "零零一零"), ("10", "十"), ("110", "一百一十"), ("10203040", "一千零二十万三千零四十"),
     ("0", "零"), ("1" * 17, None), ("100000", "十万"), ("1000000010", "十亿零一十")],
)
def test_integers(spark, digits, expected):
    from lectern.functions.numbers import chinese_integer

    assert reading.read_integer(digits) == expected
    row = spark.createDataFrame([(digits,)], "d string")
    assert row.select(chinese_integer(row.d)).first()[0] == expected


def test_lexicon_entries():
    got = reading.rewrite("用MySQL和json，API_extra `API` api", resources().lexicon)
    assert got.text == "用My S Q L和json，API_extra `API` A P I"
    assert [w.split(":")[1] for w in got.warnings] == ["ambiguous_reading", "unknown_ascii_token"]


@pytest.mark.parametrize("text", ["985名大学生", "211所大学", "学费211", "算出985/211的结果", "985工程师", "211+3大学"])
def test_quantities_stay(text):
    assert said(text) == text


def test_school_numbers():
    assert said("985/211高校") == "九八五/二幺幺高校"
    assert [said("他是985本科", v) for v in (1, 2, 3)] == ["他是985本科", "他是九八五本科", "他是九八五本科"]
    assert [said("985在读", v) for v in (2, 3)] == ["985在读", "九八五在读"]
    assert said("985在读取") == "985在读取"
    assert said("u1s1，好") == "有一说一，好" and said("变量u1s1=3") == "变量u1s1=3"


def test_pictures_in_noun_slots():
    assert semantic.rewrite("请递我一把🔨。", NAMES).text == "请递我一把锤子。"
    assert semantic.rewrite("好🔨", NAMES).text == "好🔨"
    assert semantic.rewrite("妥当🔨", NAMES).text == "妥当锤子"
    assert audited.rewrite_semantic("妥当🔨", NAMES).text == "妥当🔨"


def test_spans_grow_or_fail():
    draft = Draft("ab一c九", [Edit(0, 2, "A I", "x")])
    assert draft.carry([(4, 5)]) == [(5, 6)]
    assert Draft("abcd", [Edit(1, 2, "XYZ", "x")]).carry([(0, 4)]) == [(0, 6)]
    with pytest.raises(RemapError):
        Draft("abcd", [Edit(1, 3, "X", "x")]).carry([(2, 4)])
    with pytest.raises(RemapError):
        Draft("abcd", [Edit(1, 2, "", "x")]).carry([(0, 3)])


def test_guard():
    assert guard.replay("12元，12号。", "12->十二\n12->十二") == "十二元，十二号。"
    free = SpanSet()
    assert guard.reasons("12元", "12元->十二元", "十二元", free) == []
    assert guard.reasons("12元", "12元->十二", "十二", free) == ["original_han_not_preserved_in_order"]
    assert guard.reasons("12元", "bad", "12元", free) == ["malformed_edit"]
    assert guard.reasons("12元", "13->x", "12元", free) == ["anchor_not_found"]
    assert guard.reasons("12元", "12->十二", "十二元", SpanSet([(0, 1)])) == ["protected_span_overlap"]
    assert guard.reasons("12元", None, "x", free) == ["invalid_tn_output_type"]


def test_literals():
    assert brackets("a[b[c]d]e[f") == [(1, 8), (9, 11)]
    assert list(closed_to_edits("x ``a`b`` y `z")) == [(2, 9), (12, 14)]
    assert list(closed_to_edits("见www.a.b/c 和 @某人 好")) == [(1, 10), (13, 16)]


ALPHABET = st.text(alphabet="ab1 9[]`\"'@：回复一把像🔨😊👍🏽‍️😂微笑985本科JDK.u1s\n", max_size=40)


@settings(max_examples=150, deadline=None)
@given(ALPHABET)
def test_edits_rebuild_the_text(text):
    tables = resources()
    for draft in (
        comment.rewrite(text, tables.emotes, 1), comment.rewrite(text, tables.emotes, 2), reading.rewrite(text, tables.lexicon),
        context.rewrite(text, tables.contexts, 1), context.rewrite(text, tables.contexts, 3), semantic.rewrite(text, tables.names),
    ):
        out = draft.result()
        assert out["text"] == draft.text
        assert draft.undone().text == text
        assert all(0 <= s["start"] < s["end"] <= len(out["text"]) for s in out["protected"])


def _tables(**wrong):
    from dataclasses import replace

    from lectern.operators.policies import tables as t
    from lectern.operators.policies.reading import Entry, Lexicon

    entries = {
        "kind": Entry("abc", "odd"), "name": Entry("a1", "word"), "parts": Entry("AbCd", "compound", parts=(("Ab", True), ("Ce", False))), "clash": Entry("up", "initialism"),
    }
    changes = {
        "lexicon": lambda k: {"lexicon": Lexicon((*t.LEXICON.entries, entries[k]))},
        "slang": lambda v: {"contexts": replace(t.CONTEXTS, slang=(*t.CONTEXTS.slang, v))},
        "codes": lambda v: {"contexts": replace(t.CONTEXTS, codes=t.CONTEXTS.codes | v)},
        "contexts": lambda v: {"contexts": replace(t.CONTEXTS, **v)},
        "platform": lambda v: {"emotes": replace(t.EMOTES, platform=t.EMOTES.platform | {v})},
        "pictures": lambda v: {"emotes": replace(t.EMOTES, pictures=t.EMOTES.pictures | {v})},
        "names": lambda v: {"names": t.NAMES | v},
    }
    ((what, value),) = wrong.items()
    return replace(t.resources(), **changes[what](value))


@pytest.mark.parametrize(("wrong", "problem"), [
    ({"lexicon": "kind"}, "kind:abc"), ({"lexicon": "name"}, "name:a1"), ({"lexicon": "parts"}, "parts:AbCd"), ({"lexicon": "clash"}, "clash:up"),
    ({"slang": ("x y", False, "z")}, "slang:x y"), ({"slang": ("xy", False, "")}, "slang:xy"), ({"slang": ("U1S1", False, "z")}, "clash:u1s1"),
    ({"codes": {"9a": "z"}}, "code:9a"), ({"codes": {"77": ""}}, "code:77"), ({"contexts": {"window": 0}}, "window"), ({"contexts": {"window": 129}}, "window"),
    ({"contexts": {"projects": ()}}, "terms"), ({"platform": "a]"}, "platform:a]"), ({"platform": ""}, "platform:"), ({"pictures": ""}, "empty_sequence"),
    ({"names": {"🍎": "apple"}}, "spoken:🍎"), ({"names": {"🍎🍎": "苹果"}}, "picture:🍎🍎"), ({"names": {"a b": "苹果"}}, "picture:a b"),
])
def test_faulty_tables_are_refused(wrong, problem):
    from lectern.operators.policies.tables import resources

    assert resources().problems() == []
    assert problem in _tables(**wrong).problems()


def test_no_row_is_read_with_faulty_tables(monkeypatch):
    from lectern.operators.policies import columns, tables

    monkeypatch.setattr(tables, "NAMES", {"🍎": "apple"})
    tables.resources.cache_clear()
    with pytest.raises(ValueError, match="spoken"):
        columns.policy("semantic")
    monkeypatch.undo()
    tables.resources.cache_clear()
