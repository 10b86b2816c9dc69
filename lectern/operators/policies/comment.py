"""Reply prefixes and emotes: versions 1 and 2 as one policy with two rule sets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from lectern.operators.policies.base import Draft, Edit, Span, SpanSet
from lectern.operators.policies.literals import REPLY, brackets, cluster_ends, is_picture, literals, mentions, noun_cue
from lectern.operators.policies.rules import Doubt, Place, Say, Test, both, carry_out, decide, followed_by, places

# What a picture is compared by.
COMPARISONS = ("一样", "一般", "似的", "似地", "般的", "般地")
_MODIFIER = re.compile(r"的(?!确)[㐀-鿿]")


@dataclass(frozen=True)
class Emotes:
    """Bare platform names, removable picture sequences, and pictures that are words."""

    platform: frozenset[str] = frozenset()
    pictures: frozenset[str] = frozenset()
    lexical: frozenset[str] = frozenset()

    def problems(self) -> list[str]:
        bad = [f"platform:{x}" for x in self.platform if not x or re.search(r"[\[\]\r\n]", x)]
        return bad + ["empty_sequence" for x in self.pictures | self.lexical if not x]


def _reasons_to_keep(emotes: Emotes, version: int) -> list[tuple[str, Test]]:
    """Rules for what an emote stands for, where it stands for something."""
    word = lambda p: p.value in emotes.lexical
    cued = [(f"{cue}_before_emote", lambda p, cue=cue: noun_cue(p.text[: p.start]) == cue) for cue in ("classifier", "predicate")]
    later = [
        ("comparison_after_emote", followed_by(COMPARISONS)),
        ("lexical_noun_modifier", both(word, followed_by(_MODIFIER))),
        ("lexical_emote", word),
    ]
    return cued + later * (version > 1)


def _pictures(text: str, known: frozenset[str], unknown: bool) -> Iterator[tuple[Span, bool]]:
    """Known sequences, the longest at each place, and with ``unknown`` other pictures; whole clusters only."""
    borders = cluster_ends(text)
    whole, by_length, free = set(borders), sorted({len(p) for p in known}, reverse=True), 0
    for start, end in zip(borders, borders[1:], strict=False):
        if start >= free:
            reach = (start + n for n in by_length)
            free = next((x for x in reach if x in whole and text[start:x] in known), 0)
            if free:
                yield (start, free), True
            elif unknown and is_picture(text[start:end]):
                yield (start, end), False


def rewrite(text: str, emotes: Emotes, version: int = 2) -> Draft:
    """Drop a reply's prefix and the emotes that carry no word; the rest is kept, and in version 2 protected."""
    draft = Draft(text, version=f"comment-policy-v{version}")
    closed = literals(text)
    reply = REPLY.match(text)
    if reply and reply[1].strip(" \t") and not closed.hits(*reply.span()):
        draft.edits.append(Edit(*reply.span(), "", "omit_reply_prefix"))
    bracketed = brackets(text)
    platform = [x for x in bracketed if text[x[1] - 1] == "]" and text[x[0] + 1 : x[1] - 1] in emotes.platform]
    closed = closed | [*mentions(text), *(x for x in bracketed if x not in platform), *((e.start, e.end) for e in draft.edits)]
    pictures = dict(_pictures(text, emotes.pictures | emotes.lexical if version > 1 else emotes.pictures, version > 1))
    open_pictures = [x for x in pictures if not (closed | platform).hits(*x)]
    rules = _reasons_to_keep(emotes, version)
    unknown = {x for x, known in pictures.items() if not known}

    def judge(p: Place) -> Say | Doubt:
        why = decide(rules, p) or ("unknown_unicode_emote" if p.span in unknown else None)
        return Doubt(why) if why else Say("", "omit_unicode_emote" if p.span in pictures else "omit_platform_emote")

    doubted = carry_out(draft, places(text, [*(x for x in platform if not closed.hits(*x)), *open_pictures]), judge)
    draft.settle()
    _keep_words_apart(draft)
    if version > 1:
        draft.protected = SpanSet((a + draft.shift(a), b + draft.shift(a)) for a, b in doubted)
    return draft


def _keep_words_apart(draft: Draft) -> None:
    """A run of deletions between two ASCII letters or digits leaves one space."""
    text, edits = draft.source, draft.edits
    joined = SpanSet((e.start, e.end) for e in edits)
    plain = re.compile(r"[A-Za-z0-9]")
    for start, end in joined:
        if 0 < start and end < len(text) and plain.match(text[start - 1]) and plain.match(text[end]):
            k = next(k for k, e in enumerate(edits) if e.start == start)
            edits[k] = Edit(start, edits[k].end, " ", edits[k].reason)
