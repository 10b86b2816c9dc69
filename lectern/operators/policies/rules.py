"""Decision tables: a place in a text is put before a list of rules, and the first that holds says what becomes of it.

A policy is a generator of places and such lists.  A rule is a pair of a verdict and a test of the place; the verdicts
of one list are all of a kind, whatever its reader makes of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from lectern.operators.policies.base import Draft, Edit, Span

#: How far back a cue may stand.
LOOK_BEHIND = 24


@dataclass(frozen=True)
class Place:
    """A span of a text; ``shown`` is the text as cues are read in it, as long as the text itself."""

    text: str
    start: int
    end: int
    shown: str

    @property
    def span(self) -> Span:
        return self.start, self.end

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]

    @property
    def behind(self) -> str:
        return self.shown[max(0, self.start - LOOK_BEHIND) : self.start]

    @property
    def before(self) -> str:
        return self.shown[: self.start].rstrip(" \t")

    @property
    def ahead(self) -> str:
        return self.shown[self.end :].lstrip(" \t")


Test = Callable[[Place], object]


def places(text: str, spans: Iterable[Span], shown: str | None = None) -> list[Place]:
    return [Place(text, a, b, text if shown is None else shown) for a, b in spans]


def ends_with(*patterns: re.Pattern) -> Test:
    """One of the patterns, anchored at its end, is found closely before the place."""
    return lambda p: any(x.search(p.behind) for x in patterns)


def followed_by(what: re.Pattern | tuple[str, ...]) -> Test:
    """A pattern, or one of some words, comes next; blanks between don't count."""
    return (lambda p: p.ahead.startswith(what)) if isinstance(what, tuple) else (lambda p: what.match(p.ahead))


def both(*tests: Test) -> Test:
    return lambda p: all(t(p) for t in tests)


def either(*tests: Test) -> Test:
    return lambda p: any(t(p) for t in tests)


def unless(test: Test) -> Test:
    return lambda p: not test(p)


def always(_: Place) -> bool:
    return True


def decide(rules: Iterable[tuple], place: Place):
    """The verdict of the first rule that holds, or None."""
    return next((verdict for verdict, test in rules if test(place)), None)


@dataclass(frozen=True)
class Say:
    """Replace the place."""

    words: str
    reason: str


@dataclass(frozen=True)
class Doubt:
    """Leave the place as it is and report it."""

    why: str


def carry_out(draft: Draft, found: Iterable[Place], judge: Callable[[Place], Say | Doubt | None]) -> list[Span]:
    """Edits and warnings of a draft for each place that has a verdict; returns the places in doubt."""
    doubted = []
    for place in found:
        verdict = judge(place)
        if isinstance(verdict, Say):
            draft.edits.append(Edit(*place.span, verdict.words, verdict.reason))
        elif verdict:
            draft.warn(verdict.why, *place.span)
            doubted.append(place.span)
    return doubted


def withdraw(base: Draft, version: str, why: Callable[[Edit, Place], str | None]) -> tuple[Draft, dict[Span, str]]:
    """A stricter draft: the base's edits but for those with a reason against them, which are told by place."""
    draft, gone = Draft(base.source, warnings=list(base.warnings), version=version), {}
    for edit in base.edits:
        place = Place(base.source, edit.start, edit.end, base.source)
        reason = why(edit, place)
        if reason:
            gone[place.span] = reason
            draft.warn(f"audit_withdrawn_{reason}", *place.span)
        else:
            draft.edits.append(edit)
    return draft, gone


def said_again(draft: Draft, forms: Iterable[str]) -> list[Span]:
    """Wherever the text has a spoken form, made by this draft or not."""
    text = draft.text
    return [m.span() for form in forms for m in re.finditer(re.escape(form), text)]
