"""Model edits accepted as a whole or not at all."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from lectern.operators.policies.base import Draft, Edit, SpanSet


def parse(lines: str) -> list[tuple[str, str] | None]:
    """``anchor->reading`` of each filled line, split at the last arrow; None where there is none."""
    found = []
    for line in lines.splitlines():
        if line.strip():
            anchor, arrow, said = line.rpartition("->")
            found.append((anchor, said) if arrow and anchor else None)
    return found


def _is_han(c: str) -> bool:
    return unicodedata.name(c, "").startswith(("CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY IDEOGRAPH"))


def _keeps_han(anchor: str, said: str) -> bool:
    rest = iter(said)
    return all(c in rest for c in anchor if _is_han(c))


@dataclass(frozen=True)
class _Step:
    """One of a model's edits, and where its anchor is found after the ones before it (-1: nowhere)."""

    pair: tuple[str, str] | None
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.pair[0])


def _steps(text: str, lines: str) -> Iterator[_Step]:
    at = 0
    for pair in parse(lines):
        step = _Step(pair, text.find(pair[0], at) if pair else -1)
        at = step.end if step.start >= 0 else at
        yield step


def _rebuilt(text: str, steps: Iterable[_Step]) -> str:
    made = Draft(text, [Edit(s.start, s.end, s.pair[1], "model") for s in steps])
    return made.text


def replay(text: str, lines: str) -> str:
    """The text after edits whose anchors are found one after the other; others are left out."""
    return _rebuilt(text, (s for s in _steps(text, lines) if s.start >= 0))


#: After one of these nothing more of the answer is read.
_BROKEN = (
    ("malformed_edit", lambda s: s.pair is None),
    ("anchor_not_found", lambda s: s.start < 0),
    ("empty_reading", lambda s: not s.pair[1].strip()),
)
_FAULTS = (
    ("anchor_without_decimal_digit", lambda s, _: not any(map(str.isdecimal, s.pair[0]))),
    ("original_han_not_preserved_in_order", lambda s, _: not _keeps_han(*s.pair)),
    ("protected_span_overlap", lambda s, protected: protected.hits(s.start, s.end)),
)


def reasons(text: str, raw: str | None, prediction: str | None, protected: SpanSet) -> list[str]:
    """Why a model's edits can't be taken; empty if they can."""
    if raw is None or prediction is None:
        return ["invalid_tn_output_type"]
    found, sound = [], []
    for step in _steps(text, raw):
        broken = next((why for why, holds in _BROKEN if holds(step)), None)
        if broken:
            found.append(broken)
            break
        sound.append(step)
        found += [why for why, holds in _FAULTS if holds(step, protected)]
    return found + ["reconstructed_prediction_mismatch"] * (_rebuilt(text, sound) != prediction)
