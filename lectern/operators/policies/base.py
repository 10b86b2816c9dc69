"""Spans, edits and the drafts that policies write them to; all places are code points."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field

Span = tuple[int, int]


class SpanSet:
    """Half-open spans, kept sorted with overlapping and touching ones joined."""

    def __init__(self, spans: Iterable[Span] = ()):
        joined: list[list[int]] = []
        for start, end in sorted(spans):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        self.spans: list[Span] = [(a, b) for a, b in joined]
        self._ends = [b for _, b in self.spans]

    def __iter__(self):
        return iter(self.spans)

    def __or__(self, more: Iterable[Span]) -> SpanSet:
        return SpanSet([*self.spans, *more])

    def hits(self, start: int, end: int) -> bool:
        """Does any span share a character with this one?"""
        k = bisect_left(self._ends, start + 1)
        return k < len(self.spans) and self.spans[k][0] < end and start < end


class RemapError(ValueError):
    """A later stage cuts or removes what an earlier one protects."""


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    replacement: str
    reason: str

    @property
    def growth(self) -> int:
        return len(self.replacement) - (self.end - self.start)


@dataclass
class Draft:
    """A text with the edits one stage makes to it."""

    source: str
    edits: list[Edit] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    protected: SpanSet = field(default_factory=SpanSet)
    version: str = ""

    def warn(self, what: str, start: int, end: int) -> None:
        self.warnings.append(f"needs_review:{what}:{start}:{end}")

    def settle(self) -> Draft:
        """Edits in order; they must be apart."""
        self.edits.sort(key=lambda e: e.start)
        for a, b in zip(self.edits, self.edits[1:], strict=False):
            if b.start < a.end:
                raise ValueError("edits overlap")
        return self

    @property
    def text(self) -> str:
        out, at = [], 0
        for e in self.edits:
            out += [self.source[at : e.start], e.replacement]
            at = e.end
        return "".join(out) + self.source[at:]

    def generated(self) -> list[Span]:
        """Where non-empty replacements stand in the text."""
        found, moved = [], 0
        for e in self.edits:
            if e.replacement:
                found.append((e.start + moved, e.start + moved + len(e.replacement)))
            moved += e.growth
        return found

    def shift(self, at: int) -> int:
        return sum(e.growth for e in self.edits if e.end <= at)

    def carry(self, spans: Iterable[Span]) -> list[Span]:
        """Spans of the source in the text; edits inside a span grow it."""
        found = []
        for start, end in spans:
            if not 0 <= start < end <= len(self.source):
                raise RemapError("span outside its text")
            low, high = start, end
            for e in self.edits:
                if e.end <= start:
                    low, high = low + e.growth, high + e.growth
                elif e.start < end:
                    if not (start <= e.start and e.end <= end):
                        raise RemapError("edit crosses a protected border")
                    if not e.replacement:
                        raise RemapError("edit removes protected text")
                    high += e.growth
            if low >= high:
                raise RemapError("nothing is left of a protected span")
            found.append((low, high))
        return found

    def undone(self) -> Draft:
        """The draft that leads from the text back to the source."""
        back, moved = [], 0
        for e in self.edits:
            low = e.start + moved
            back.append(Edit(low, low + len(e.replacement), self.source[e.start : e.end], "undo"))
            moved += e.growth
        return Draft(self.text, back)

    def result(self) -> dict:
        return {
            "text": self.text,
            "edits": [
                {"start": e.start, "end": e.end, "original": self.source[e.start : e.end], "replacement": e.replacement, "reason": e.reason}
                for e in self.edits
            ],
            "warnings": self.warnings,
            "protected": [{"start": a, "end": b} for a, b in self.protected],
            "policy_version": self.version,
        }
