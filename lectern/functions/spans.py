"""Span algebra on arrays of ``struct<start int, end int>``, half-open, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
#: Results of a scan that are put into one list before the list of lists grows.
CHUNK = 32


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def scan(items: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """``step(result before, item)`` for each item in turn; the first one has null before it.

    A fold that appends to its list copies it with every item; here lists of CHUNK results are put together.
    """

    def chunk(done: Column, own: Column) -> Column:
        before = _last(_last(done))
        each = F.aggregate(
            own, F.array().cast(f"array<{kind}>"),
            lambda found, x: F.concat(found, F.array(step(F.coalesce(_last(found), before), x).cast(kind))),
        )
        return F.concat(done, F.array(each))

    def chunks(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(CHUNK))).when(own.isNotNull(), F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(own, k, CHUNK))

    return F.flatten(F.aggregate(let(items, chunks), F.array().cast(f"array<array<{kind}>>"), chunk))


def merge(spans: Column) -> Column:
    """Sorted spans, overlapping or touching ones joined."""

    def grown(before: Column, s: Column) -> Column:
        return F.when(s["start"] <= before["end"], span(before["start"], F.greatest(before["end"], s["end"]))).otherwise(s)

    # A joined span grows from row to row; where another one starts, the row before has all of it.
    return let(
        scan(F.array_sort(spans.cast(SPANS)), grown, SPANS[6:-1]),
        lambda run: F.filter(run, lambda s, k: (k == F.size(run) - 1) | ~s["start"].eqNullSafe(F.get(run, k + 1)["start"])),
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["end"]) & (s["start"] < end))


def mask(text: Column, spans: Column) -> Column:
    """The spans' characters as spaces, line ends kept."""
    return F.aggregate(
        spans.cast(SPANS),
        text,
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"]),
            F.regexp_replace(F.substring(t, s["start"] + 1, s["end"] - s["start"]), r"[^\n\r\x{85}\x{2028}\x{2029}]", " "),
            F.substring(t, s["end"] + 1, F.length(t)),
        ),
    )


def _ends_before(edits: Column) -> Column:
    """Where the edit before each one ends; 0 for the first."""
    return F.concat(F.array(F.lit(0)), F.slice(F.transform(edits, lambda e: e["end"].cast("int")), 1, F.greatest(F.size(edits) - 1, F.lit(0))))


def replay(text: Column, edits: Column) -> Column:
    """The text after edits ``struct<start,end,replacement>``, in order and apart; null if they aren't."""
    def pairs(own: Column) -> Column:
        """Each edit with the end of the one before it."""
        kind = "array<struct<at:int,e:struct<start:int,end:int,replacement:string>>>"
        each = F.zip_with(_ends_before(own), own, lambda at, e: F.struct(at, F.struct(e["start"], e["end"], e["replacement"])))
        return F.when(F.size(own) == 0, F.array().cast(kind)).otherwise(each.cast(kind))

    def put(own: Column) -> Column:
        good = F.forall(own, lambda p: (p["e"]["start"] >= p["at"]) & (p["e"]["end"] >= p["e"]["start"]) & p["e"]["replacement"].isNotNull())
        end = F.coalesce(_last(own)["e"]["end"], F.lit(0))
        made = F.transform(own, lambda p: F.concat(F.substring(text, p["at"] + 1, p["e"]["start"] - p["at"]), p["e"]["replacement"]))
        return F.when(good & (end <= F.length(text)), F.concat(F.array_join(made, ""), F.substring(text, end + 1, F.length(text))))

    return let(let(edits, pairs), put)


def shift_before(edits: Column, at: Column) -> Column:
    """How far a place moves by the edits that end before it."""
    return F.aggregate(
        edits, F.lit(0), lambda n, e: n + F.when(e["end"] <= at, F.length(e["replacement"]) - (e["end"] - e["start"])).otherwise(0)
    )


def placed(edits: Column) -> Column:
    """``start, end, to, to_end``: where each of some edits stands before and after."""

    def step(before: Column, e: Column) -> Column:
        to = e["start"] + F.coalesce(before["to_end"] - before["end"], F.lit(0))
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), to.alias("to"), (to + F.length(e["replacement"])).alias("to_end"))

    return scan(edits, step, "struct<start:int,end:int,to:int,to_end:int>")


def output_spans(edits: Column) -> Column:
    """Where the replacements stand in the text after the edits."""
    return F.transform(placed(edits), lambda e: span(e["to"], e["to_end"]))


def inverse(text: Column, edits: Column) -> Column:
    """The edits that lead back."""
    return F.transform(
        placed(edits),
        lambda e: F.struct(e["to"].alias("start"), e["to_end"].alias("end"), F.substring(text, e["start"] + 1, e["end"] - e["start"]).alias("replacement")),
    )


def remap(spans: Column, edits: Column) -> Column:
    """Protected spans after the edits; null if one is cut, or loses a part.

    A replacement inside a span grows or shrinks it; an empty one inside it, or
    an edit that crosses its border, is an error.
    """

    def of(own: Column, edits: Column) -> Column:
        ordered = F.forall(own, lambda s: s["end"] >= s["start"]) & _rising(F.transform(own, lambda s: s["end"]))
        apart = F.forall(edits, lambda e: (e["end"] > e["start"]) & e["replacement"].isNotNull()) & F.forall(
            F.zip_with(_ends_before(edits), edits, lambda at, e: e["start"] >= at), lambda ok: F.coalesce(ok, F.lit(True))
        )
        return F.when(ordered & apart, _remap_sorted(own, edits)).otherwise(_remap_each(own, edits))

    return let(F.array_sort(spans.cast(SPANS)), lambda own: let(edits, lambda e: of(own, e)))


def _rising(numbers: Column) -> Column:
    return F.forall(F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))), lambda a, b: F.coalesce(a <= b, F.lit(True))), lambda ok: ok)


def _remap_sorted(spans: Column, edits: Column) -> Column:
    """:func:`remap` of spans in order of starts and of ends, and edits in order and apart: one pass over both for the starts, one for the ends."""
    kind = "struct<at:int,rank:int,inside:int,shift:int,emptied:int>"

    def event(at: Column, rank: int, inside: int, shift: Column | int, emptied: Column | int) -> Column:
        own = {"at": at, "rank": rank, "inside": inside, "shift": shift, "emptied": emptied}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in own.items()])

    # What ends at a place is over there, and what starts there has not begun.
    over = F.transform(edits, lambda e: event(
        e["end"], 0, -1, F.length(e["replacement"]) - (e["end"] - e["start"]), F.when(e["replacement"] == "", 1).otherwise(0)))
    begun = F.transform(edits, lambda e: event(e["start"], 2, 1, 0, 0))

    def reached(places: Column) -> Column:
        def add(before: Column, e: Column) -> Column:
            sums = [F.coalesce(before[c], F.lit(0)) + e[c] for c in ("inside", "shift", "emptied")]
            return F.struct(e["at"], e["rank"], *sums)

        met = scan(F.sort_array(F.concat(F.transform(places, lambda p: event(p, 1, 0, 0, 0)), over, begun)), add, kind)
        return F.filter(met, lambda e: e["rank"] == 1)

    both = F.zip_with(
        reached(F.transform(spans, lambda s: s["start"])), reached(F.transform(spans, lambda s: s["end"])), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )

    def bad(s: Column) -> Column:
        # An empty span is cut by no border of its own, but for one that an edit holds within.
        return (s["a"]["inside"] > 0) | (s["b"]["inside"] > 0) | (s["b"]["emptied"] > s["a"]["emptied"])

    moved = let(both, lambda own: F.when(~F.exists(own, bad), F.transform(own, lambda s: span(s["a"]["at"] + s["a"]["shift"], s["b"]["at"] + s["b"]["shift"]))))
    return merge(moved)


def _remap_each(spans: Column, edits: Column) -> Column:
    """:func:`remap` of any spans and edits: each span is held against all edits."""

    def bad(s: Column) -> Column:
        def hit(e: Column) -> Column:
            inside = (s["start"] <= e["start"]) & (e["end"] <= s["end"])
            meets = (e["start"] < s["end"]) & (s["start"] < e["end"])
            return meets & (~inside | (e["replacement"] == ""))

        return F.exists(edits, hit)

    def moved(s: Column) -> Column:
        inside = F.aggregate(
            edits, F.lit(0),
            lambda n, e: n + F.when((s["start"] <= e["start"]) & (e["end"] <= s["end"]) & (e["end"] > s["start"]),
                                    F.length(e["replacement"]) - (e["end"] - e["start"])).otherwise(0),
        )
        start = s["start"] + shift_before(edits, s["start"])
        return span(start, start + s["end"] - s["start"] + inside)

    return F.when(~F.exists(spans, bad), merge(F.transform(spans, moved)))
