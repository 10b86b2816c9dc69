"""The policies as Arrow functions: text in, a struct of text, edits, warnings and spans out.

A batch that Spark sends is worked off in pieces of a few texts, and a piece is handed back before the next one is
looked at, so that a worker's memory grows with :data:`PIECE_BYTES` or the longest text, not with rows or batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.functions.pieces import pieces as in_pieces
from lectern.operators.policies import audited, comment, context, guard, reading, semantic
from lectern.operators.policies.literals import identifiers
from lectern.operators.policies.tables import resources

_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_EDIT = StructType(_SPAN.fields + [StructField(x, StringType()) for x in ("original", "replacement", "reason")])
RESULT = StructType(
    [
        StructField("text", StringType()),
        StructField("edits", ArrayType(_EDIT)),
        StructField("warnings", ArrayType(StringType())),
        StructField("protected", ArrayType(_SPAN)),
        StructField("policy_version", StringType()),
    ]
)

_STAGES: dict[str, Callable[[str], dict]] = {
    "comment_v1": lambda t: comment.rewrite(t, resources().emotes, 1).result(),
    "comment_v2": lambda t: comment.rewrite(
        t, comment.Emotes(resources().emotes.platform, resources().emotes.pictures, frozenset(resources().names)), 2).result(),
    "reading": lambda t: reading.rewrite(t, resources().lexicon).result(),
    "context_v1": lambda t: context.rewrite(t, resources().contexts, 1).result(),
    "context_v2": lambda t: context.rewrite(t, resources().contexts, 2).result(),
    "context_v3": lambda t: context.rewrite(t, resources().contexts, 3).result(),
    "semantic": lambda t: semantic.rewrite(t, resources().names).result(),
    "audited_context": lambda t: audited.rewrite_context(t, resources().contexts).result(),
    "audited_semantic": lambda t: audited.rewrite_semantic(t, resources().names).result(),
}


def _composed(text: str) -> dict:
    out, spans, warnings, stages = audited.rewrite(text, resources())
    n = sum(len(d.edits) for d in stages.values())
    return {"text": out, "edits": [], "warnings": [*warnings, f"edits:{n}"], "protected": [{"start": a, "end": b} for a, b in spans],
            "policy_version": audited.VERSION}


def _chained(version: int, semantic_stage: bool, name: str) -> Callable[[str], dict]:
    def run(text: str) -> dict:
        out, spans, warnings = audited.chained(text, resources(), version, semantic_stage)
        return {"text": out, "edits": [], "warnings": warnings, "protected": [{"start": a, "end": b} for a, b in spans], "policy_version": name}

    return run


_STAGES |= {
    "audited": _composed,
    "pipeline_v2": _chained(0, False, "comment-reading"),
    "pipeline_v3": _chained(1, False, "comment-reading-context-v1"),
    "pipeline_v3_1": _chained(2, False, "comment-reading-context-v2"),
    "pipeline_v4": _chained(3, True, "semantic-context-v4"),
}
POLICIES = tuple(_STAGES)


#: Bytes of texts in a piece; one longer text is a piece of its own.
PIECE_BYTES = 128 * 1024

_ARROW_SPAN = [("start", pa.int32()), ("end", pa.int32())]
_ARROW = pa.struct([
    ("text", pa.string()), ("edits", pa.list_(pa.struct(_ARROW_SPAN + [(x, pa.string()) for x in ("original", "replacement", "reason")]))),
    ("warnings", pa.list_(pa.string())), ("protected", pa.list_(pa.struct(_ARROW_SPAN))), ("policy_version", pa.string()),
])
_EMPTY = dict.fromkeys(f.name for f in RESULT.fields)


def pieces(batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[tuple[list, ...]]:
    """The rows of every batch in order, a few at a time: columns of Python values."""
    return in_pieces(batches, PIECE_BYTES)


def policy(name: str):
    """The policy ``name`` as a column function; the tables are checked before any row is read.

    It counts as nondeterministic, so that a plan that looks at several parts of a result works it out once.
    """
    resources()
    step = _STAGES[name]

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in pieces((b,) for b in batches):
            yield pa.array([_EMPTY if t is None else step(t) for t in texts], _ARROW)

    return run.asNondeterministic()


def policies(stages: dict[str, str]):
    """Policies one after the other, each over what the one before it wrote, as one column function.

    ``stages`` maps names to policies; the result is a struct of theirs by name.  All of them run in one worker: as
    functions of each other's columns each would have a worker of its own, and each of those a queue of whole rows.
    """
    resources()
    steps = {name: _STAGES[own] for name, own in stages.items()}
    kind = pa.struct([(name, _ARROW) for name in steps])

    def each(text: str | None) -> dict:
        found = {}
        for name, step in steps.items():
            found[name] = _EMPTY if text is None else step(text)
            text = found[name]["text"]
        return found

    @F.arrow_udf(StructType([StructField(name, RESULT) for name in steps]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in pieces((b,) for b in batches):
            yield pa.array([each(t) for t in texts], kind)

    return run.asNondeterministic()


def of_texts(kind, arrow: pa.DataType, step: Callable):
    """A function of several texts as a column function, by pieces."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for own in pieces(batches):
            yield pa.array([step(*row) for row in zip(*own, strict=True)], arrow)

    return run


def guard_reasons(text: Column | str, raw: Column | str, prediction: Column | str) -> Column:
    """Why a model's edits of a text can't be taken; empty where they can."""
    why = of_texts(ArrayType(StringType()), pa.list_(pa.string()), lambda t, r, p: guard.reasons(t, r, p, identifiers(t)))
    return why(text, raw, prediction)


def replay_lines(text: Column | str, lines: Column | str) -> Column:
    return of_texts(StringType(), pa.string(), guard.replay)(text, lines)
