"""A slot for a model: batched, isolated inference over ``id, text`` and nothing else.

The model is a plug-in: a picklable object whose ``load()`` is called once in a
worker and returns a function of a list of texts that gives an :class:`Answer`
for each.  No model ships with the library.

Cases: a null or blank text never reaches the model; a batch that raises is
halved until only the texts that raise by themselves are left, and each of those
has the status ``error`` with the kind and message; an answer of the wrong kind,
or too few of them, is such an error too; a fatal error (:class:`Fatal`) fails
the task, so that Spark tries the partition again elsewhere.  Rows that repeat
are each answered; an empty table loads no model.  Other columns are refused: a
reference or label must not come near the model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "id string, prediction string, raw_output string, status string, generated_tokens int, input_tokens int, "
    "error_type string, error string, latency_ms double"
)
SKIPPED = "not_run_empty"
#: Characters of a batch with every text as long as its longest, as models pad them; and texts of a batch.
BATCH_CHARS = 16_384
BATCH_TEXTS = 64


class Fatal(RuntimeError):
    """The model can't go on at all (out of memory, device lost)."""


@dataclass(frozen=True)
class Answer:
    """What a model says to one text.

    ``ended`` is false where the model stopped at its limit; ``prediction`` is
    then not taken.
    """

    raw: str
    prediction: str
    ended: bool = True
    generated_tokens: int | None = None
    input_tokens: int | None = None

    @property
    def status(self) -> str:
        return "truncated" if not self.ended else "ok" if self.prediction.strip() else "empty_output"


Infer = Callable[[list[str]], list[Answer]]


class Plugin(Protocol):
    #: Tells plug-ins apart: a worker keeps one loaded model for each name and revision.
    name: str
    revision: str

    def load(self) -> Infer: ...


_LOADED: dict[tuple[str, str], Infer] = {}


def _model(plugin: Plugin) -> Infer:
    key = (plugin.name, plugin.revision)
    if key not in _LOADED:
        _LOADED.clear()  # one model a worker
        _LOADED[key] = plugin.load()
    return _LOADED[key]


def batches(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of the filled texts by length, as many together as the bounds allow; a longer text is a batch of its own."""
    own: list[int] = []
    for k in sorted((k for k, t in enumerate(texts) if t is not None and t.strip()), key=lambda k: len(texts[k])):
        if own and ((len(own) + 1) * len(texts[k]) > BATCH_CHARS or len(own) == BATCH_TEXTS):
            yield own
            own = []
        own.append(k)
    if own:
        yield own


def _answered(infer: Infer, texts: list[str]) -> list[Answer | Exception]:
    """An answer or what went wrong for each text; a batch that fails is tried by halves."""
    try:
        found = infer(texts)
        if len(found) != len(texts) or not all(isinstance(a, Answer) for a in found):
            raise TypeError(f"{len(texts)} texts, {len(found)} answers")
        return list(found)
    except Fatal:
        raise
    except Exception as e:
        if len(texts) == 1:
            return [e]
        half = len(texts) // 2
        return _answered(infer, texts[:half]) + _answered(infer, texts[half:])


def _row(id_: str | None, answer: Answer | Exception | None, ms: float) -> tuple:
    if answer is None:
        return (id_, None, None, SKIPPED, None, None, None, None, 0.0)
    if isinstance(answer, Exception):
        return (id_, "", "", "error", None, None, type(answer).__name__, str(answer), ms)
    taken = "" if answer.status == "truncated" else answer.prediction
    return (id_, taken, answer.raw, answer.status, answer.generated_tokens, answer.input_tokens, None, None, ms)


def gold_free(inputs: DataFrame) -> DataFrame:
    """``inputs`` if it has the columns id and text alone; what a model sees can't hold a reference."""
    if sorted(inputs.columns) != ["id", "text"] or {t for _, t in inputs.dtypes} != {"string"}:
        raise ValueError(f"a model is given id and text as strings, nothing else: {inputs.dtypes}")
    return inputs.select("id", "text")


def predict(inputs: DataFrame, plugin: Plugin) -> DataFrame:
    """One row for each of ``inputs`` (``id, text``), by :data:`SCHEMA`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for frame in frames:
            texts = frame["text"].tolist()
            rows: list[tuple] = [_row(i, None, 0.0) for i in frame["id"]]
            for own in batches(texts):
                began = time.perf_counter()
                found = _answered(_model(plugin), [texts[k] for k in own])
                ms = (time.perf_counter() - began) * 1000 / len(own)
                for k, answer in zip(own, found, strict=True):
                    rows[k] = _row(rows[k][0], answer, ms)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"generated_tokens": "Int32", "input_tokens": "Int32"})

    return gold_free(inputs).mapInPandas(run, SCHEMA)
