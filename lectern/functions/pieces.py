"""Batches of Arrow worked off a few rows at a time.

A piece is handed back before the next one is looked at, so that a worker's memory grows with :data:`PIECE_BYTES` or the
longest row, not with rows or batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Bytes of texts in a piece; one longer row is a piece of its own.
PIECE_BYTES = 128 * 1024


def _sizes(column: pa.Array) -> list[int]:
    """Bytes of each row's text, or of all texts of its list."""
    if not isinstance(column, pa.ListArray | pa.LargeListArray):
        return pc.fill_null(pc.binary_length(column), 0).to_pylist()
    sums = np.concatenate([[0], np.cumsum(_sizes(column.flatten()), dtype=np.int64)])
    counts = np.array(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), dtype=np.int64)
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]).tolist()


def pieces(batches: Iterable[tuple[pa.Array, ...]], most: int) -> Iterator[tuple[list, ...]]:
    """The rows of every batch in order, as many at a time as have ``most`` bytes: columns of Python values."""
    for own in batches:
        start = size = 0
        for k, n in enumerate(map(sum, zip(*map(_sizes, own), strict=True))):
            if k > start and size + n > most:
                yield tuple(c.slice(start, k - start).to_pylist() for c in own)
                start, size = k, 0
            size += n
        yield tuple(c.slice(start).to_pylist() for c in own)


def by_text(step: Callable[[str], str]):
    """``step`` of every text as a column function; null stays null."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in pieces(((b,) for b in batches), PIECE_BYTES):
            yield pa.array([None if t is None else step(t) for t in texts], pa.string())

    return run


def by_list(step: Callable[[str], str]):
    """``step`` of every text of lists as a column function; nulls stay null."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (lists,) in pieces(((b,) for b in batches), PIECE_BYTES):
            yield pa.array([own and [t and step(t) for t in own] for own in lists], pa.list_(pa.string()))

    return run
