"""Definitions that several operators share."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

#: A word is a maximal run of characters other than ASCII white space.  The characters are listed one by one, as a regex
#: engine looks such a class up in a table of bits, where it tests a class of ranges range by range.
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"

#: Bytes up to which a written table may be broadcast; its rows are counted first.
BROADCAST_BYTES = 24_000_000


def words(text: Column) -> Column:
    """All words of a text, in order; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_hash(text: str = "text") -> Column:
    """A number that tells apart the texts of rows that share a doc_id; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hash_of(text: bytes) -> int:
    """:func:`text_hash` of a text's bytes, in Python."""
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (1 << 64) if h >> 63 else h


def hinted(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows stay below :data:`BROADCAST_BYTES`.

    A longer one is joined by a shuffle that adaptive execution can split.
    """
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written


def _picked(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    side = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_id"]) & (text_hash() == side["_hash"]), how)


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id (null is an id like others) and text are in ``dropped``.

    ``dropped`` has ``doc_id, text_hash``; a row that only shares the doc_id stays.
    """
    listed = materialize(dropped.select("doc_id", "text_hash").distinct(), "dropped")
    return _picked(docs, hinted(listed, 32), "left_anti").select(*[docs[c] for c in docs.columns])


def drop_repeats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id and text that ``kept`` (``doc_id, text_hash`` by row) has several times."""
    often = kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    listed = materialize(often.select("doc_id", "text_hash"), "repeated")
    n = listed.count()
    if not n:
        return docs
    single = _picked(docs, hinted(listed, 32), "left_anti")
    return single.unionByName(_picked(docs, hinted(listed, 32), "left_semi").dropDuplicates(["doc_id", "text"]))
