"""The corpus pipeline: five operators in a row, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet on
shared storage and read again as the next stage's documents.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bytebpe import encode_with_public_ranks
from lectern.llm.exact_dedup import drop_copies
from lectern.llm.languages import keep_identified
from lectern.llm.mixing import repeat_by_mix
from lectern.llm.neardup import drop_near_copies
from lectern.storage import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    A null, empty or letterless text has none and goes; a very long text is
    judged whole; rows that repeat, also without id, are judged alike by their
    text, so they stay or go together; an empty table gives no rows.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest doc_id.

    A null text equals an empty one; a null doc_id is smaller than any; of rows
    that are equal in doc_id and text one stays; an empty table gives no rows.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id.

    A text without words is near nothing and stays, and so do rows without id;
    rows that share the smallest id of a group stay, each once; an empty table
    gives no rows.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole time.

    A null source is a source, the last one; a text without words has no size
    and is not taken; an empty table gives no rows.
    """
    return repeat_by_mix(docs)


#: Bytes of text of which the ids are returned together.
ENCODE_BLOCK_BYTES = 4_000_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: token ids (little-endian, 32 bits each) and the digest of what they decode to.

    A null or empty text has no ids; a document that the mix repeats is encoded
    as often; a null doc_id stays null; an empty table gives no rows.
    """
    return encode_with_public_ranks(docs, "ids", ENCODE_BLOCK_BYTES)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
