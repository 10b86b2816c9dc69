"""Token counts from a digest cache.

The cache is a Parquet folder of ``digest, n_tokens``, one partition for each
version of a tokenizer (the digest of its file).  Documents come to it by the
digest of their normalised text: what is known is joined, what isn't is encoded
once however many documents say it, and appended.  A count depends on digest
and tokenizer alone, so rows that two jobs append are equal and an append that
a lost driver left half done is still right.

Normalising may only merge texts of equal count.  For a tokenizer that drops
white space, runs of ASCII white space become one space and the ends are
trimmed; for others the text stays as it is.  Where words are read apart, the
texts of a batch are encoded by distinct word (``pieces.py``).

Cases: a null or empty text has no token and no byte; a very long text
that has no place to cut it is encoded whole; rows that
repeat are counted once and each returned; a null doc_id stays null; an empty
table appends nothing and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm import pieces as P
from lectern.storage import exists, scratch_root, table

MODEL = "word_bpe_49k.json"
#: Tokens that fit the context documents are cut for.
LIMIT = 2048
#: Batches in which the query's documents come to the cache.
BATCHES = 2


class Counter:
    """A tokenizer file and how its texts may be treated.

    ``drops_white_space``: white space only parts words, so digests are of text
    with single spaces, and texts may be cut at spaces.
    """

    def __init__(self, path: str, *, drops_white_space: bool = False) -> None:
        self.data = Path(path).read_bytes()
        self.is_json = path.endswith(".json")
        if not self.is_json and not path.endswith(".model"):
            raise ValueError(f"neither .json nor .model: {path}")
        self.drops_white_space = drops_white_space
        self.version = hashlib.sha256(self.data).hexdigest()

    def digest(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        if self.drops_white_space:
            text = F.trim(F.regexp_replace(text, r"[\x20\x09\x0A\x0B\x0C\x0D]+", " "))
        return F.unhex(F.sha2(text, 256))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        apart = self.drops_white_space if self.is_json else P.spaces_lead(self.data)
        own = P.Words(texts, P.words if apart else lambda t: [t])
        if self.is_json:
            encode = P.tokenizer(self.data, False).encode_batch_fast
            found = [len(e) for call in own.calls() for e in encode(call, add_special_tokens=False)]
        else:
            # The model puts a space before every text, so a word comes without its own.
            model = P.sentences(self.data)
            found = [len(e) for call in own.calls() for e in model.encode(call, num_threads=1)]
        return own.sums(np.array(found, dtype=np.int64))


def _count(counter: Counter):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"digest": frame["digest"], "n_tokens": counter.counts(frame["text"].tolist())})

    return B.tidied(run)


def stored(spark: SparkSession, counter: Counter, cache: str) -> DataFrame:
    """``digest, n_tokens`` that a cache has for a tokenizer; one row a digest."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache)
    return rows.where(F.col("tokenizer") == counter.version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def remember(docs: DataFrame, counter: Counter, cache: str) -> None:
    """Appends the counts of all texts that the cache doesn't have."""
    texts = docs.select(counter.digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    misses = texts.dropDuplicates(["digest"]).join(stored(docs.sparkSession, counter, cache), "digest", "left_anti")
    counts = misses.mapInPandas(_count(counter), "digest binary, n_tokens long")
    counts.withColumn("tokenizer", F.lit(counter.version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def look_up(docs: DataFrame, counter: Counter, cache: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``; n_tokens is null for a text that the cache doesn't have."""
    keyed = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        counter.digest(F.col("text")).alias("digest"),
    )
    return keyed.join(stored(docs.sparkSession, counter, cache), "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, counter: Counter, cache: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every document; the cache has them afterwards."""
    remember(docs, counter, cache)
    return look_up(docs, counter, cache)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counter = Counter(public_tokenizers.path(MODEL), drops_white_space=True)
    cache = f"{scratch_root(spark)}/lectern/token-counts-{uuid.uuid4().hex}"
    for k in range(BATCHES):
        remember(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == k), counter, cache)
    return look_up(docs, counter, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": _query}
ORACLES: dict[str, str] = {}
