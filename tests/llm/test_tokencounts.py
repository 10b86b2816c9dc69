"""Counts from the cache against the libraries on whole texts."""

import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import tokencounts as T

WORDS = public_tokenizers.path(T.MODEL)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t or ""))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


def cache_of(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


ODD = ["<|startoftext|> a <|endoftext|>", "<|endoftext|><|endoftext|>", "A  B\t\nC", " H̱ ẖ ", "é é", "don't I'LL", "ΑΣ ΟΔΟΣ", "\x85\xa0 x", "12345 6", "İ", "á ́", "\x1c"]


@pytest.mark.parametrize(("path", "drops"), [(WORDS, True), (WORDS, False), (public_tokenizers.path("byte_bpe_50k.json"), False), (PIECES, False)])
def test_same_as_library(spark, docs, tmp_path, path, drops):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None if k % 5 == 0 else 2000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 9, "d", 1) for i, t in rows], "doc_id long, text string, n_tokens long, digest string, n_bytes int").repartition(3)
    found = T.count_tokens(df, T.Counter(path, drops_white_space=drops), cache_of(tmp_path))
    count = library(path)
    want = [(i, len((t or "").encode()), count(t)) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_only_misses_are_encoded(spark, docs, tmp_path, monkeypatch):
    counter, cache = T.Counter(WORDS, drops_white_space=True), cache_of(tmp_path)
    T.remember(docs, counter, cache)
    distinct = len({" ".join((r.text or "").replace("\x0b", " ").split()) for r in docs.collect()})
    first = spark.read.parquet(cache)
    assert first.count() == first.select("digest").distinct().count() <= docs.count()
    assert first.count() >= distinct - 2  # Python's white space has a few characters more
    again = docs.union(docs.limit(1).withColumn("text", F.lit("never seen before")))
    T.remember(again, counter, cache)
    assert spark.read.parquet(cache).count() == first.count() + 1
    # A stored count is used, not worked out again.
    other = cache_of(tmp_path)
    planted = docs.limit(1).select(counter.digest(F.col("text")).alias("digest"), F.lit(12345).cast("long").alias("n_tokens"), F.lit(counter.version).alias("tokenizer"))
    planted.write.partitionBy("tokenizer").parquet(other)
    assert T.count_tokens(docs.limit(1), counter, other).first().n_tokens == 12345


def test_versions_are_apart_and_repeated_appends_agree(spark, docs, tmp_path):
    cache, few = cache_of(tmp_path), docs.limit(12).cache()
    words, parts = T.Counter(WORDS, drops_white_space=True), T.Counter(PIECES)
    want = [sorted(map(tuple, T.count_tokens(few, c, cache).collect()), key=repr) for c in (words, parts)]
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert [sorted(map(tuple, T.look_up(few, c, cache).collect()), key=repr) for c in (words, parts)] == want


def test_unknown_empty_and_other_files(spark, docs, empty, tmp_path):
    counter, cache = T.Counter(WORDS, drops_white_space=True), cache_of(tmp_path)
    assert {r.n_tokens for r in T.look_up(docs, counter, cache).collect()} == {None}
    assert T.count_tokens(empty, counter, cache).count() == 0
    with pytest.raises(ValueError):
        T.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_normalising_and_cutting_keep_counts():
    rng = random.Random(4)
    bits = ["Word", "é", "H̱", "12", " ", "  ", "\n\t", "\x0b", "'s", "!", "Σ", "日", "́", "\x85", " ", "<|endoftext|>", "<|", " a", " 7", "\x1c"]
    counter, count = T.Counter(WORDS, drops_white_space=True), library(WORDS)
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        merged = " ".join(x for x in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if x)
        assert count(merged) == count(text)
        assert sum(map(count, T.P.words(text))) == count(text) == int(counter.counts([text])[0])


def test_a_very_long_text():
    text = "alpha beta 12 gamma. " * 60_000
    assert int(T.Counter(WORDS, drops_white_space=True).counts([text])[0]) == library(WORDS)(text)


def test_query(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    count = library(WORDS)
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in rows)
    assert sorted(map(tuple, T._query(spark, small).collect())) == want
