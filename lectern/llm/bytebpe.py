"""Byte-level BPE encoding and decoding through one global word shuffle.

Blocks of documents are split into pre-tokens; a block keeps its documents as
positions in its own list of distinct words.  The distinct words go to shards
by hash, where each is encoded once whichever blocks it came from.  The ids
travel back to the blocks by word, and every document is put together again by
position.  Decoding joins the ids with the token-byte table.  A word that fills
a third of the corpus is one entry a block.

Cases: a null or empty text has no tokens and decodes to no bytes; one very long
run without a break is one word; rows that repeat are encoded alike, one result
each; a null doc_id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import blocks as B
from lectern.storage import materialize, table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text in a block; the larger, the fewer times a word is sent.
BLOCK_BYTES = 16_000_000


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, data.splitlines()) if word}


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(data), special_tokens={})._core_bpe


@lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> dict[int, bytes]:
    return {rank: word for word, rank in _ranks(data).items()}


def _pretokens(pattern: str, n_shards: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for block, ids, has, texts in B.cut_batches(batches, block_bytes):
            seen, counts, flat = B.Places(), [], [np.empty(0, "<u4")]
            for t in texts:
                words = find(t.decode("utf-8", "replace"))
                counts.append(len(words))
                flat.append(np.fromiter(map(seen.__getitem__, words), dtype="<u4", count=len(words)))
            texts.clear()
            at = np.concatenate(flat)
            flat.clear()
            # Frequent words get the first places.
            order = np.argsort(-np.bincount(at, minlength=len(seen)), kind="stable")
            place = np.empty(len(order), dtype="<u4")
            place[order] = np.arange(len(order))
            rows = [("documents", -1, block, B.pack_ids(ids, has), np.array(counts, "<i8").tobytes(), B.pack_places(place[at]))]
            del at
            words = [w.encode() for w in seen]
            seen.clear()
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
            for shard, part in B.by_shard(keys, n_shards):
                own = sorted(part.tolist(), key=words.__getitem__)
                lens, body = B.join_parts([words[k] for k in own])
                rows.append(("words", shard, block, B.pack_places(place[own]), lens, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPLIT.types, strict=True)], schema=_SPLIT)
            rows.clear()

    return B.tidied(run)


_SPLIT = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("ids", "lens", "body"))])


def _encode(data: bytes, pattern: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        encode, known, rows = _encoder(data, pattern).encode_single_piece, {}, []
        for block, places, lens, body in zip(group["block"], group["ids"], group["lens"], group["body"], strict=True):
            found = []
            for word in B.split_parts(lens, body):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(encode(word), dtype="<u4").tobytes()
                found.append(ids)
            lens, body = B.join_parts(found)
            rows.append((block, places, lens, body))
        return pd.DataFrame(rows, columns=["block", "places", "lens", "body"])

    return lambda group: B.tidied_group(run, group)


#: What leaves the worker of a document: ids and the bytes they decode to, ids and the digest of the bytes, or digests alone.
OUTPUTS = {"whole": "ids binary, decoded binary", "ids": "ids binary, decoded_sha256 string", "digests": "ids_sha256 string, decoded_sha256 string"}


def _assemble(data: bytes, output: str):
    """Documents put together."""
    keeps_ids, keeps_bytes = output != "digests", output == "whole"
    names = [part.split()[0] for part in OUTPUTS[output].split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, has = B.unpack_ids(left["ids"][0].as_py())
        counts = np.frombuffer(left["lens"][0].as_py(), "<i8")
        positions = B.unpack_places(left["body"][0].as_py())
        words: list[bytes] = [b""] * (int(positions.max()) + 1 if len(positions) else 0)
        for places, lens, body in zip(right["places"], right["lens"], right["body"], strict=True):
            for place, word in zip(B.unpack_places(places.as_py()).tolist(), B.split_parts(lens.as_py(), body.as_py()), strict=True):
                words[place] = word
        table_ = _token_bytes(data)
        text_of = [b"".join(map(table_.__getitem__, np.frombuffer(w, "<u4").tolist())) for w in words]
        tokens, decoded, sizes, low = _Column(keeps_ids), _Column(keeps_bytes), [], 0
        for n in counts.tolist():
            own = positions[low : low + n].tolist()
            low += n
            sizes.append(tokens.add(b"".join([words[p] for p in own])) // 4)
            decoded.add(b"".join([text_of[p] for p in own]))
        columns = [pa.array(ids, mask=~has), pa.array(sizes, pa.int64()), tokens.array(), decoded.array()]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", *names])

    return lambda left, right: B.tidied_group(run, left, right)


class _Column:
    """A column of bytes, each value written once into the buffer that leaves the worker, or of their digests."""

    def __init__(self, whole: bool):
        self.whole, self.data, self.ends, self.digests = whole, bytearray(), [0], []

    def add(self, value: bytes) -> int:
        """The value's length."""
        if self.whole:
            self.data += value
            self.ends.append(len(self.data))
        else:
            self.digests.append(hashlib.sha256(value).hexdigest())
        return len(value)

    def array(self) -> pa.Array:
        if not self.whole:
            return pa.array(self.digests, pa.string())
        return pa.Array.from_buffers(pa.binary(), len(self.ends) - 1, [None, pa.py_buffer(np.array(self.ends, "<i4")), pa.py_buffer(self.data)])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, output: str = "whole", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens`` and an entry of :data:`OUTPUTS`: ids as little-endian unsigned 32-bit integers, and their bytes.

    A block's documents come back together, so ``block_bytes`` bounds what a worker returns at once.

    The rank file (under a megabyte) is read on the driver and sent with the tasks.
    """
    data = Path(ranks_path).read_bytes()
    n_shards = B.shard_count(docs)
    # Documents stay where they are written; only words and their ids travel.  Small blocks share a bucket.
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(B.MOST_BUCKETS, max(n_buckets, n_shards * B.SHARD_BYTES // max(block_bytes, BLOCK_BYTES)))
    split = materialize(
        B.raw(docs).mapInArrow(
            _pretokens(pattern, n_shards, block_bytes),
            "kind string, shard long, block long, ids binary, lens binary, body binary",
        ),
        "bpe",
        partition_by=("kind",),
        buckets=(n_buckets, "block"),
    )
    words = split.where("kind = 'words'").select("shard", "block", "ids", "lens", "body")
    encoded = words.groupBy("shard").applyInPandas(
        _encode(data, pattern), "block long, places binary, lens binary, body binary"
    )
    kept = split.where("kind = 'documents'").select("block", "ids", "lens", "body")
    return (
        kept.groupBy("block")
        .cogroup(encoded.groupBy("block"))
        .applyInArrow(
            _assemble(data, output),
            f"doc_id long, n_tokens long, {OUTPUTS[output]}",
        )
    )


def encode_with_public_ranks(docs: DataFrame, output: str = "digests", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, output=output, block_bytes=block_bytes)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_with_public_ranks(table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": _query}
ORACLES: dict[str, str] = {}
