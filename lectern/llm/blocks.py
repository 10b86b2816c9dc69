"""Blocks of whole documents, and exchanges of packed arrays between them.

Operators that compare every document with all others cut the corpus into
blocks of bounded text.  A block is written once, compressed; what it has to
tell the others travels as sorted arrays, one row for each block and shard of
the key space, and answers travel back by block.  A key is sent once by a block
however often it occurs there, so a key that fills a third of all rows costs
each shard one entry a block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text after which a block ends; one longer document is a block of its own.
BLOCK_BYTES = 2_000_000
#: Bytes of text for each shard of a key space; bounds what a shard gathers.
SHARD_BYTES = 8_000_000
LEAST_SHARDS = 32
#: Buckets that a table may have at most; beyond it a bucket holds several blocks, which are put together one by one.
MOST_BUCKETS = 100_000

DOCS_SCHEMA = "block long, ids binary, lens binary, body binary"


def text_bytes(docs: DataFrame) -> int:
    """The measured size of all texts; the optimizer's guess may be far off."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def shards_of(size: int) -> int:
    return max(LEAST_SHARDS, -(-size // SHARD_BYTES))


def shard_count(docs: DataFrame) -> int:
    """Shards by the size of all texts."""
    return shards_of(text_bytes(docs))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted array of uint64 as its steps."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, "<u8"), dtype=np.uint64)


def tidy() -> None:
    """Hands freed memory back to the system: a worker is used again by other stages, and keeps what it once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """``run`` over frames, handing memory back also when it ends: idle workers keep what their last stage took."""

    def frames_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(frames)
        finally:
            tidy()

    return frames_of


def tidied_group(run, *groups: pd.DataFrame) -> pd.DataFrame:
    """What ``run`` makes of a group, with the memory it took handed back before the next group comes."""
    out = run(*groups)
    tidy()
    return out


def raw(docs: DataFrame) -> DataFrame:
    """What blocks are cut from: ids, and texts as bytes."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def cut(
    frames: Iterator[pd.DataFrame], most: int = BLOCK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """``(block, ids, has_id, texts)`` of at most ``most`` bytes, in order of id, nulls first.

    A null text becomes an empty one.
    """
    tidy()
    made = _first_block()
    for frame in frames:
        ids, texts = frame["doc_id"], [bytes(t) if t is not None else b"" for t in frame["text"]]
        has = ids.notna().to_numpy()
        values = ids.fillna(0).astype("int64").to_numpy()
        for low, high in _stretches(map(len, texts), most):
            yield (made, *_ordered(values[low:high], has[low:high], texts[low:high]))
            made += 1


def cut_batches(
    batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """:func:`cut` over Arrow's batches: of a batch, only one block's texts become objects at a time."""
    tidy()
    made = _first_block()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        has, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype("int64")
        for low, high in _stretches(pc.binary_length(texts).fill_null(0).to_pylist(), most):
            own = [t or b"" for t in texts.slice(low, high - low).to_pylist()]
            yield (made, *_ordered(values[low:high], has[low:high], own))
            made += 1
            del own


def _first_block() -> int:
    """The number of a task's first block."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def _stretches(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Where stretches of at most ``most`` bytes begin and end; a larger text is one of its own."""
    low, high, size = 0, 0, 0
    for n in sizes:
        if high > low and size + n > most:
            yield low, high
            low, size = high, 0
        size += n
        high += 1
    if low < high:
        yield low, high


def _ordered(ids: np.ndarray, has: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    order = np.lexsort((ids, has))
    return ids[order], has[order], [texts[k] for k in order]


def pack_ids(ids: np.ndarray, has: np.ndarray) -> bytes:
    return np.concatenate([ids.astype("<i8"), has.astype("<i8")]).tobytes()


def unpack_ids(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b, "<i8").reshape(2, -1)
    return both[0], both[1].astype(bool)


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    lens = np.array([len(t) for t in texts], dtype="<i8")
    return lens.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def unpack_texts(lens: bytes, body: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(np.frombuffer(lens, "<i8")).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def pack_places(places: np.ndarray) -> bytes:
    """Small numbers, byte by byte: the high bytes of frequent words' places are all alike."""
    planes = [((places >> np.uint32(8 * k)) & np.uint32(255)).astype("u1").tobytes() for k in range(4)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack_places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1).astype("<u4")
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


class Places(dict):
    """The place of each distinct word, in order of first sight."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


def join_parts(parts: list[bytes]) -> tuple[bytes, bytes]:
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
    return pack_places(np.array([len(p) for p in parts], dtype="<u4")), body


def split_parts(lens: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(unpack_places(lens), dtype=np.int64).tolist()
    text = zstandard.ZstdDecompressor().decompress(body)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(hashes: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Hashes of all k consecutive words, by differences of one running polynomial."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(hashes), base)
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=run[1:], dtype=np.uint64)
    return mix((run[k:] - run[:-k]) * down[:n])


def by_shard(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(shard, places)`` of the keys that fall to each shard, places in order of key."""
    if not len(keys):
        return
    shard = mix(keys) % np.uint64(n_shards)
    order = np.lexsort((keys, shard))
    found, starts = np.unique(shard[order], return_index=True)
    for s, part in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield s, part
