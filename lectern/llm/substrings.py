"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks.

The corpus is cut into blocks; each is a reference block with an index of its
windows of WINDOW words.  A document is factored against every block that can
share a window with it: two equal windows hold the same smallest GRAM-word
hash (their anchor), so blocks without an anchor in common need not be asked,
and none that matters is left out.  Windows with a shared anchor are looked up;
the answer is the place where the window's words start first in the whole
corpus.  The greedy parse then takes, from left to right, the longest run of
places that continue each other in one reference document as a factor.  Every
window that crosses a factor boundary has its own answer, so what factors
cover is exactly what the windows cover.

Windows are the same where two hashes of 64 bits agree, each rolled with a base
of its own over hashes of words of its own.  Words are not compared again: of n
distinct windows, two are taken for one with a chance of about n * n / 2^129,
1e-14 at a trillion windows.

Cases: a null or empty text has no words and keeps the empty string; texts
shorter than a window keep all words; null ids come before all others; rows
that repeat a doc_id tie where they start alike, and of such neither is
earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import blocks as B
from lectern.storage import materialize, table

WINDOW = 20
GRAM = 8
#: Bits of an anchor that are compared; a chance agreement only costs a lookup.
_ANCHOR = np.uint64((1 << 48) - 1)
_NULL_ID = np.iinfo(np.int64).min

#: Two unlike hashes of a word.
_HASHES = (xxhash.xxh3_64_intdigest, partial(xxhash.xxh64_intdigest, seed=0x5DEECE66D))


class _Block:
    """The words of a block's documents, end to end, and their windows."""

    def __init__(self, ids: np.ndarray, has: np.ndarray, texts: list[bytes]):
        self.ids, self.has = ids, has
        self.words = [t.split() for t in texts]  # bytes.split() splits at ASCII white space alone
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        seen = B.Places()
        flat = [w for words in self.words for w in words]
        #: Words as places in the list of distinct ones, which alone are hashed.
        self.place = np.fromiter(map(seen.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.distinct = list(seen)
        self.hashes = self._hashed(0)
        per = np.maximum(self.sizes - WINDOW + 1, 0)
        self.owner = np.repeat(np.arange(len(ids)), per)
        self.pos = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        #: Where a window starts in the block.
        self.at = self.starts[self.owner] + self.pos
        self.doc = np.where(has, ids, _NULL_ID)[self.owner]

    def _hashed(self, which: int) -> np.ndarray:
        return np.fromiter(map(_HASHES[which], self.distinct), dtype=np.uint64, count=len(self.distinct))[self.place]

    @cached_property
    def windows(self) -> np.ndarray:
        return B.rolling(self.hashes, WINDOW)[self.at] if len(self.at) else np.empty(0, np.uint64)

    @cached_property
    def checks(self) -> np.ndarray:
        return B.rolling(self._hashed(1), WINDOW, B.OTHER_BASE)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """For each window, the smallest hash of its GRAM-word runs."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        low = B.rolling(self.hashes, GRAM)
        step, span = 1, WINDOW - GRAM + 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        return B.mix(low[self.at]) & _ANCHOR

    def _by_words(self) -> np.ndarray:
        """Windows in order of both hashes, then of their places."""
        # Places are in order where no id repeats, and then one stable sort does unless windows differ that agree in one hash.
        docs = np.where(self.has, self.ids, _NULL_ID)
        order = np.argsort(self.windows, kind="stable")
        if (np.diff(docs) > 0).all():
            w, c = self.windows[order], self.checks[order]
            if not ((w[1:] == w[:-1]) & (c[1:] != c[:-1])).any():
                return order
        return np.lexsort((self.pos, self.doc, self.checks, self.windows))

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the block's first place of the same words; and whether it is a later one."""
        order = self._by_words()
        new = _changes(order, self.windows, self.checks)
        first = np.empty(len(order), dtype=np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        later = (self.doc != self.doc[first]) | (self.pos != self.pos[first])
        return first, later


def _changes(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in an order, some key isn't what it was before."""
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return new


def _index(n_shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, ids, has, texts in B.cut(frames):
            lens, body = B.pack_texts(texts)
            rows = [("body", -1, block, B.pack_ids(ids, has), lens, body)]
            anchors = np.unique(_Block(ids, has, texts).anchors())
            for shard, part in B.by_shard(anchors, n_shards):
                rows.append(("anchors", shard, block, None, None, B.pack_sorted(anchors[part])))
            yield pd.DataFrame(rows, columns=["kind", "shard", "block", "ids", "lens", "body"])

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """For each block of a shard, which of its anchors another block has too."""
    sent = [B.unpack_sorted(b) for b in group["body"]]
    found, counts = np.unique(np.concatenate(sent), return_counts=True)
    many = found[counts > 1]
    hits = [a[np.isin(a, many, assume_unique=True)] for a in sent]
    rows = [(b, B.pack_sorted(h)) for b, h in zip(group["block"], hits, strict=True) if len(h)]
    return pd.DataFrame(rows, columns=["block", "hits"])


def _lookups(n_shards: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "block", "keys", "checks", "docs", "pos", "at"]
        if not len(right):
            return pd.DataFrame(columns=columns)
        row = left.iloc[0]
        own = _Block(*B.unpack_ids(row["ids"]), B.unpack_texts(row["lens"], row["body"]))
        shared = np.concatenate([B.unpack_sorted(h) for h in right["hits"]])
        first, _ = own.firsts()
        ask = np.flatnonzero(np.isin(own.anchors(), shared) & (first == np.arange(len(first))))
        keys, rows = own.windows[ask], []
        for shard, part in B.by_shard(keys, n_shards):
            w = ask[part]
            rows.append(
                (shard, row["block"], B.pack_sorted(keys[part]), B.pack(own.checks[w]), B.pack(own.doc[w]),
                 B.pack(own.pos[w].astype("<i8")), B.pack(w.astype("<i8")))
            )
        return pd.DataFrame(rows, columns=columns)

    return run


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """For each block, its windows that start earlier elsewhere, and where they start first."""
    keys = [B.unpack_sorted(b) for b in group["keys"]]
    sizes = [len(k) for k in keys]
    key, check = np.concatenate(keys), np.concatenate([B.unpack(b, "<u8") for b in group["checks"]])
    doc, pos, at = (np.concatenate([B.unpack(b, "<i8") for b in group[c]]) for c in ("docs", "pos", "at"))
    order = np.lexsort((pos, doc, check, key))
    new = _changes(order, key, check)
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (doc != doc[first]) | (pos != pos[first])
    rows, low = [], 0
    for block, n in zip(group["block"], sizes, strict=True):
        w = low + np.flatnonzero(later[low : low + n])
        low += n
        if len(w):
            w = w[np.argsort(at[w])]
            rows.append((block, B.pack(at[w]), B.pack(doc[first[w]]), B.pack(pos[first[w]])))
    return pd.DataFrame(rows, columns=["block", "at", "docs", "pos"])


def _parse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The greedy parse of a block's documents, and what it leaves of them."""
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "kept_text", "starts", "lengths", "ref_docs", "ref_starts"]
    row = left.iloc[0]
    own = _Block(*B.unpack_ids(row["ids"]), B.unpack_texts(row["lens"], row["body"]))
    first, later = own.firsts()
    ref_doc, ref_pos, met = own.doc.copy(), own.pos.copy(), np.zeros(len(first), dtype=bool)
    for at, docs, pos in zip(right["at"], right["docs"], right["pos"], strict=True):
        w = B.unpack(at, "<i8")
        met[w], ref_doc[w], ref_pos[w] = True, B.unpack(docs, "<i8"), B.unpack(pos, "<i8")
    # A later window of the block starts first where the block's first one of its words does.
    met, ref_doc, ref_pos = met[first] | later, ref_doc[first], ref_pos[first]
    hit = np.flatnonzero(met)
    goes_on = np.zeros(len(hit), dtype=bool)
    if len(hit):
        goes_on[1:] = (
            (np.diff(hit) == 1)
            & (own.owner[hit][1:] == own.owner[hit][:-1])
            & (ref_doc[hit][1:] == ref_doc[hit][:-1])
            & (np.diff(ref_pos[hit]) == 1)
        )
    heads = np.flatnonzero(~goes_on)
    runs = np.diff(np.append(heads, len(hit)))
    factor, lengths = hit[heads], runs + WINDOW - 1
    covered = np.zeros(len(own.hashes) + 1, dtype=np.int64)
    np.add.at(covered, own.at[factor], 1)
    np.add.at(covered, own.at[factor] + lengths, -1)
    gone = np.cumsum(covered)[:-1] > 0
    bounds = np.searchsorted(own.owner[factor], np.arange(len(own.ids) + 1))
    rows = []
    for k, words in enumerate(own.words):
        drop = gone[own.starts[k] : own.starts[k] + len(words)]
        kept = b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if drop.any() else words)
        f = slice(bounds[k], bounds[k + 1])
        refs = [None if d == _NULL_ID else int(d) for d in ref_doc[factor[f]]]
        rows.append(
            (int(own.ids[k]) if own.has[k] else None, len(words), int(drop.sum()), hashlib.sha256(kept).hexdigest(),
             len(lengths[f]), kept.decode("utf-8", "replace"), own.pos[factor[f]].tolist(), lengths[f].tolist(), refs,
             ref_pos[factor[f]].tolist())
        )
    return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


_PARSED = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, kept_text string, "
    "starts array<long>, lengths array<long>, ref_docs array<long>, ref_starts array<long>"
)


def factor_documents(docs: DataFrame) -> DataFrame:
    """Every document's parse: what is removed and kept, and its factors as parallel arrays."""
    n_shards = B.shard_count(docs)
    indexed = materialize(
        B.raw(docs).mapInPandas(
            _index(n_shards), "kind string, shard long, block long, ids binary, lens binary, body binary"
        ),
        "rlz",
        partition_by=("kind",),
    )
    bodies = indexed.where("kind = 'body'").select("block", "ids", "lens", "body").groupBy("block")
    sent = indexed.where("kind = 'anchors'").select("shard", "block", "body")
    shared = sent.groupBy("shard").applyInPandas(_shared, "block long, hits binary")
    asked = bodies.cogroup(shared.groupBy("block")).applyInPandas(
        _lookups(n_shards), "shard long, block long, keys binary, checks binary, docs binary, pos binary, at binary"
    )
    told = asked.groupBy("shard").applyInPandas(_answers, "block long, at binary, docs binary, pos binary")
    return bodies.cogroup(told.groupBy("block")).applyInPandas(_parse, _PARSED)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = factor_documents(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op3_relative_lz": _query}
ORACLES = {
    "op3_relative_lz": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM g),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS dup FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE dup),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(x.w[x.p], ' ' ORDER BY x.p) AS t
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(r.ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
