"""Cross-tokenizer alignment by elementary intervals.

Both tokenizers' tokens cover the same bytes.  The union of both arrays of ends
cuts them into elementary intervals; each lies in one token of either side, and
as no two intervals lie in the same two tokens, each interval is one overlap.
Where an end is in both arrays, a group of tokens closes.  A group's product,
all its A tokens with all its B tokens, is expanded by :func:`expand_groups`.

How often a pair of ids is linked is counted over the corpus: a block of
documents sends each distinct pair once with its count, counts are summed by
pair (a partial sum in every task first) and compared by B id (which has at
most one row for each A id), and travel back to the blocks, where documents
wait as places in the block's list of pairs.

Cases: a null or empty text, and a text whose tokens don't spell a space and
the text (a U+2581 in it), has no tokens; a very long text is encoded by word
(``pieces.py``); rows that repeat are aligned alike, one result each, and each
counts; a null doc_id stays null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm import pieces as P
from lectern.storage import materialize, table

A_MODEL = "byte_bpe_50k.json"
B_MODEL = "piece_bpe_32k.model"
#: Bytes of text in a block; a block sends each of its pairs once.
BLOCK_BYTES = 5_000_000
#: Bytes of text that are aligned at once.
SPAN_BYTES = 1_000_000

_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_products")


def _byte_of() -> dict[str, int]:
    """The byte of each character that a byte-level vocabulary is written in.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def a_tokens(data: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an added token is its own text."""
    model, byte_of = P.tokenizer(data, True), _byte_of()
    added = {k: t.content.encode() for k, t in model.get_added_tokens_decoder().items()}
    size = model.get_vocab_size(with_added_tokens=True)
    return [added[k] if k in added else bytes(map(byte_of.__getitem__, model.id_to_token(k))) for k in range(size)]


@lru_cache(maxsize=2)
def b_tokens(data: bytes) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, ``<0xHH>`` one byte."""
    model = P.sentences(data)
    return [
        bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        for k, piece in enumerate(P.sentence_pieces(data))
    ]


class Tables:
    """Both vocabularies as arrays: bytes and lengths of ids, and ids in decimal before each separator."""

    def __init__(self, a_data: bytes, b_data: bytes) -> None:
        sides = (a_tokens(a_data), b_tokens(b_data))
        self.bytes = [pa.array(t, pa.binary()) for t in sides]
        self.lens = [np.array([len(x) for x in t], dtype=np.int64) for t in sides]
        self.n_b = len(sides[1])
        self.shift = 2 * len(sides[0])
        written = [b"%d%c" % (k, c) for t, last in zip(sides, b"|;", strict=True) for k in range(len(t)) for c in (b","[0], last)]
        self.written = pa.array(written, pa.binary())


@lru_cache(maxsize=2)
def tables(a_data: bytes, b_data: bytes) -> Tables:
    return Tables(a_data, b_data)


def joined(values: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``values`` at ``at``, joined, and the places where each begins and the last ends."""
    if not len(at):
        return b"", np.zeros(1, dtype=np.int64)
    taken = values.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(at) + 1].astype(np.int64)
    return taken.buffers()[2].to_pybytes()[: int(offsets[-1])], offsets


def encode(a_data: bytes, b_data: bytes, texts: list[str]) -> tuple[P.Words, P.Ragged, P.Ragged]:
    """Texts as words, and the ids of both sides of each distinct word, A with a space before it."""
    own = P.Words(texts, P.words if P.spaces_lead(b_data) else lambda t: [t])
    model_a, model_b = P.tokenizer(a_data, True), P.sentences(b_data)
    found: list[list[list[int]]] = [[], []]
    for call in own.calls():
        # The model of B puts a space before every word itself.
        found[0] += [e.ids for e in model_a.encode_batch_fast([" " + w for w in call], add_special_tokens=False)]
        found[1] += model_b.encode(call, num_threads=1)
    return own, P.Ragged(found[0]), P.Ragged(found[1])


def union_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``union1d`` of two sorted arrays without repeats, by a merge."""
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


class Aligned:
    """Documents aligned together: figures of each, its groups as text, and its links as codes of pairs."""

    def __init__(self, known: Tables, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, texts: list[bytes]) -> None:
        """``n_a`` and ``n_b`` tell how many of the tokens ``a`` and ``b`` each text has."""
        spelt = [joined(v, i) for v, i in zip(known.bytes, (a, b), strict=True)]
        want = [b" " + t if t else b"" for t in texts]
        if not spelt[0][0] == spelt[1][0] == b"".join(want):
            good = np.ones(len(texts), dtype=bool)
            for (body, offsets), n in zip(spelt, (n_a, n_b), strict=True):
                at = offsets[np.concatenate([[0], np.cumsum(n)])].tolist()
                good &= [body[x:y] == w for x, y, w in zip(at, at[1:], want, strict=False)]
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
            want = [w if ok else b"" for w, ok in zip(want, good.tolist(), strict=True)]
        #: Byte places where documents end; those without tokens are empty.
        doc_ends = np.cumsum([len(w) for w in want], dtype=np.int64)
        ends_a, ends_b = np.cumsum(known.lens[0][a]), np.cumsum(known.lens[1][b])
        union = union_of(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, union), np.searchsorted(ends_b, union)
        shared = union[(ends_a[own_a] == union) & (ends_b[own_b] == union)] if len(union) else union
        #: The pair of ids of each interval.
        self.codes = a[own_a] * known.n_b + b[own_b]

        last_a, last_b = np.searchsorted(ends_a, shared, "right"), np.searchsorted(ends_b, shared, "right")
        products = np.diff(last_a, prepend=0) * np.diff(last_b, prepend=0)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        # A group's A tokens, then its B tokens.
        before_b = np.concatenate([[0], last_b])[group_a]
        at = np.empty(len(a) + len(b), dtype=np.int64)
        at[np.arange(len(a)) + before_b] = 2 * a + (ends_a == shared[group_a])
        at[np.arange(len(b)) + last_a[group_b]] = known.shift + 2 * b + (ends_b == shared[group_b])
        written, places = joined(known.written, at)

        upto = [np.searchsorted(ends, doc_ends, "right") for ends in (shared, union)]
        n_groups, n_links = (np.diff(x, prepend=0) for x in upto)
        sums = np.concatenate([[0], np.cumsum(products)])[upto[0]]
        self.figures = dict(zip(_FIGURES, (n_a, n_b, n_groups, n_links, np.diff(sums, prepend=0)), strict=True))
        cuts = places[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.groups = [written[x : y - 1] if y > x else b"" for x, y in zip(cuts, cuts[1:], strict=False)]


def align(known: Tables, a_data: bytes, b_data: bytes, texts: list[bytes]) -> Iterator[Aligned]:
    """Texts aligned, some at a time; all their distinct words are encoded first."""
    # Bytes that are no UTF-8 can't be told from what replaces them, so such a text has no tokens.
    own, a, b = encode(a_data, b_data, [t.decode("utf-8", "replace") for t in texts])
    n_a, n_b = own.sums(a.lens), own.sums(b.lens)
    filled = np.array([len(t) > 0 for t in texts], dtype=bool)
    for span in _spans(texts):
        at = own.places[own.starts[span.start] : own.starts[span.stop]]
        # An empty text is one empty word, which has a token on side A.
        at = at[np.repeat(filled[span], np.diff(own.starts[span.start : span.stop + 1]))]
        yield Aligned(known, a.of(at), n_a[span] * filled[span], b.of(at), n_b[span] * filled[span], texts[span])


def _spans(texts: list[bytes]) -> Iterator[slice]:
    low, size = 0, 0
    for k, t in enumerate(texts):
        if k > low and size + len(t) > SPAN_BYTES:
            yield slice(low, k)
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield slice(low, len(texts))


_SPLIT = "kind string, block long, ids binary, figures binary, codes binary, groups binary, code long, n long"


def _align(a_data: bytes, b_data: bytes, whole: bool, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = tables(a_data, b_data)
    for block, ids, has, texts in B.cut(frames, BLOCK_BYTES):
        figures, codes, groups = [], [], []
        for done in align(known, a_data, b_data, texts):
            figures.append(np.stack([done.figures[f] for f in _FIGURES]))
            codes.append(done.codes)
            groups += done.groups if whole else [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in done.groups]
        found, places, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        lens, body = B.join_parts(groups)
        yield pd.DataFrame({
            "kind": ["documents"], "block": [block], "ids": [B.pack_ids(ids, has)],
            "figures": [B.pack(np.concatenate(figures, axis=1).astype("<i8"))],
            "codes": [B.pack_places(places.astype("<u4"))],
            "groups": [len(lens).to_bytes(8, "little") + lens + body], "code": [None], "n": [None],
        })
        for low in range(0, len(found), 50_000):
            part = slice(low, low + 50_000)
            yield pd.DataFrame({
                "kind": "pairs", "block": block, "ids": None, "figures": None, "codes": None, "groups": None,
                "code": found[part], "n": counts[part],
            })


def _sum_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    row = left.iloc[0]
    ids, has = B.unpack_ids(row["ids"])
    figures = B.unpack(row["figures"], "<i8").reshape(len(_FIGURES), -1)
    # A block numbers its pairs in order of code.
    right = right.sort_values("code")
    count, best = right["n"].to_numpy(np.int64), right["best"].to_numpy(np.int64)
    places = B.unpack_places(row["codes"])
    at = np.concatenate([[0], np.cumsum(figures[_FIGURES.index("n_links")])])
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[places])])[at]) for v in (best, count)]
    size = int.from_bytes(row["groups"][:8], "little")
    groups = [g.decode() for g in B.split_parts(row["groups"][8 : 8 + size], row["groups"][8 + size :])]
    own = {"doc_id": pd.Series(ids, dtype="Int64").where(has)} | dict(zip(_FIGURES, figures, strict=True))
    return pd.DataFrame(own | {"n_best": sums[0], "count_sum": sums[1], "groups": groups})


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, whole: bool = True) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_products, n_best, count_sum, groups``.

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3``; without ``whole``, its
    lower-case hexadecimal SHA-256 (empty where there is none).  The vocabulary
    files (2 MB) are read on the driver and sent with the tasks.
    """
    a_data, b_data = Path(a_path).read_bytes(), Path(b_path).read_bytes()
    n_b = len(b_tokens(b_data))
    split = materialize(
        B.raw(docs).mapInPandas(B.tidied(partial(_align, a_data, b_data, whole)), _SPLIT),
        "alignment",
        partition_by=("kind",),
    )
    pairs = split.where("kind = 'pairs'").select("block", "code", "n")
    counts = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("code") % n_b)
    counts = counts.withColumn("best", (F.col("n") == F.max("n").over(of_b)).cast("long"))
    answers = pairs.select("block", "code").join(counts, "code").select(F.col("block").alias("to"), "code", "n", "best")
    kept = split.where("kind = 'documents'").select("block", "ids", "figures", "codes", "groups")
    return (
        kept.groupBy("block")
        .cogroup(answers.groupBy("to"))
        .applyInPandas(
            lambda left, right: B.tidied_group(_sum_up, left, right),
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, n_best long, count_sum long, groups string",
        )
    )


def expand_groups(aligned: DataFrame) -> DataFrame:
    """``doc_id, place, a_id, b_id``: the product of each group of :func:`align_documents`, one row a pair of tokens."""
    each = aligned.where("groups <> ''").select("doc_id", F.posexplode(F.split("groups", ";")).alias("place", "own"))
    sides = [F.split(F.split("own", r"\|")[k], ",").cast("array<long>").alias(n) for k, n in enumerate("ab")]
    first = each.select("doc_id", "place", *sides).select("doc_id", "place", F.explode("a").alias("a_id"), "b")
    return first.select("doc_id", "place", "a_id", F.explode("b").alias("b_id"))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(A_MODEL), public_tokenizers.path(B_MODEL), whole=False
    )
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_alignment": _query}
ORACLES: dict[str, str] = {}
