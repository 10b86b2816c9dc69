"""Document scores by masked pseudo-likelihood.

Every word is predicted from the words on both its sides.  A window network,
trained in numpy, embeds the REACH words before and after a masked place and
tells how likely each word is there, by a softmax of two levels over leaves that
words are hashed to, and the word's own share of its leaf:

    p(word | window) = p(class | window) p(leaf | class, window) count(word) / count(leaf)
    p(class | window) ~ count(class) exp(hidden . output(class)), likewise for leaves

So the probabilities of all words of the corpus sum to 1 in every window; what
the network has nothing to say of has its share of the corpus.  The sum of the
conditional log-probabilities of a text's words is its score.

Counts are of the whole corpus: words go to shards by hash and their totals come
back to the blocks that hold them, as in a join without a table that any task
must hold whole; leaves are counted by a sum over blocks.  The network's size is
a parameter and the same for every corpus.

The network is fitted on every word of every text.  It starts from a fit to a few
stretches (:data:`SAMPLE_ROWS` of :data:`SAMPLE_WORDS` words from hashed places),
as networks that start alike can be averaged.  Then the blocks are gone over, each
once, in :data:`ROUNDS` rounds: every block of a round moves a copy of the network
by its own words, and the round's network is the mean of the copies, each weight by
how many of a block's words had a part in it.  Blocks are dealt out by a hash of
rows, so the network doesn't depend on how the table is laid out; tasks add up the
copies of their blocks, so what travels is a network for each task.

Cases: a null or empty text has no words, log-probability 0 and no score; a
window that reaches beyond a text's ends sees a mark there; a null doc_id stays
null; rows that repeat are counted and scored each; a very long text is scored
some words at a time; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.common import hash_of, text_hash, words
from lectern.storage import materialize, table

#: Words on each side that a masked place is predicted from.
REACH = 2
OFFSETS = tuple(d for d in range(-REACH, REACH + 1) if d)
HIDDEN = 24
#: Rows of the network's table of words, and classes of leaves with leaves in each.
ROWS = 1 << 15
CLASSES = 64
LEAVES = 64
#: Bounds of the stretches that the fit starts from.
SAMPLE_ROWS = 2_400
SAMPLE_WORDS = 128
EPOCHS = 4
BATCH = 2048
#: Rounds in which all blocks are gone over, and words that move a block's copy at a time.
ROUNDS = 4
BLOCK_BATCH = 16384
#: Pieces that networks are added up by.
SLICES = 16
BLOCK_BYTES = 4_000_000
#: Words that are scored at a time.
CHUNK = 8192
#: The row of a place beyond a text's end.
OUTSIDE = 0

_hashes = B.WordHashes()


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """The words' rows in the network's table."""
    return (B.mix(hashes) % np.uint64(ROWS - 1)).astype(np.int64) + 1


def leaves_of(hashes: np.ndarray) -> np.ndarray:
    """The words' leaves; a class is LEAVES leaves in a row."""
    return (B.mix(hashes ^ np.uint64(0x5DEECE66D)) % np.uint64(CLASSES * LEAVES)).astype(np.int64)


def _below_zero(logs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, bool]:
    """Logs less the most that a state (within 1 in every place) can come to with them, so that a softmax needs no maximum.

    And whether they still do for it: not if some state might come to so little that all exponentials vanish.
    """
    reach = np.abs(weights).sum(axis=-1)
    top, least = (logs + reach).max(axis=-1, keepdims=True), (logs - reach).max(axis=-1, keepdims=True)
    return logs - top, bool((top - least).max() < 60)


def _softmax(z: np.ndarray, below_zero: bool) -> np.ndarray:
    """Softmax of every row, in place."""
    if not below_zero:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / _row_sums(z))[:, None]
    return z


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)  # a product is faster than a sum of short rows


def _log_softmax_at(at: np.ndarray, z: np.ndarray, below_zero: bool) -> np.ndarray:
    """One value of every row's log softmax; z is written over."""
    if not below_zero:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(at)), at]
    return own - np.log(_row_sums(np.exp(z, out=z)))


@dataclass
class Network:
    """Tables of a network; ``upper`` and ``lower`` are the outputs of classes and of leaves."""

    embed: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """States of windows, given by their words' rows (n, len(OFFSETS))."""
        x = self.bias + self.embed[around[:, 0]] * self.place[0]
        for k in range(1, len(OFFSETS)):
            x += self.embed[around[:, k]] * self.place[k]
        return np.tanh(x, out=x)

    def along(self, e: np.ndarray) -> np.ndarray:
        """States of the windows in a part of a line, given by its words' rows of ``embed``, REACH more on both sides."""
        n = len(e) - 2 * REACH
        x = self.bias + e[:n] * self.place[0]  # the first of OFFSETS is -REACH
        for k, d in enumerate(OFFSETS[1:], 1):
            x += e[REACH + d : REACH + d + n] * self.place[k]
        return np.tanh(x, out=x)

    def log_leaf(self, leaves: np.ndarray, around: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each masked word, the log-probability of its leaf where leaves have such counts."""
        return self.logs(leaves, self.hidden(around), *_logs(counts))

    def logs(self, leaves: np.ndarray, h: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The same by states and the logs of counts."""
        order, bounds = _by_class(leaves)
        h, own = h[order], leaves[order]
        found = _log_softmax_at(own // LEAVES, *self.above(h, above)) + _log_softmax_at(own % LEAVES, *self.below(h, bounds, below))
        out = np.empty_like(found)
        out[order] = found
        return out

    def above(self, h: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, bool]:
        """What the classes have in every state, and whether it stays below zero."""
        logs, below_zero = _below_zero(logs, self.upper)
        z = h @ self.upper.T
        z += logs
        return z, below_zero

    def below(self, h: np.ndarray, bounds: list[int], logs: np.ndarray) -> tuple[np.ndarray, bool]:
        """The same of the leaves of a class, where states lie class by class."""
        logs, below_zero = _below_zero(logs, self.lower)
        z = np.empty((len(h), LEAVES), "float32")
        for c, (a, b) in enumerate(pairwise(bounds)):
            np.matmul(h[a:b], self.lower[c].T, out=z[a:b])
            z[a:b] += logs[c]
        return z, below_zero


def _logs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log counts of classes and of the leaves in each; nothing goes where no word is."""
    per = counts.reshape(CLASSES, LEAVES).astype("float64")
    with np.errstate(divide="ignore"):
        above, below = np.log(per.sum(axis=1)), np.log(per)
    # A class without words is never entered; its leaves must only be numbers.
    below[np.isneginf(above)] = 0.0
    return above.astype("float32"), below.astype("float32")


def _by_class(leaves: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of words by their leaves' classes, and where each class begins in it, and its end."""
    classes = (leaves // LEAVES).astype("u2")  # numbers of 16 bits are sorted by digits
    return np.argsort(classes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES))]).tolist()


def _scatter(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[starts], np.add.reduceat(grads[order], starts, axis=0)


def line(rows: np.ndarray, leaves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and leaves of texts that lie end to end, with REACH places beyond a text's end before, between and after them.

    Such a place has no leaf (-1).
    """
    here = np.arange(len(rows)) + REACH * (1 + np.repeat(np.arange(len(sizes)), sizes))
    n = len(rows) + REACH * (1 + len(sizes))
    ids, own = np.full(n, OUTSIDE, dtype=np.min_scalar_type(ROWS)), np.full(n, -1, dtype=np.int64)
    ids[here], own[here] = rows, leaves
    return ids, own


#: The tables of a network, in the order of its fields.
TABLES = ("embed", "place", "bias", "upper", "lower")


def _go_over(net: Network, sums: dict[str, np.ndarray], ids: np.ndarray, leaves: np.ndarray, counts: np.ndarray, batch: int) -> None:
    """Moves a network by every word of a line of texts, a batch at a time, by Adagrad."""
    priors = _logs(counts)
    for low in range(REACH, len(ids) - REACH, batch):
        high = min(low + batch, len(ids) - REACH)
        _step(net, sums, ids[low - REACH : high + REACH], leaves[low:high], *priors)


def _step(net: Network, sums: dict[str, np.ndarray], ids: np.ndarray, leaves: np.ndarray, above: np.ndarray, below: np.ndarray) -> None:
    """One step by the words in a part of a line; ``ids`` has REACH places more on both sides."""
    near = [slice(REACH + d, REACH + d + len(leaves)) for d in OFFSETS]
    real = np.flatnonzero(leaves >= 0)
    order, bounds = _by_class(leaves[real])
    order = real[order]
    if not len(order):
        return
    e = net.embed[ids]
    h = net.along(e)[order]
    y, here = leaves[order], np.arange(len(order))
    grads = {"lower": np.zeros_like(net.lower)}
    off = _softmax(*net.above(h, above))
    off[here, y // LEAVES] -= 1
    back, grads["upper"] = off @ net.upper, off.T @ h
    off = _softmax(*net.below(h, bounds, below))
    off[here, y % LEAVES] -= 1
    for c, (a, b) in enumerate(pairwise(bounds)):
        back[a:b] += off[a:b] @ net.lower[c]
        np.matmul(off[a:b].T, h[a:b], out=grads["lower"][c])
    back *= 1 - h**2
    grads["bias"] = back.sum(axis=0)
    own, spread = np.zeros((len(leaves), HIDDEN), "float32"), np.zeros((len(ids), HIDDEN), "float32")
    own[order] = back
    grads["place"] = np.stack([np.einsum("ij,ij->j", own, e[at]) for at in near])
    for k, at in enumerate(near):
        spread[at] += own * net.place[k]
    seen, change = _scatter(ids, spread)
    for name, grad in [("embed", change), *grads.items()]:
        at = seen if name == "embed" else slice(None)
        sums[name][at] += grad**2
        getattr(net, name)[at] -= 0.1 * grad / np.sqrt(sums[name][at])


def _start(stretches: list[list[bytes]], seed: int) -> tuple[Network, dict[str, np.ndarray]]:
    """The network fitted to the stretches, and the sums of its squared steps."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype("float32")
    net = Network(
        small(ROWS, HIDDEN), 1 + small(len(OFFSETS), HIDDEN), np.zeros(HIDDEN, "float32"), np.zeros((CLASSES, HIDDEN), "float32"),
        np.zeros((CLASSES, LEAVES, HIDDEN), "float32"),
    )
    sums = {k: np.full_like(getattr(net, k), 1e-3) for k in TABLES}
    hashes = [_hashes.array(s) for s in stretches if s]
    if hashes:
        counts = np.bincount(leaves_of(np.concatenate(hashes)), minlength=CLASSES * LEAVES) + 1
        for _ in range(EPOCHS):
            turned = [hashes[k] for k in rng.permutation(len(hashes))]
            flat = np.concatenate(turned)
            _go_over(net, sums, *line(rows_of(flat), leaves_of(flat), np.array([len(h) for h in turned])), counts, BATCH)
    return net, sums


@dataclass
class Stretches:
    """What a network is fitted to: stretches to start from, all blocks, and the corpus's counts of leaves."""

    first: list[list[bytes]]
    blocks: DataFrame
    counts: np.ndarray


def train(stretches: Stretches | list[list[bytes]], seed: int = 5) -> Network:
    """The network fitted to all blocks, or to a list of stretches alone, whose own counts of leaves (and one more each) stand
    for the corpus's."""
    if isinstance(stretches, list):
        return _start(stretches, seed)[0]
    net, sums = _start(stretches.first, seed)
    for turn in range(ROUNDS):
        net = _averaged(net, sums, stretches.blocks.where(F.col("turn") == turn), stretches.counts)
    return net


def _moved(net: Network, sums: dict[str, np.ndarray], counts: np.ndarray, hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray):
    """``(name, places, change, weight)`` of the tables of a copy that a block's words have moved.

    A weight is how many words of the block had a part in the change.
    """
    # The rows that the block's words have, and the one beyond its texts' ends, as a small table of their own.
    used, own = np.unique(np.concatenate([[OUTSIDE], rows_of(hashes)]), return_inverse=True)
    leaves = leaves_of(hashes)[at]
    ids, y = line(own[1:][at], leaves, sizes)
    copy = Network(net.embed[used], *(getattr(net, k).copy() for k in TABLES[1:]))
    steps = {k: sums[k][used] if k == "embed" else sums[k].copy() for k in TABLES}
    _go_over(copy, steps, ids, y, counts, BLOCK_BATCH)
    yield "embed", used, copy.embed - net.embed[used], np.bincount(ids, minlength=len(used))
    yield "lower", slice(None), copy.lower - net.lower, np.bincount(leaves // LEAVES, minlength=CLASSES)
    for name in ("place", "bias", "upper"):
        yield name, slice(None), getattr(copy, name) - getattr(net, name), np.full(len(getattr(net, name)), len(at))


def _changes(net: Network, sums: dict[str, np.ndarray], counts: np.ndarray):
    """The weighted changes of a task's blocks, added up, as slices of flat tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        B.tidy()
        total = {k: np.zeros(getattr(net, k).shape) for k in TABLES}
        weight = {k: np.zeros(len(getattr(net, k)), dtype=np.int64) for k in TABLES}
        for frame in frames:
            for hashes, lens, body in zip(frame["hashes"], frame["lens"], frame["body"], strict=True):
                at = B.unpack_places(body).astype(np.int64)
                if not len(at):
                    continue
                for name, places, change, n in _moved(net, sums, counts, B.unpack(hashes, "<u8"), at, np.frombuffer(lens, "<i8")):
                    total[name][places] += change * n.reshape(-1, *[1] * (change.ndim - 1))
                    weight[name][places] += n
        if weight["bias"].any():
            flat, weights = (np.concatenate([x[k].ravel() for k in TABLES]) for x in (total, weight))
            yield pd.DataFrame(
                [(k, B.pack(a), B.pack(b)) for k, (a, b) in enumerate(zip(np.array_split(flat, SLICES), np.array_split(weights, SLICES), strict=True))],
                columns=["slice", "total", "weight"],
            )

    return B.tidied(run)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """A slice of all tasks, added up."""
    total, weight = sum(B.unpack(x, "<f8") for x in group["total"]), sum(B.unpack(x, "<i8") for x in group["weight"])
    return pd.DataFrame([(group["slice"].iloc[0], B.pack(total), B.pack(weight))], columns=["slice", "total", "weight"])


def _averaged(net: Network, sums: dict[str, np.ndarray], blocks: DataFrame, counts: np.ndarray) -> Network:
    """The mean of the copies that the blocks move."""
    kind = "slice long, total binary, weight binary"
    # A task has the blocks of many files, so that networks to be added up grow with the cluster, not with the corpus.
    few = blocks.select("hashes", "lens", "body").coalesce(4 * blocks.sparkSession.sparkContext.defaultParallelism)
    made = few.mapInPandas(_changes(net, sums, counts), kind).groupBy("slice").applyInPandas(_summed, kind).orderBy("slice").collect()
    if not made:
        return net
    total, weight = (np.concatenate([B.unpack(r[k], t) for r in made]) for k, t in (("total", "<f8"), ("weight", "<i8")))
    out, low, at = [], 0, 0
    for old in (getattr(net, k) for k in TABLES):
        change, n = total[low : low + old.size].reshape(old.shape), weight[at : at + len(old)]
        out.append((old + change / np.maximum(n, 1).reshape(-1, *[1] * (old.ndim - 1))).astype("float32"))
        low, at = low + old.size, at + len(old)
    return Network(*out)


def _first(docs: DataFrame, n_docs: int) -> list[list[bytes]]:
    """SAMPLE_ROWS stretches at most, from rows and places picked by hash."""
    turn = _turn()
    w = words(F.col("text"))
    spare = F.greatest(F.size("w") - SAMPLE_WORDS, F.lit(0)) + 1
    first = F.pmod(F.xxhash64("turn"), spare).cast("int") + 1
    share = min(1.0, (1.2 * SAMPLE_ROWS + 100) / max(1, n_docs))
    picked = (
        docs.select(turn.alias("turn"), "text")
        .where(F.col("turn") / F.lit(2.0**63) <= share)
        .select("turn", w.alias("w"))
        .where(F.size("w") > 0)
        .select("turn", F.slice("w", first, SAMPLE_WORDS).alias("w"))
        .orderBy("turn", "w")
        .limit(SAMPLE_ROWS)
    )
    return [[x.encode() for x in r["w"]] for r in picked.collect()]


def _turn() -> Column:
    """A number of 63 bits by id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mask"), "doc_id", text_hash()), 1)


def sample(docs: DataFrame, n_docs: int) -> Stretches:
    """What the network is fitted to: nothing is left out of it but the start, which is of a few stretches."""
    return _stretches(docs, n_docs, _blocks(docs).where("kind = 'documents'"))


def _stretches(docs: DataFrame, n_docs: int, kept: DataFrame) -> Stretches:
    # A sum for each of CLASSES * LEAVES leaves, however many blocks there are.
    summed = kept.select(F.posexplode("leaves").alias("leaf", "n")).groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES * LEAVES, dtype=np.int64)
    counts[[r["leaf"] for r in summed]] = [r["n"] for r in summed]
    return Stretches(_first(docs, n_docs), kept, counts)


_SPLIT = "kind string, turn int, shard long, block long, ids binary, lens binary, body binary, counts binary, hashes binary, leaves array<long>"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, the place of every word in the list of distinct ones, and this list, in order of first sight."""
    split = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))  # as bytes.split(), but that ends of white space leave empty words
    flat = split.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    ends = np.concatenate([[0], np.cumsum(real)])[np.asarray(split.offsets) - split.offsets[0].as_py()]
    found = flat.filter(pa.array(real)).view(pa.binary()).dictionary_encode()
    return np.diff(ends).astype("<i8"), np.asarray(found.indices).astype("<u4"), found.dictionary.to_numpy(zero_copy_only=False).tolist()


def _digests(listed: list[bytes]) -> np.ndarray:
    """Hashes of distinct words; those of a block are too many to be remembered."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed), dtype=np.uint64, count=len(listed))


def _cut(n_shards: int):
    """A block as places in its list of distinct words, and these words by shard with their counts."""

    def run(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        texts = group["text"].combine_chunks()
        has, ids = ~np.asarray(group["doc_id"].is_null()), np.asarray(group["doc_id"].fill_null(0))
        order = np.lexsort((np.array([hash_of(t or b"") for t in texts.to_pylist()]), ids, has))
        sizes, at, listed = _words(texts.take(pa.array(order)))
        counts = np.bincount(at, minlength=len(listed)).astype("<u4")
        hashes = _digests(listed)
        leaves = np.bincount(leaves_of(hashes), counts, CLASSES * LEAVES).astype(np.int64)
        rows = [("documents", block % ROUNDS, -1, block, B.pack_ids(ids[order], has[order]), sizes.tobytes(), B.pack_places(at), None,
                 B.pack(hashes), leaves.tolist())]
        for shard, part in B.by_shard(hashes, n_shards):
            lens, body = B.join_parts([listed[k] for k in part])
            rows.append(("words", 0, shard, block, B.pack_places(part.astype("<u4")), lens, body, B.pack_places(counts[part]), None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return run


_ARROW = pa.schema([
    ("kind", pa.string()), ("turn", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()),
    ("body", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("leaves", pa.list_(pa.int64())),
])


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of about BLOCK_BYTES of text, dealt out by a hash of rows, and their words by shard."""
    size = B.text_bytes(docs)
    n_shards, n_blocks = B.shards_of(size), max(1, -(-size // BLOCK_BYTES))
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(B.MOST_BUCKETS, max(n_buckets, n_blocks))
    dealt = docs.select(F.pmod(_turn(), F.lit(n_blocks)).alias("block"), "doc_id", F.col("text").cast("binary").alias("text"))
    return materialize(
        dealt.groupBy("block").applyInArrow(_cut(n_shards), _SPLIT), "masked", partition_by=("kind", "turn"), buckets=(n_buckets, "block")
    )


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """For each block of a shard, its words' totals over all blocks, and their hashes."""
    known, of_block, counts = B.Places(), [], []
    for lens, body, n in zip(group["lens"], group["body"], group["counts"], strict=True):
        of_block.append(np.array([known[w] for w in B.split_parts(lens, body)], dtype=np.int64))
        counts.append(B.unpack_places(n).astype(np.int64))
    total = np.zeros(len(known), dtype=np.int64)
    for at, n in zip(of_block, counts, strict=True):
        total[at] += n  # a block lists a word once
    hashes = _digests(list(known))
    rows = [
        (block, places, B.pack(total[at].astype("<i8")), B.pack(hashes[at]))
        for block, places, at in zip(group["block"], group["ids"], of_block, strict=True)
    ]
    return pd.DataFrame(rows, columns=["block", "places", "totals", "hashes"])


def _score(net: Network, counts: np.ndarray):
    priors = _logs(counts)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        ids, has = B.unpack_ids(row["ids"])
        sizes = np.frombuffer(row["lens"], "<i8")
        at = B.unpack_places(row["body"]).astype(np.int64)
        n = int(at.max()) + 1 if len(at) else 0
        share, rows, leaves = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for places, totals, hashes in zip(right["places"], right["totals"], right["hashes"], strict=True):
            k, h = B.unpack_places(places), B.unpack(hashes, "<u8")
            rows[k], leaves[k] = rows_of(h), leaves_of(h)
            share[k] = np.log(B.unpack(totals, "<i8") / counts[leaves[k]])
        own, leaf, value = rows[at], leaves[at], share[at]
        places, leaf = line(own, leaf, sizes)
        done = 0
        for low in range(REACH, len(places) - REACH, CHUNK):
            high = min(low + CHUNK, len(places) - REACH)
            real = np.flatnonzero(leaf[low:high] >= 0)
            h = net.along(net.embed[places[low - REACH : high + REACH]])
            value[done : done + len(real)] += net.logs(leaf[low:high][real], h[real], *priors)
            done += len(real)
        sums, ends = np.concatenate([[0.0], np.cumsum(value)]), np.cumsum(sizes)
        logs = sums[ends] - sums[ends - sizes]
        return pd.DataFrame(
            {"doc_id": pd.array([int(i) if h else None for i, h in zip(ids, has, strict=True)], dtype="Int64"),
             "n_words": sizes, "log_prob": logs, "score": [a / k if k else None for a, k in zip(logs, sizes.tolist(), strict=True)]}
        )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_prob, score``: the sum of conditional log-probabilities and its mean a word."""
    split = _blocks(docs)
    kept = split.where("kind = 'documents'")
    n_docs = kept.agg(F.sum(F.octet_length("lens") / 8).cast("long").alias("n")).first()["n"]
    fitted = _stretches(docs, n_docs or 0, kept)
    net, counts = train(fitted), fitted.counts
    kept = kept.select("block", "ids", "lens", "body")
    told = (
        split.where("kind = 'words'")
        .select("shard", "block", "ids", "lens", "body", "counts")
        .groupBy("shard")
        .applyInPandas(_totals, "block long, places binary, totals binary, hashes binary")
    )
    return kept.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        _score(net, counts), "doc_id long, n_words long, log_prob double, score double"
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pseudo_likelihood": _query}
ORACLES: dict[str, str] = {}
