"""Near-duplicate groups by an LSH forest of sorted MinHash signatures.

Rows of equal shingle sets are first collapsed to one node.  Every tree orders
the nodes by its own sequence of MinHash values; a node's candidates are the
neighbours with which it shares the longest prefix, so the depth at which a
region is cut adapts to how crowded it is, and a region of any size gives a
number of candidates in proportion to its rows.  Candidates are confirmed on
their full shingle sets and linked; connected components follow.

The first round takes FIRST_TREES trees and links most copies.  From then on
only mixed regions count, those of a common prefix whose nodes are of several
components: one aggregation over all trees finds them, and no other row of the
forest is ever written.  In them every node is compared with the nearest
neighbours of *other* components, and of the pairs between the same two components
the most alike one goes on, so a round's pairs grow with the components that meet,
not with their rows; it ends when a round frees few rows.  These rounds only save
work, so where a batch or a partition ends makes no difference: last,
every mixed region is exhausted where it lies, so no neighbour hides another: all
its pairs of different components are compared by size, sketch and MinHash
values, the sets of those that pass are brought to the region, and only links
leave it.  A pair is looked at in the first tree whose region both its nodes are
in.

The orders are range-partitioned on the whole key with the node, so a region that
holds a third of all rows lies in many partitions.  A region of more rows than
one task compares is dealt into chunks, and every two chunks meet in a group of
their own, but for those of one and the same component.

Cases: a null text, or one without words, has no shingles and is linked with
nothing; fewer than five words make one shingle; ties in a tree's order are
ordered by node; rows that repeat a doc_id are linked each by its own text, and
a component is named by its smallest doc_id; a row without doc_id is compared
with none and has no component; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.common import drop_repeats, drop_rows, hash_of, hinted, text_hash
from lectern.operators.components import connected_components
from lectern.storage import materialize, release, table

SHINGLE = 5
#: Links have 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
TREES = 28
#: Trees of the first round, which links most copies; the others see only what is still apart.
FIRST_TREES = 4
#: MinHash values of a tree's order, 16 bits each, and the shortest common prefix that makes a candidate.
DEPTH = 8
LEAST_DEPTH = 3
#: MinHash functions; a tree starts with four that no other tree starts with.
FUNCTIONS = 4 * TREES
#: Of each MinHash value two bits travel along; pairs at similarity PERCENT agree in 0.8125 of them on average, with a
#: deviation of 0.037, and are compared on their full sets if they agree in so many.
LEAST_AGREEMENT = int(FUNCTIONS * 0.628)
#: Neighbours of other components, on each side, that a document is compared with; in the first round the next one.
NEIGHBOURS = 2
#: Rounds of neighbours at most, before all mixed regions are exhausted.
MOST_ROUNDS = 8
#: Another round follows only where the last one left at most this share of the mixed regions' rows.
FREED_SHARE = 0.9
#: Rows of a region that are compared in one group; a larger one is dealt into chunks of half as many.
REGION_ROWS = 4096
#: Shingles of the sets that meet in one group, which bounds its memory (8 bytes each).
REGION_SHINGLES = 4_000_000
#: Common values of the FUNCTIONS: pairs at similarity PERCENT have 84 of 112 on average, with a deviation of 4.6; five
#: deviations less are compared on their full sets.
LEAST_COMMON = int(FUNCTIONS * 0.545)
#: Rows of the sorted orders in a partition, about.
SORTED_ROWS = 200_000

_hashes = B.WordHashes()
#: For each byte, how many of its four two-bit fields are zero.
_ALIKE = np.array([sum(not (b >> k) & 3 for k in (0, 2, 4, 6)) for b in range(256)], dtype=np.uint8)
_FACTORS = B.mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = B.mix(np.arange(1001, FUNCTIONS + 1001, dtype=np.uint64))
#: For each tree, the functions in order: its own four, then those of the trees that follow.
_ORDERS = np.array([[(4 * t + (j if j < 4 else 4 + 5 * (j - 4))) % FUNCTIONS for j in range(DEPTH)] for t in range(TREES)])


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: ASCII alone in both
    if not words:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, len(words))
    return np.unique(B.rolling(_hashes.array(words), k) ^ np.uint64(k))


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's set: its size, its digest and its MinHash values."""
    for _, ids, has, texts in B.cut(frames):
        sets = [shingles(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        full = np.flatnonzero(sizes)
        lows = np.empty((len(full), FUNCTIONS), dtype="<u2")
        if len(full):
            flat = np.concatenate([sets[k] for k in full])
            starts = np.cumsum(sizes[full]) - sizes[full]
            for f in range(FUNCTIONS):
                low = np.minimum.reduceat(flat * _FACTORS[f] + _SHIFTS[f], starts)
                lows[:, f] = (B.mix(low) >> np.uint64(48)).astype("<u2")
        packed = [b""] * len(texts)
        for row, k in zip(lows, full.tolist(), strict=True):
            packed[k] = row.tobytes()
        yield pd.DataFrame(
            {
                "doc_id": pd.array(np.where(has, ids, 0), dtype="Int64").copy(),
                "has": has,
                "text_hash": np.array([hash_of(t) for t in texts], dtype=np.int64),
                "n_shingles": sizes.astype("int64"),
                "set_key": keys,
                "lows": packed,
            }
        )


def _lows(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["lows"]), dtype="<u2").reshape(len(frame), FUNCTIONS)


def _sketches(lows: np.ndarray) -> np.ndarray:
    """Two bits of each value, four to a byte."""
    bits = (lows & 3).astype("u1").reshape(len(lows), FUNCTIONS // 4, 4)
    return bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6


def _regions(lows: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The region of each row in its tree: a hash of the tree and the first LEAST_DEPTH values of its order."""
    out = B.mix(tree.astype(np.uint64) + np.uint64(1))
    for j in range(LEAST_DEPTH):
        out = B.mix(out ^ lows[np.arange(len(lows)), _ORDERS[tree, j]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``region, tree, node, comp`` for every tree."""
    B.tidy()
    for frame in frames:
        if not len(frame):
            continue
        lows, m = _lows(frame), len(frame)
        for t in range(TREES):
            tree = np.full(m, t, dtype="int32")
            yield pd.DataFrame({"region": _regions(lows, tree), "tree": tree, "node": frame["node"], "comp": frame["comp"]})


def _ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one tree each, with their sign (the tree's order of values) and sketch in place of all values."""
    for frame in frames:
        if not len(frame):
            continue
        lows = _lows(frame)
        tree = frame["tree"].to_numpy()
        # Big-endian values sort as bytes in the order of their numbers.
        signs = np.take_along_axis(lows, _ORDERS[tree], axis=1).astype(">u2")
        rest = frame.drop(columns="lows")
        yield rest.assign(sign=[r.tobytes() for r in signs], sketch=[r.tobytes() for r in _sketches(lows)])


def _candidates(apart: bool):
    """Pairs of near rows of a sorted partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for frame in frames:
            whole = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            yield near_pairs(whole, apart)
            tail = whole.iloc[-_carry(whole, apart) :]

    return run


def _carry(frame: pd.DataFrame, apart: bool) -> int:
    """Rows to hold back, so that the next batch's first ones meet their neighbours."""
    if not apart:
        return NEIGHBOURS
    comp = frame["comp"].to_numpy()
    change = np.flatnonzero(comp[1:] != comp[:-1])
    # The last run's rows look alike to what follows; its edge and the run before it do.
    return max(NEIGHBOURS, min(len(comp), 2 * NEIGHBOURS if not len(change) else len(comp) - int(change[-1]) + NEIGHBOURS - 1, 4096))


def near_pairs(frame: pd.DataFrame, apart: bool) -> pd.DataFrame:
    """Candidates among sorted rows: the next one, or NEIGHBOURS ones of the next other components; one for each two components."""
    m = len(frame)
    if m < 2:
        return pd.DataFrame({"a": np.empty(0, "int64"), "b": np.empty(0, "int64")})
    node, tree, n, comp = (frame[c].to_numpy() for c in ("node", "tree", "n", "comp"))
    signs = np.frombuffer(b"".join(frame["sign"]), dtype=">u2").reshape(m, DEPTH)
    prefix = (signs[1:] == signs[:-1]).cumprod(axis=1).sum(axis=1)
    prefix[tree[1:] != tree[:-1]] = 0
    # Rows between two breaks share at least LEAST_DEPTH values, one after the other.
    region = np.cumsum(np.concatenate([[0], prefix < LEAST_DEPTH]))
    left, right = [], []
    if not apart:
        i = np.flatnonzero(region[1:] == region[:-1])
        left.append(i)
        right.append(i + 1)
    else:
        fresh = np.concatenate([[True], (comp[1:] != comp[:-1]) | (region[1:] != region[:-1])])
        run = np.cumsum(fresh) - 1
        starts = np.append(np.flatnonzero(fresh), m)
        here = np.arange(m)
        for step in range(NEIGHBOURS):
            for other in (starts[run] - 1 - step, starts[run + 1] + step):
                ok = (other >= 0) & (other < m)
                i, j = here[ok], other[ok]
                ok = (region[i] == region[j]) & (comp[i] != comp[j])
                left.append(i[ok])
                right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    # Sets whose sizes differ more can't reach the least similarity; and where neither component took in others in the
    # last round, the neighbours are the same as they were.
    fresh = frame["fresh"].to_numpy(dtype=bool)
    ok = (comp[i] != comp[j]) & (fresh[i] | fresh[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    sketch = np.frombuffer(b"".join(frame["sketch"]), dtype="u1").reshape(m, -1)
    alike = _ALIKE[sketch[i] ^ sketch[j]].sum(axis=1, dtype=np.int64)
    ok = alike >= LEAST_AGREEMENT
    i, j, alike = i[ok], j[ok], alike[ok]
    # One link joins two components, so one pair of theirs goes on.
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    met = pd.DataFrame({"a": a, "b": b, "x": np.minimum(comp[i], comp[j]), "y": np.maximum(comp[i], comp[j]), "alike": -alike})
    return met.sort_values(["alike", "a", "b"]).drop_duplicates(["x", "y"])[["a", "b"]]


def _by_group(of_group):
    """``of_group`` over whole groups; rows come in order of region, group and component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        B.tidy()
        held = None
        for frame in frames:
            whole = frame if held is None else pd.concat([held, frame], ignore_index=True)
            starts = np.flatnonzero(_changes(whole, "region", "grp"))
            for low, high in zip(starts, starts[1:], strict=False):
                yield of_group(whole.iloc[low:high])
            held = whole.iloc[int(starts[-1]) if len(starts) else 0 :].reset_index(drop=True)
        if held is not None and len(held):
            yield of_group(held)

    return run


def _changes(frame: pd.DataFrame, *columns: str) -> np.ndarray:
    """Where a row differs from the one before it; true for the first."""
    out = np.zeros(len(frame), dtype=bool)
    out[:1] = True
    for c in columns:
        values = frame[c].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def cross_pairs(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a group's rows that differ in component and pass the filters, a stretch at a time."""
    m = len(group)
    n, side = (group[c].to_numpy() for c in ("n", "side"))
    lows = _lows(group)
    tree = int(group["tree"].iloc[0])
    earlier = _ORDERS[:tree, :LEAST_DEPTH]
    words = np.zeros((m, -(-FUNCTIONS // 32) * 8), dtype="u1")
    words[:, : FUNCTIONS // 4] = _sketches(lows)
    words = words.view("<u8")
    # Components lie together, so what follows a row's own run is of others.
    runs = _changes(group, "comp")
    i = np.arange(m)
    j = np.append(np.flatnonzero(runs), m)[np.cumsum(runs)]
    while True:
        ok = j < m
        i, j = i[ok], j[ok]
        if not len(i):
            return
        ok = ((side[i] != side[j]) | (side[i] == 0)) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        a, b = i[ok], j[ok]
        apart = words[a] ^ words[b]
        unlike = np.bitwise_count((apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
        ok = FUNCTIONS - unlike >= LEAST_AGREEMENT
        a, b = a[ok], b[ok]
        if len(a):
            same = lows[a] == lows[b]
            ok = same.sum(axis=1) >= LEAST_COMMON
            if tree:
                ok &= ~same[:, earlier].all(axis=2).any(axis=1)
            if ok.any():
                yield a[ok], b[ok]
        j = j + 1


def _needed(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group that are in some pair."""
    hit = np.zeros(len(group), dtype=bool)
    for a, b in cross_pairs(group):
        hit[a] = hit[b] = True
    return group.loc[hit, ["region", "grp", "node"]]


def _links(group: pd.DataFrame) -> pd.DataFrame:
    """The links of a group's pairs, but for those between components that other links have joined already."""
    unzip = zstandard.ZstdDecompressor().decompress
    sets = [shingles(unzip(t)) for t in group["t"]]
    node, comp = group["node"].to_numpy(), group["comp"].tolist()
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for a, b in cross_pairs(group):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(comp[i]), find(comp[j])
            if x == y:
                continue
            one, two = sets[i], sets[j]
            at = np.searchsorted(one, two)
            at[at == len(one)] = 0
            both = int((one[at] == two).sum())
            if 100 * both >= PERCENT * (len(one) + len(two) - both):
                root[max(x, y)] = min(x, y)
                found.append((min(node[i], node[j]), max(node[i], node[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _dealt(forest: DataFrame) -> DataFrame:
    """``forest`` rows with ``grp`` and ``side``, once for each group in which a row is compared.

    Rows of side 0 are compared among themselves, others with the other side.
    """
    half, shingles_ = REGION_ROWS // 2, REGION_SHINGLES // 2
    over = (F.col("crowd") > REGION_ROWS) | (F.col("load") > REGION_SHINGLES)
    crowds = forest.groupBy("region").agg(F.count("*").alias("crowd"), F.sum("n").alias("load")).where(over)
    crowds = materialize(crowds.select("region"), "forest-crowds")
    if crowds.isEmpty():
        return forest.withColumns({"grp": F.lit(0).cast("long"), "side": F.lit(0)})
    listed = hinted(crowds, 24)
    small = forest.join(listed, "region", "left_anti").withColumns({"grp": F.lit(0).cast("long"), "side": F.lit(0)})
    large = forest.join(listed, "region", "left_semi")
    # A component that fills chunks has its own; the others of a region share theirs.
    comps = materialize(
        large.groupBy("region", "comp")
        .agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        .withColumn("big", (F.col("c") > half) | (F.col("w") > shingles_))
        .withColumn("own", F.when(F.col("big"), F.col("comp")).otherwise(0)),
        "forest-comps",
    )
    at = ["region", "big", "own"]
    chunked = F.ceil(F.greatest(F.sum("c") / half, F.sum("w") / shingles_)).cast("long")
    sides = comps.groupBy(*at).agg(chunked.alias("chunks"))
    chunks = materialize(sides.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))), "forest-chunks")
    chunk = F.struct("big", "own", "k")
    left, right = (chunks.select("region", chunk.alias(c)) for c in ("x", "y"))
    met = (
        left.join(right, "region")
        .where("x <= y and not (x.big and y.big and x.own = y.own)")
        .withColumn("grp", F.xxhash64("x", "y"))
    )
    ends = F.when(F.expr("x = y"), F.array(F.struct(F.col("x").alias("c"), F.lit(0).alias("side")))).otherwise(
        F.array(*[F.struct(F.col(c).alias("c"), F.lit(s).alias("side")) for s, c in ((1, "x"), (2, "y"))])
    )
    ends = met.select("region", "grp", F.explode(ends).alias("e")).select("region", "grp", "e.c.*", "e.side")
    placed = (
        large.join(comps.drop("c", "w"), ["region", "comp"])
        .join(sides, at)
        .withColumn("k", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .drop("chunks")
    )
    return small.unionByName(placed.join(ends, [*at, "k"]).select(small.columns))


def exhausted(docs: DataFrame, nodes: DataFrame, forest: DataFrame, n_rows: int) -> DataFrame:
    """The links of all pairs that any region holds; sets travel to the regions, pairs nowhere."""
    at = ["region", "grp"]
    parts = _parts(forest, n_rows)
    dealt = _dealt(forest.select("region", "tree", "node", "n", "comp")).join(nodes.select("node", "lows"), "node")
    dealt = materialize(dealt, "forest-dealt")
    met = dealt.repartition(parts, *at).sortWithinPartitions(*at, "comp", "node")
    needed = materialize(met.mapInPandas(_by_group(_needed), "region long, grp long, node long"), "forest-needed")
    texts = _texts(docs, nodes, needed.select("node").distinct())
    asked = dealt.join(needed, [*at, "node"], "left_semi").join(texts, "node")
    asked = asked.repartition(parts, *at).sortWithinPartitions(*at, "comp", "node")
    links = materialize(asked.mapInPandas(_by_group(_links), "a long, b long").distinct(), "forest-links")
    release(dealt, needed, texts)
    return links


def _parts(rows: DataFrame, n_rows: int) -> int:
    return max(1, -(-n_rows // SORTED_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sorted_pairs(rows: DataFrame, n_rows: int, apart: bool) -> DataFrame:
    """Distinct candidate pairs over all trees' orders."""
    order = ["tree", "sign", "node"]
    dealt = rows.repartitionByRange(_parts(rows, n_rows), *order).sortWithinPartitions(*order)
    return dealt.select(*order, "sketch", "n", "comp", "fresh").mapInPandas(_candidates(apart), "a long, b long").distinct()


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    B.tidy()
    unzip = zstandard.ZstdDecompressor().decompress
    for frame in frames:
        hit, last, own = [], None, None
        for a, ta, tb in zip(frame["a"], frame["ta"], frame["tb"], strict=True):
            if a != last:
                last, own = a, shingles(unzip(ta))
            other = shingles(unzip(tb))
            both = len(np.intersect1d(own, other, assume_unique=True))
            hit.append(100 * both >= PERCENT * (len(own) + len(other) - both))
        yield frame.loc[hit, ["a", "b"]]


def _zip_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for frame in frames:
        yield pd.DataFrame({"node": frame["node"], "t": [pack(bytes(t) if t is not None else b"") for t in frame["text"]]})


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``node, t``: the compressed texts of the nodes asked for, on shared storage."""
    ends = materialize(nodes.select("node", "head", "head_hash").join(asked, "node", "left_semi"), "forest-ends")
    raw = docs.select(F.col("doc_id").alias("head"), text_hash().alias("head_hash"), F.col("text").cast("binary").alias("text"))
    texts = (
        raw.join(hinted(ends, 40), ["head", "head_hash"])
        .select("node", "text")
        .mapInPandas(_zip_texts, "node long, t binary")
        .dropDuplicates(["node"])
    )
    return materialize(texts, "forest-texts")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose full shingle sets are similar enough."""
    texts = _texts(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b"
    )
    out = materialize(both.select("a", "b", "ta", "tb").mapInPandas(_confirm, "a long, b long"), "forest-links")
    release(texts)
    return out


def joined_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component, fresh`` after more links: the components of components, a much smaller graph.

    ``fresh`` marks the components that the links have changed.
    """
    # A node without a link so far is a component of its own.
    parts = parts.select("node", "component")
    known = parts.unionByName(
        links.select(F.explode(F.array("a", "b")).alias("node"))
        .distinct()
        .join(parts, "node", "left_anti")
        .select("node", F.col("node").alias("component"))
    )
    known = materialize(known, "forest-known")
    over = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
    )
    merged = connected_components(over, "ca", "cb", contract=True).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return known.join(merged, "component", "left").select(
        "node", F.coalesce("root", "component").alias("component"), F.col("root").isNotNull().alias("fresh")
    )


def _mixed(places: DataFrame) -> DataFrame:
    """``region``: those whose rows are of several components."""
    per = places.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return materialize(per.where("low < high").select("region"), "forest-mixed")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for each row of ``docs``."""
    signed = materialize(
        B.raw(docs).mapInPandas(_sign, "doc_id long, has boolean, text_hash long, n_shingles long, set_key binary, lows binary"), "forest-signed"
    )
    rows = signed.select(F.when(F.col("has"), F.col("doc_id")).alias("doc_id"), "text_hash", "n_shingles", "set_key")
    # One node for each set; equal sets have equal values.  A row without shingles stands for itself.
    sets = (
        signed.where("has and n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("lows").alias("lows"))
    )
    nodes = materialize(
        sets.select(
            F.monotonically_increasing_id().alias("node"),
            "set_key",
            F.col("first.doc_id").alias("head"),
            F.col("first.text_hash").alias("head_hash"),
            "n",
            "lows",
        ),
        "forest-nodes",
    )
    n_nodes = nodes.count()
    alone = (
        nodes.select("node", "n", F.col("node").alias("comp"), F.lit(True).alias("fresh"), "lows")
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(FIRST_TREES - 1))))
        .mapInPandas(_ordered, "node long, n long, comp long, fresh boolean, tree int, sign binary, sketch binary")
    )
    tried = materialize(_sorted_pairs(alone, n_nodes * FIRST_TREES, False), "forest-near")
    links = confirmed(docs, nodes, tried)
    parts = connected_components(links, "a", "b", contract=True).withColumn("fresh", F.lit(True))
    parts = materialize(parts, "forest-parts")
    release(links)
    # The forest: rows of mixed regions.
    own = F.coalesce("component", "node").alias("comp")
    placed = nodes.select("node", "lows").join(parts, "node", "left").select("node", own, "lows")
    placed = materialize(placed, "forest-placed")
    places = placed.mapInPandas(_places, "region long, tree int, node long, comp long")
    mixed = _mixed(places)
    forest = (
        places.join(hinted(mixed, 24), "region")
        .join(nodes.select("node", "n", "lows"), "node")
        .select("region", "node", "n", "comp", F.lit(True).alias("fresh"), "tree", "lows")
        .mapInPandas(_ordered, _FOREST)
    )
    forest = materialize(forest, "forest")
    release(placed, mixed)
    n_rows = forest.count()
    for _ in range(MOST_ROUNDS):
        if not n_rows:
            break
        # Pairs that were compared before can't link now.
        pairs = materialize(_sorted_pairs(forest, n_rows, True).join(tried, ["a", "b"], "left_anti"), "forest-apart")
        tried = tried.unionByName(pairs)
        more = confirmed(docs, nodes, pairs)
        if more.isEmpty():
            break
        before = n_rows
        parts, forest = _after(parts, more, forest)
        n_rows = forest.count()
        if n_rows > FREED_SHARE * before:
            break
    # What neighbours have not shown: every other pair of a mixed region.
    if n_rows:
        more = exhausted(docs, nodes, forest, n_rows)
        if not more.isEmpty():
            parts = materialize(joined_parts(parts, more), "forest-parts")
    release(forest)
    linked = materialize(nodes.join(parts, "node").select("set_key", "head", "component"), "forest-linked")
    named = linked.groupBy("component").agg(F.min("head").alias("component_id"))
    named = linked.join(named, "component").select("set_key", "component_id")
    named = named.unionByName(nodes.join(parts, "node", "left_anti").select("set_key", F.col("head").alias("component_id")))
    grouped = rows.where("doc_id is not null and n_shingles > 0").join(named, "set_key")
    single = rows.where("doc_id is null or n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash"]
    out = grouped.select(columns).unionByName(single.select(columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_FOREST = "region long, node long, n long, comp long, fresh boolean, tree int, sign binary, sketch binary"


def _after(parts: DataFrame, more: DataFrame, forest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components, and the rows of the regions that are still mixed, after more links."""
    old, before = parts, forest
    parts = materialize(joined_parts(parts, more), "forest-parts")
    placed = forest.drop("comp", "fresh").join(parts, "node", "left")
    placed = placed.withColumn("comp", F.coalesce("component", "node")).withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    placed = materialize(placed.drop("component"), "forest")
    mixed = _mixed(placed)
    forest = materialize(placed.join(hinted(mixed, 24), "region"), "forest")
    release(old, before, placed, mixed)
    return parts, forest


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, one of the smallest doc_id.

    Rows decide, not ids: of rows that share a doc_id each goes or stays by its
    own text, and rows of the same doc_id and text stay once.  Rows without
    doc_id or words are in no group and stay.
    """
    found = materialize(near_groups(docs).select("doc_id", "text_hash", "n_shingles", "kept"), "near-kept")
    grouped = found.where("kept and doc_id is not null and n_shingles > 0")
    return drop_repeats(drop_rows(docs, found.where("not kept")), grouped)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op6_lsh_forest": _query}
ORACLES = {
    "op6_lsh_forest": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM t WHERE len(w) > 0),
h AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS k FROM g),
n AS (SELECT doc_id, count(*) AS c FROM h GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM h a JOIN h b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
      WHERE 100 * i.both >= 75 * (x.c + y.c - i.both)),
r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
p AS (SELECT n AS doc_id, min(m) AS component_id FROM r GROUP BY n)
SELECT p.doc_id, coalesce(n.c, 0) AS n_shingles, p.component_id, p.doc_id = p.component_id AS kept
FROM p LEFT JOIN n USING (doc_id)
"""
}
