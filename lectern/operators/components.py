"""Connected components on DataFrames by alternating large-star and small-star.

Each round is two aggregations (with map-side combine) and two equi-joins, so a
node with very many neighbours is pre-aggregated before its key is shuffled and
the join that follows is one that adaptive execution can split.  Lineage is cut
after every round by a table on shared storage.  Nothing is collected but one
flag a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize, release

#: Edges that a task contracts at a time, which bounds its memory.
CONTRACT_EDGES = 1_000_000


def _oriented(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _settled(edges: DataFrame) -> bool:
    """Is every edge one from a node to its root?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(False).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(True).alias("parent"))
    )
    per = ends.groupBy("node").agg(F.sum("child").alias("c"), F.bool_or("parent").alias("p"))
    return per.where("c > 1 or (c = 1 and p)").isEmpty()


def _forest(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """The stars of the components that these edges form by themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Both ends, and what they were labelled by, take the smaller label.
        for target in (a, b, label[a], label[b]):
            np.minimum.at(new, target, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[child], "v": nodes[label[child]]})


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= CONTRACT_EDGES:
            whole = pd.concat(held)
            yield _forest(whole["u"].to_numpy(), whole["v"].to_numpy())
            held, size = [], 0
    if size:
        whole = pd.concat(held)
        yield _forest(whole["u"].to_numpy(), whole["v"].to_numpy())


def connected_components(edges: DataFrame, src: str, dst: str, *, max_rounds: int = 60, contract: bool = False) -> DataFrame:
    """``(node, component)`` for every node of ``edges``.

    ``component`` is the smallest node reachable, the node itself included.
    Direction, repeated edges and self loops don't matter; rows with a null end
    are ignored; no edges give an empty result.  With ``contract`` (nodes must
    be of type long) each task first replaces its own edges by stars, which
    saves rounds; without it everything stays in the JVM.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    apart = pairs.where("a <> b").select(*_oriented(F.col("a"), F.col("b")))

    def shrunk(df: DataFrame) -> DataFrame:
        return df.mapInPandas(_contract, "u long, v long") if contract else df

    current = materialize(shrunk(apart).distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(current):
            break
        own = shrunk(current)
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = materialize(small, "cc")
        release(current)
        current = after
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
