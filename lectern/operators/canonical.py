"""Canonical records: conflicts, equal texts, pointers and reply context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.components import connected_components
from lectern.storage import materialize


def collapse_ids(rows: DataFrame, *, payload: list[str], order: str) -> DataFrame:
    """One row for each id whose members agree on ``payload`` (nulls included).

    Adds ``members`` and ``conflict``; the payload is that of the first member
    by ``order``.  One aggregation with map-side combine, so a much repeated id
    isn't gathered in one place.
    """
    packed = F.struct(*[F.col(c) for c in payload])
    return (
        rows.groupBy("id")
        .agg(
            F.count("*").alias("members"),
            (F.min(F.xxhash64(F.to_json(packed))) != F.max(F.xxhash64(F.to_json(packed)))).alias("conflict"),
            F.min(F.struct(F.col(order), packed.alias("p"))).alias("first"),
        )
        .select("id", "members", "conflict", *[F.col(f"first.p.{c}").alias(c) for c in payload])
    )


def exact_text_groups(rows: DataFrame) -> DataFrame:
    """``text_sha256, group_id, n, ids`` for each text of several rows; grouped by digest, not by text."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return (
        rows.where("text <> ''")
        .groupBy(digest.alias("text_sha256"))
        .agg(F.min("id").alias("group_id"), F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
        .where("n > 1")
    )


def shared_text_components(rows: DataFrame) -> DataFrame:
    """``grp, component``: groups joined by any equal non-empty text, named by the smallest."""
    texts = rows.where("text <> ''").select("grp", F.sha2(F.col("text").cast("binary"), 256).alias("t")).distinct()
    # A star for each text: every group to the smallest one, so a common text adds one edge a group.
    least = texts.groupBy("t").agg(F.min("grp").alias("least"))
    edges = texts.join(least, "t").select("grp", "least").distinct()
    every = rows.select("grp").distinct()
    found = connected_components(edges, "grp", "least").withColumnRenamed("node", "grp")
    return every.join(found, "grp", "left").select("grp", F.coalesce("component", "grp").alias("component"))


def unresolved_pointers(rows: DataFrame, scope: str, own: str, pointer: str) -> DataFrame:
    """Rows whose non-zero pointer names no row of their scope."""
    known = rows.select(F.col(scope).alias(scope), F.col(own).alias(pointer)).distinct()
    return rows.where(F.col(pointer) != "0").join(known, [scope, pointer], "left_anti")


def root_context(rows: DataFrame) -> DataFrame:
    """Each row with its root's id and text; ``context_issue`` where the root is missing."""
    roots = rows.select("scope", F.col("own").alias("root"), F.col("id").alias("root_id"), F.col("text").alias("root_text"))
    needs = (F.col("root") != "0") & (F.col("root") != F.col("own"))
    return rows.join(roots, ["scope", "root"], "left").select(
        "id",
        F.when(needs, F.col("root_id")).alias("context_id"),
        F.when(needs, F.col("root_text")).alias("context_text"),
        F.when(needs & F.col("root_id").isNull(), "incomplete_context").alias("context_issue"),
    )


_WALKED = "id string, chain_length long, top_id string, issue string"


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The walks of one scope's rows that are marked ``open``, parent by parent."""
    by_own: dict[str, list[tuple]] = {}
    for own, parent, i in zip(rows["own"], rows["parent"], rows["id"], strict=True):
        by_own.setdefault(own, []).append((parent, i))
    out = []
    for own, parent, i in rows.loc[rows["open"], ["own", "parent", "id"]].itertuples(index=False):
        left = [(parent, {own}, 0, None)]
        while left:
            next_, seen, n, top = left.pop()
            while next_ is not None and next_ != "0":
                if next_ in seen or next_ not in by_own:
                    out.append((i, n, top, "context_cycle" if next_ in seen else "incomplete_context"))
                    break
                seen.add(next_)
                (parent, top), *others = by_own[next_]
                n += 1
                left += [(p, set(seen), n, t) for p, t in others]
                next_ = parent
            else:
                if next_ is not None:
                    out.append((i, n, top, None))
    return pd.DataFrame(out, columns=["id", "chain_length", "top_id", "issue"])


def parent_chains(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``id, chain_length, top_id, context_issue`` by a walk up the parents, of any length.

    ``rows`` has ``scope, own, parent, root, id``.  A walk stops at a parent of
    ``0``, a missing one, or one that it has met.  Every round doubles the steps
    of all walks; as long as one without a cycle is open, some walk ends in the
    next round, so what is open after a round that ends none meets a cycle, and
    is walked by scope.
    """
    rows = rows.select("scope", "own", "parent", "root", "id")
    parents = rows.select("scope", F.col("own").alias("parent"), F.col("id").alias("to"))
    met = F.col("to").isNotNull()
    state = materialize(
        rows.where("parent is not null").join(parents, ["scope", "parent"], "left").select(
            "scope", "id", "to",
            F.when(met & (F.col("parent") != "0"), 1).otherwise(0).cast("long").alias("n"),
            F.when(F.col("parent") != "0", F.col("to")).alias("top_id"),
            F.when(~met & (F.col("parent") != "0"), "incomplete_context").alias("issue"),
            (~met | (F.col("parent") == "0")).alias("done"),
        ),
        "chains",
    )
    while True:
        on = state.select(
            "scope", F.col("id").alias("to"), F.col("to").alias("on"), F.col("n").alias("m"),
            F.col("top_id").alias("above"), F.col("issue").alias("why"), F.col("done").alias("ends"),
        )
        moved = materialize(
            state.where("not done").join(on, ["scope", "to"]).select(
                "scope", "id", F.col("on").alias("to"), (F.col("n") + F.col("m")).alias("n"),
                F.coalesce("above", "top_id").alias("top_id"), F.col("why").alias("issue"), F.col("ends").alias("done"),
            ),
            "chains-moved",
        )
        if moved.where("done").isEmpty():
            break
        state = materialize(state.where("done").unionByName(moved), "chains")
    still = state.where("not done").select("scope", "id").distinct()
    ended = state.where("done").join(still, ["scope", "id"], "left_anti")
    ended = ended.select("id", F.col("n").alias("chain_length"), "top_id", "issue")
    round_ = rows.join(still.select("scope").distinct(), "scope", "left_semi").join(
        still.withColumn("open", F.lit(True)), ["scope", "id"], "left"
    )
    round_ = round_.select("scope", "own", "parent", "id", F.coalesce("open", F.lit(False)).alias("open"))
    walked = ended.unionByName(round_.groupBy("scope").applyInPandas(lambda frame: _walk(frame), _WALKED))
    tops = rows.select("scope", F.col("own").alias("root"), F.col("id").alias("root_id"))
    mismatch = (F.col("root") != "0") & (F.col("chain_length") > 0) & ~F.col("top_id").eqNullSafe(F.col("root_id"))
    return (
        walked.join(rows.select("id", "scope", "root"), "id")
        .join(tops, ["scope", "root"], "left")
        .select(
            "id", "chain_length", "top_id",
            F.coalesce("issue", F.when(mismatch, "context_root_mismatch")).alias("context_issue"),
        )
    )


def first_seen(rows: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """``id, duplicate_of``: later rows of a key point at its first one by ``order``.

    The first is found by an aggregation, and later rows by a join that
    adaptive execution can split, so a very common key is no single task.
    """
    firsts = rows.groupBy(key).agg(F.min(F.struct(*order, F.col("id").alias("_first")))["_first"].alias("first_id"))
    return rows.join(firsts, key).select("id", F.when(F.col("id") != F.col("first_id"), F.col("first_id")).alias("duplicate_of"))


def quota_sample(rows: DataFrame, *, group: str, key: str, n: int) -> DataFrame:
    """The n rows of each group that are first by the hash of ``key``."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.col(key).cast("binary"), 256), key)
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)
