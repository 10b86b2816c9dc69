"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the line
is cut into blocks of equal token counts.  Schedule slots are golden-ratio
points mapped through the sources' cumulative shares, so any stretch of the
schedule has nearly the target proportions.  A source's slots are ranked, and
the slot of rank r takes the source's block r modulo its number of blocks.

Ranks and offsets are prefix sums in two levels (within bounded chunks, and
over the chunks' totals), so no source, however large, is sorted in one task.

Cases: a null text has size 0 and takes nothing; a null source is a source of
its own, last in order; an empty table gives no rows; the shuffle is by doc_id
and text, so rows that lack or repeat a doc_id are each laid out by their own
text, and rows that are equal in both may stand for each other; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, text_hash
from lectern.storage import materialize, table

#: Weights dealt to the sources in code-point order, null last.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
MOST_REPEATS = 3
BLOCK_TOKENS = 1024
#: Documents in a chunk of a source's shuffled line, and slots in a chunk of the schedule.
CHUNK_ROWS = 4_000
SLOT_CHUNK = 65_536
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which slots find their source.
CELLS = 4096


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, sid, source_size, target`` with one row a source.

    ``sid`` is the source's place in code-point order, null last.  Targets share
    all sizes by weight; none passes MOST_REPEATS times its source's size, and
    what that cuts off is shared by weight among the rest.  The sources that
    stop are those of the smallest limit per weight, so one pass over the
    aggregated sources in that order finds the common level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("sid", sid.cast("long"))
    dealt = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(dealt, (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * MOST_REPEATS)
    per = per.withColumn("stop_at", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    order = Window.orderBy("stop_at", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(rest))
    per = per.withColumn("stops", F.col("stop_at") <= F.col("level"))
    # The first source that doesn't stop has the common level.
    common = F.min(F.when(~F.col("stops"), F.struct("stop_at", "sid", "level"))).over(every)["level"]
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(common * F.col("weight"))
    return per.select("source", "sid", "source_size", target.alias("target"))


def source_needs(targets: DataFrame) -> DataFrame:
    """Blocks, slots and the share of the unit interval that a source gets."""
    out = (
        targets.where("source_size > 0")
        .withColumn("take", F.least(F.floor("target"), F.col("source_size") * MOST_REPEATS).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_TOKENS).cast("long"))
        .withColumn("full", F.floor(F.col("take") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_TOKENS).cast("long"))
        .where("slots > 0")
        .withColumn("high", F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    )
    low, high = (F.col("high") - F.col("slots")) / F.col("all_slots"), F.col("high") / F.col("all_slots")
    return out.select("sid", "blocks", "full", "rest", "slots", "all_slots", low.alias("low"), high.alias("high"))


def slot_schedule(spark: SparkSession, needs: DataFrame) -> DataFrame:
    """``slot, sid, rank``: the schedule, each source's slots ranked from 0.

    A source gets exactly the slots it needs: what the points deal out beyond
    that is left out, and what they leave short follows at the end.
    """
    n = needs.agg(F.coalesce(F.max("all_slots"), F.lit(0)).alias("n")).first()["n"]
    points = spark.range(n).select(
        F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("u")
    )
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    ends = [F.floor(F.col(c) * CELLS).cast("int") for c in ("low", "high")]
    cells = needs.select("sid", "low", "high", "slots", F.explode(F.sequence(*ends)).alias("cell"))
    dealt = (
        points.join(cells, "cell")
        .where("u >= low and u < high")
        .select("slot", "sid", "slots", F.floor(F.col("slot") / SLOT_CHUNK).cast("long").alias("chunk"))
    )
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = dealt.withColumn("r", F.row_number().over(own) - 1).join(bases, ["sid", "chunk"])
    cut = ranked.select("slot", "sid", (F.col("base") + F.col("r")).alias("rank"), "slots").where("rank < slots")
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    short = needs.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    tail = short.select("sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    return cut.drop("slots").unionByName(tail.select((F.col("rank") + n).alias("slot"), "sid", "rank"))


def shuffled_lines(sized: DataFrame, n_rows: int) -> DataFrame:
    """``sized`` rows of some size with ``start``, their place in their source's shuffled line."""
    chunks = max(1, -(-n_rows // CHUNK_ROWS))
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), 1)
    lined = sized.where("size > 0").withColumn("turn", turn)
    lined = lined.withColumn("chunk", F.floor(F.col("turn") / F.lit(2.0**63) * chunks).cast("long"))
    totals = lined.groupBy("sid", "chunk").agg(F.sum("size").alias("t"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", "chunk", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("sid", "chunk").orderBy("turn", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = lined.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    start = (F.col("base") + F.col("before")).alias("start")
    return lined.join(bases, ["sid", "chunk"]).select("doc_id", "text_hash", "sid", "size", start)


def mixture(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, text_hash`` for each row of ``docs``."""
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select("doc_id", text_hash().alias("text_hash"), "source", n_words.alias("size")), "sizes")
    n_rows = sizes.count()
    targets = materialize(source_targets(sizes, weights=weights), "targets")
    ids = targets.select(F.col("source").alias("s"), "sid")
    sized = sizes.join(ids, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "text_hash", "sid", "size")
    needs = source_needs(targets)
    # A slot takes its block whole, but for the last pass, which ends after `rest` tokens.
    whole = F.floor(F.col("rank") / F.col("blocks")) < F.col("full")
    passes = slot_schedule(docs.sparkSession, needs).join(needs.select("sid", "blocks", "full", "rest"), "sid").select(
        "sid",
        (F.col("rank") % F.col("blocks")).alias("block"),
        F.when(~whole, F.col("rest")).alias("cut"),
    )
    used = passes.groupBy("sid", "block").agg(
        F.count_if(F.col("cut").isNull()).alias("times"), F.max("cut").alias("cut")
    )
    lines = materialize(shuffled_lines(sized, n_rows), "lines")
    first = F.floor(F.col("start") / BLOCK_TOKENS).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_TOKENS).cast("long")
    pieces = lines.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK_TOKENS)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_TOKENS)
    # `least` skips nulls, so a block that the last pass doesn't reach needs its own case.
    last_pass = F.when(F.col("cut").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(high, F.col("cut")) - low))
    part = (high - low) * F.col("times") + last_pass
    taken = (
        pieces.join(used, ["sid", "block"])
        .select("sid", "start", part.alias("part"))
        .groupBy("sid", "start")
        .agg(F.sum("part").alias("taken"))
    )
    placed = lines.join(taken, ["sid", "start"], "left").select(
        "doc_id", "text_hash", "sid", "size", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    nothing = sized.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    per = targets.select("sid", "source_size", "target")
    return placed.unionByName(nothing).join(per, "sid").select("doc_id", "size", "source_size", "target", "taken", "text_hash")


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, to the nearest whole time.

    Rows decide, not ids; rows of the same doc_id and text are repeated alike.
    """
    mix = materialize(mixture(docs), "mix")
    share = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    often = mix.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max(share).alias("_times"))
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), text_hash().alias("_text"))
    joined = own.join(often.where("_times > 0"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op5_mixing": _query}
ORACLES: dict[str, str] = {}
