"""Near phrases: an exact similarity join by filters, then the matcher.

Two keys are near when the matcher's ratio ``2M / (n + m)`` reaches :data:`NEAR`.
M is the length of a common subsequence, so a near pair keeps at least
``ceil(NEAR * (n + m) / 2)`` characters; all others are deleted from one side or
inserted on the other.  A deletion breaks at most two of a key's pairs of
neighbouring characters, an insertion one.  So at least ``c`` pairs are left in
both keys, in the same order and not far from the same place.  Of both keys'
pairs, sorted by how rare they are, the first l that are left stand among the
first ``N - c + l`` of each.

Only those prefixes are indexed and joined, by pair of characters; lengths, ranks
and places are compared in the join, and l matches make a candidate.  Candidates
are counted: pairs of the shorter key that stand near their place in the longer
one must be ``c``.  What is left goes through the matcher once for each order of
arguments that rows ask for, as its ratio depends on it.  All this is between
distinct keys; rows with one key share its pairs.

Cases: a null key is near nothing; two empty keys are equal, so no near pair,
and so are near keys of one character; an empty table gives no rows.  A key's
pairs of characters are gathered in one row, as the key itself is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.similarity import NEAR, near_ratio
from lectern.storage import materialize

#: NEAR in hundredths, as the filters reckon in whole numbers.
_HUNDREDTHS = round(NEAR * 100)
#: Matches in the prefixes that make a candidate (fewer where fewer are left): more of them need longer prefixes.
SHARED = 4


def least_kept(n: Column, m: Column) -> Column:
    """Characters that keys of ``n`` and ``m`` characters must keep to be near."""
    return F.ceil((n + m) * _HUNDREDTHS / F.lit(200)).cast("int")


def least_grams(n: Column, m: Column) -> Column:
    """Pairs of neighbouring characters that are left in both keys, of ``n`` and ``m`` characters; at least 1 for near keys."""
    return 3 * least_kept(n, m) - (n + m) - 1


def _shared(n: Column, m: Column) -> Column:
    return F.least(least_grams(n, m), F.lit(SHARED))


def _indexed(keys: DataFrame) -> DataFrame:
    """``k, n, g, p, i``: each key's rarest pairs of characters, with place and rank; enough of them for any partner."""
    places = F.sequence(F.lit(1), F.col("n") - 1)
    each = F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), F.substring(F.col("key"), p, F.lit(2)).alias("g"))))
    grams = materialize(keys.where("n > 1").select("k", "n", each.alias("own")).select("k", "n", "own.g", "own.p"), "grams")
    often = grams.groupBy("g").agg(F.count("*").alias("f"))
    ranked = grams.join(often, "g").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g", "p"))).alias("own"))
    # The longest prefix that a partner asks for.  The fewest pairs are left beside the shortest one, of
    # NEAR * n / (2 - NEAR) characters: 3 * NEAR / (2 - NEAR) - 1 - NEAR / (2 - NEAR) times n, less 1.
    left = 2 * NEAR / (2 - NEAR) - 1
    longest = F.floor(F.col("n") * (1 - left)).cast("int") + 1 + SHARED
    ranks = ranked.select("k", "n", F.posexplode(F.slice("own", F.lit(1), longest)).alias("i", "own"))
    return ranks.select("k", "n", "own.g", "own.p", (F.col("i") + 1).alias("i"))


def candidates(keys: DataFrame) -> DataFrame:
    """``x, y``: pairs of ``keys`` (``k, key, n, l, r``) that may be near, once each, the shorter one first.

    ``l`` and ``r`` tell the sides a key stands on; a pair has one on either side.
    """
    index = materialize(_indexed(keys).join(keys.select("k", "l", "r"), "k"), "gram-index")
    x, y = (index.select(*[F.col(c).alias(s + c) for c in index.columns]) for s in "xy")
    n, m = F.col("xn"), F.col("yn")
    kept, last = least_kept(n, m), _shared(n, m) - least_grams(n, m) - 1
    met = x.join(y, F.col("xg") == F.col("yg")).where(
        ((n < m) | ((n == m) & (F.col("xk") < F.col("yk"))))
        & (F.col("xl") & F.col("yr") | F.col("xr") & F.col("yl"))
        & (kept <= n)
        & (F.col("xi") <= n + last)
        & (F.col("yi") <= m + last)
        & (F.col("xp") - F.col("yp") <= n - kept)
        & (F.col("yp") - F.col("xp") <= m - kept)
    )
    found = met.groupBy(F.col("xk").alias("x"), F.col("yk").alias("y"), "xn", "yn").agg(F.count("*").alias("c"))
    return found.where(F.col("c") >= _shared(n, m)).select("x", "y")


def _counted(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates of which enough pairs of characters of the shorter key stand near their place in the longer one."""
    x, y = (keys.select(F.col("k").alias(s), F.col("key").alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "xy")
    both = pairs.join(x, "x").join(y, "y")
    n, m = F.col("nx"), F.col("ny")
    kept = least_kept(n, m)

    def stands(p: Column) -> Column:
        first = F.greatest(F.lit(1), p - (n - kept))
        window = F.substring(F.col("ky"), first, p + (m - kept) + 2 - first)
        return F.instr(window, F.substring(F.col("kx"), p, F.lit(2))) > 0

    return both.where(F.size(F.filter(F.sequence(F.lit(1), n - 1), stands)) >= least_grams(n, m))


def _keys(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Distinct keys with their first and last rows on either side."""
    own = left.select("key", F.col("pos").alias("a"), F.col("pos").alias("b") if right is None else F.lit(None).alias("b"))
    if right is not None:
        own = own.unionByName(right.select("key", F.lit(None).alias("a"), F.col("pos").alias("b")))
    found = own.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    return materialize(
        found.select(F.monotonically_increasing_id().alias("k"), "key", F.length("key").alias("n"), "first", "last",
                     F.col("first").isNotNull().alias("l"), F.col("last").isNotNull().alias("r")),
        "near-keys",
    )


def _verified(pairs: DataFrame, keys: DataFrame, ordered: bool) -> DataFrame:
    """``kl, kr, ratio``: key pairs, in the order of the matcher's arguments, whose ratio reaches NEAR.

    Between two tables the left one's key comes first; within one (``ordered``)
    the earlier row's, where rows of both keys stand in that order.
    """
    ends = [keys.select(F.col("k").alias(s), *[F.col(c).alias(s + c) for c in ("first", "last", "l", "r")]) for s in "xy"]
    known = _counted(pairs, keys).join(ends[0], "x").join(ends[1], "y")

    def asked(s: str, t: str) -> Column:
        there = F.col(f"{s}l") & F.col(f"{t}r")
        if ordered:
            there = there & (F.col(f"{s}first") < F.col(f"{t}last"))
        return F.when(there, F.struct(F.col(s).alias("kl"), F.col(t).alias("kr"), F.col(f"k{s}").alias("tl"), F.col(f"k{t}").alias("tr")))

    orders = known.select(F.explode(F.array_compact(F.array(asked("x", "y"), asked("y", "x")))).alias("own")).select("own.*")
    judged = orders.select("kl", "kr", near_ratio("tl", "tr").alias("ratio"))
    return judged.where(F.col("ratio") >= NEAR).select("kl", "kr", F.bround("ratio", 6).alias("ratio"))


def near_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """``a, b, ratio``: rows (``pos, key``) with unlike keys whose ratio reaches NEAR.

    Within one table ``a`` is the earlier row; between two, ``a`` is left.  The
    first row is the matcher's first argument; the ratio is rounded half to even.
    """
    keys = _keys(left, right)
    found = _verified(candidates(keys), keys, right is None)
    a = left.join(keys.select("k", "key"), "key").select(F.col("k").alias("kl"), F.col("pos").alias("a"))
    b = (left if right is None else right).join(keys.select("k", "key"), "key").select(F.col("k").alias("kr"), F.col("pos").alias("b"))
    pairs = found.join(a, "kl").join(b, "kr")
    return (pairs.where("a < b") if right is None else pairs).select("a", "b", "ratio")


def near_classes(rows: DataFrame) -> DataFrame:
    """``a, b``: the first rows of each two keys with near rows; what shares a key is linked by the key."""
    keys = _keys(rows, None)
    found = _verified(candidates(keys), keys, True).select("kl", "kr").distinct()
    a, b = (keys.select(F.col("k").alias(f"k{s}"), F.col("first").alias(n)) for s, n in (("l", "a"), ("r", "b")))
    return found.join(a, "kl").join(b, "kr").select("a", "b")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left, right, kind, similarity`` of texts of two tables (``id, text, key, template``) that say the same or nearly.

    Kinds, the first that holds: exact, normalized (equal keys), numeric_template
    (equal but for numbers), near_phrase (templates are near).  The equal kinds
    are equi-joins on the template, which equal texts and keys share.
    """
    one = left.select(*[F.col(c).alias(f"l_{c}") for c in ("id", "text", "key", "template")])
    two = right.select(*[F.col(c).alias(f"r_{c}") for c in ("id", "text", "key", "template")])
    equal = one.join(two, F.col("l_template") == F.col("r_template")).select(
        F.col("l_id").alias("left"),
        F.col("r_id").alias("right"),
        F.when(F.col("l_text") == F.col("r_text"), "exact").when(F.col("l_key") == F.col("r_key"), "normalized").otherwise("numeric_template").alias("kind"),
        F.lit(1.0).alias("similarity"),
    )
    sides = [t.select(F.col("id").alias("pos"), F.col("template").alias("key")) for t in (left, right)]
    near = near_pairs(*sides).select(F.col("a").alias("left"), F.col("b").alias("right"), F.lit("near_phrase").alias("kind"), F.col("ratio").alias("similarity"))
    return equal.unionByName(near)
