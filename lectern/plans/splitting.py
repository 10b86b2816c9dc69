"""Groups, near phrases, leakage, splits and training figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import near as N
from lectern.operators import seeds as D
from lectern.operators import splits as S
from lectern.operators import trainlog as L
from lectern.storage import materialize, table


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with digests of their text and of its template, ASCII-folded."""
    template = F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s+", ""), r"[0-9]+(\.[0-9]+)*", "<number>")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("exact"),
                                               F.sha2(template.cast("binary"), 256).alias("template"), "lang")


def template_components(spark: SparkSession, d: str) -> DataFrame:
    return S.linked_groups(_keyed(spark, d), ["exact", "template"]).select("id", "component")


def fixed_role_violations(spark: SparkSession, d: str) -> DataFrame:
    """Groups that span two roles, where roles were set by the id's digest."""
    role = F.when(F.sha2(F.col("id").cast("string").cast("binary"), 256) < "4", "validation").otherwise("train")
    found = template_components(spark, d).withColumn("role", role)
    roles = found.groupBy("component").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("n"))
    return roles.where("roles > 1").select("component", "n")


def near_phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs among the benchmark's texts, the earlier one first."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), T.numeric_template(F.col("text")).alias("key"))
    return N.near_pairs(rows)


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """Distinct phrases of parts (kind, name, brand), each with its first part's key."""
    text = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    return table(spark, d, "part").groupBy(text.alias("text")).agg(F.min("p_partkey").alias("id"))


def near_part_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs among the phrases of parts, numbers apart; phrases that are equal but for numbers stand as their first part."""
    keyed = _phrases(spark, d).select("id", T.numeric_template(F.col("text")).alias("key"))
    return N.near_pairs(keyed.groupBy("key").agg(F.min("id").alias("pos")))


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """What of earlier phrases (of parts above size 20, some in capitals) the other parts' phrases repeat, and how."""
    def side(own: DataFrame, text: Column) -> DataFrame:
        found = own.groupBy(text.alias("text")).agg(F.min("p_partkey").alias("id"))
        return materialize(found.select("id", "text", T.normalized_key(F.col("text")).alias("key"), T.numeric_template(F.col("text")).alias("template")), "phrases")

    parts, text = table(spark, d, "part"), F.concat_ws(" ", "p_name", "p_brand")
    seeds = side(parts.where("p_size <= 20"), text)
    history = side(parts.where("p_size > 20"), F.when(F.col("p_type") == "ECONOMY", F.upper(text)).otherwise(text))
    found = N.matches(seeds, history)
    return found.groupBy("left", "kind").agg(F.count("*").alias("n"), F.min("right").alias("first"), F.min("similarity").alias("least"))


def seed_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of parts as draft samples, as a historical set (some in capitals) and as held-out inputs, by the parts' sizes."""
    size, text = F.col("p_size"), F.concat_ws(" ", "p_name", "p_brand")
    said = F.when((size > 20) & (F.col("p_type") == "ECONOMY"), F.upper(text)).otherwise(text)
    role = F.when(F.col("p_type").isin("STANDARD", "PROMO"), "validation").otherwise("train")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), said.alias("text"), role.alias("role"), F.col("p_type").alias("grp"), size.alias("size"))
    rows = materialize(rows.withColumns({"key": T.normalized_key(F.col("text")), "template": T.numeric_template(F.col("text"))}), "seed-rows")
    return rows.where("size <= 20"), rows.where("size between 21 and 40"), rows.where("size > 40")


def seed_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the samples repeat among themselves, of the historical set and of the held-out inputs."""
    return D.findings(*seed_tables(spark, d))


def heldout_leakage(spark: SparkSession, d: str) -> DataFrame:
    return S.contained(table(spark, d, "benchmark"), table(spark, d, "documents"))


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's texts in groups, and the groups in two sides."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.numeric_template(F.col("text")).alias("key"),
        F.when(F.col("text").rlike("[0-9]"), "core_tn").otherwise("preservation").alias("track"))
    items = materialize(items, "split-items")
    near = N.near_classes(items.select(F.col("id").alias("pos"), "key"))
    groups = materialize(S.linked_groups(items, ["key"], near).join(items.select("id", "track"), "id"), "split-groups")
    # A group has a few tracks, by name.
    per = groups.groupBy("group_id", "track").agg(F.count("*").alias("n")).groupBy("group_id")
    per = per.agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("track", "n"))).alias("tracks"))
    chosen = S.allocate(materialize(per, "split-sizes"), seed=20260928)
    role = F.when(F.col("group_id").isin(*chosen, ""), "validation").otherwise("train")
    return groups.select("id", "group_id", "track", role.alias("role"))


def seed_audit(spark: SparkSession, d: str) -> DataFrame:
    """All rules that a labelled document breaks as a draft sample, one row each."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    operation = F.when(F.col("quality") == 1, "transform").otherwise("preserve")
    track = F.when(F.col("lang") == "en", "preservation").otherwise("core_tn")
    changed = F.col("toxic") == 1
    broken = F.array_compact(F.array(
        F.when((operation == "preserve") & changed, "preserve_changes_text"),
        F.when((operation == "transform") & ~changed, "transform_keeps_text"),
        F.when((track == "preservation") & (operation != "preserve"), "preservation_needs_preserve"),
        F.when(F.length("text") < 40, "short_text")))
    return rows.select("doc_id", F.explode(broken).alias("rule"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of losses: a run for each user, a step for each event."""
    return table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("loss"), (F.length("props") + 1).cast("long").alias("tokens"))


def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    return L.micro_batches(_log(spark, d), size=8, run="user_id", step="event_id").select("event_id", "batch", F.round("share", 9).alias("share"))


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    return L.weighted_loss(_log(spark, d), "user_id").select("user_id", F.round("loss", 6).alias("loss"))


def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return L.best_checkpoint(_log(spark, d), "user_id", "event_id")


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "lineitem")
    rate = L.warmup_rate(F.col("l_linenumber"), F.col("l_quantity"), 0.0002)
    return log.select("l_orderkey", "l_linenumber", F.round(rate, 12).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        template_components, fixed_role_violations, near_phrase_pairs, near_part_phrases, phrase_matches, seed_findings, heldout_leakage, grouped_split, seed_audit,
        micro_batches, weighted_loss, best_checkpoint, lr_schedule,
    )
}

_KEYS = r"""k AS (SELECT doc_id AS id, text AS exact, regexp_replace(regexp_replace(lower(text), '[\s\x0b]+', '', 'g'), '[0-9]+(\.[0-9]+)*', '<number>', 'g') AS template FROM documents),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.exact = b.exact OR a.template = b.template WHERE a.id <> b.id),
r AS (SELECT id AS n, id AS m FROM k UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
p AS (SELECT n AS id, min(m) AS component FROM r GROUP BY n)"""


def _ratios(keys: str, pairs: str) -> str:
    """CTEs that end in ``ratios(x, y, r)``: the matcher's ratio of pairs of ``keys(id, key)`` that ``pairs`` (a condition on x, y) joins.

    Each step finds the longest common run between two places of each side, the
    first in x, then in y, and goes on to the left and to the right of it.  Pairs
    whose lengths or letters can't reach the bound are left out first.
    """
    common = "coalesce(list_position(list_transform(range(0, least(ah - i, bh - j)), lambda t: ka[i + t + 1] <> kb[j + t + 1]), true) - 1, least(ah - i, bh - j))"
    # A run begins where the letters before it differ.
    begins = "ka[i + 1] = kb[j + 1] AND (i = al OR j = bl OR ka[i] <> kb[j])"
    longest = f"list_max(list_transform(range(al, ah), lambda i: list_max(list_transform(range(bl, bh), lambda j: {{'k': CASE WHEN {begins} THEN {common} ELSE 0 END, 'i': -i, 'j': -j}}))))"
    bag = "list_sum(list_transform(list_distinct(string_split(x.key, '')), lambda c: least(length(x.key) - length(replace(x.key, c, '')), length(y.key) - length(replace(y.key, c, '')))))"
    return f"""keys AS ({keys}),
cands AS (SELECT x.id AS x, y.id AS y, x.key AS ka, y.key AS kb FROM keys x JOIN keys y ON {pairs} AND x.key <> y.key
  AND 2 * least(length(x.key), length(y.key)) >= 0.82 * (length(x.key) + length(y.key)) AND 2 * {bag} >= 0.82 * (length(x.key) + length(y.key)) - 1e-9),
runs AS (SELECT x, y, ka, kb, al, ah, bl, bh, {longest} AS m FROM (SELECT *, 0 AS al, length(ka) AS ah, 0 AS bl, length(kb) AS bh FROM cands)
  UNION ALL SELECT x, y, ka, kb, al, ah, bl, bh, {longest} AS m FROM (
    SELECT x, y, ka, kb, unnest([al, m.k - m.i]) AS al, unnest([-m.i, ah]) AS ah, unnest([bl, m.k - m.j]) AS bl, unnest([-m.j, bh]) AS bh
    FROM runs WHERE m.k > 0) WHERE al < ah AND bl < bh),
ratios AS (SELECT x, y, 2.0::DOUBLE * sum(m.k) / (length(any_value(ka)) + length(any_value(kb))) AS r FROM runs GROUP BY x, y)"""


_TEMPLATE = "regexp_replace(regexp_replace(lower({}), '[ \\t\\n\\r]+', '', 'g'), '[0-9]+(\\.[0-9]+)*', '<number>', 'g')"
_PHRASES = f"SELECT min(p_partkey) AS id, {_TEMPLATE.format("p_type || ' ' || p_name || ' ' || p_brand")} AS key FROM part GROUP BY 2"
_SIDES = f"""t AS (SELECT *, p_name || ' ' || p_brand AS s FROM part),
l AS (SELECT s AS text, min(p_partkey) AS id FROM t WHERE p_size <= 20 GROUP BY 1),
r AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN upper(s) ELSE s END AS text, min(p_partkey) AS id FROM t WHERE p_size > 20 GROUP BY 1),
both_sides AS (SELECT l.id AS a, r.id AS b, l.text AS ta, r.text AS tb, {_TEMPLATE.format("l.text")} AS ka, {_TEMPLATE.format("r.text")} AS kb FROM l, r)"""

ORACLES = {
    "near_phrase_pairs": f"WITH RECURSIVE {_ratios('SELECT item_id AS id, ' + _TEMPLATE.format('text') + ' AS key FROM benchmark', 'x.id < y.id')} "
    "SELECT x AS a, y AS b, round(r, 6) AS ratio FROM ratios WHERE r >= 0.82",
    "near_part_phrases": f"WITH RECURSIVE {_ratios(_PHRASES, 'x.id < y.id')} SELECT x AS a, y AS b, round(r, 6) AS ratio FROM ratios WHERE r >= 0.82",
    "phrase_matches": f"""WITH RECURSIVE {_SIDES}, {_ratios("SELECT DISTINCT k AS id, k AS key FROM (SELECT unnest([ka, kb]) AS k FROM both_sides)", 'true')},
found AS (SELECT a, CASE WHEN ta = tb THEN 'exact' WHEN lower(ta) = lower(tb) THEN 'normalized' ELSE 'numeric_template' END AS kind, b, 1.0::DOUBLE AS similarity
  FROM both_sides WHERE ka = kb
  UNION ALL SELECT a, 'near_phrase', b, round(r, 6) FROM both_sides JOIN ratios ON ratios.x = ka AND ratios.y = kb WHERE r >= 0.82)
SELECT a AS "left", kind, count(*) AS n, min(b) AS first, min(similarity) AS least FROM found GROUP BY 1, 2""",
    "template_components": f"WITH RECURSIVE {_KEYS} SELECT id, component FROM p",
    "fixed_role_violations": f"""WITH RECURSIVE {_KEYS} SELECT component, count(*) AS n FROM p GROUP BY component
HAVING count(DISTINCT CASE WHEN sha256(CAST(id AS VARCHAR)) < '4' THEN 1 ELSE 0 END) > 1""",
    "heldout_leakage": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "seed_audit": """SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 AND toxic = 1 THEN 'preserve_changes_text' END,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'transform_keeps_text' END, CASE WHEN lang = 'en' AND quality = 1 THEN 'preservation_needs_preserve' END,
  CASE WHEN length(text) < 40 THEN 'short_text' END], lambda x: x IS NOT NULL)) AS rule FROM documents JOIN labels USING (doc_id)""",
    "micro_batches": """WITH b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch, length(props) + 1 AS tokens FROM events)
SELECT event_id, batch, round(tokens / sum(tokens) OVER (PARTITION BY user_id, batch), 9) AS share FROM b""",
    "weighted_loss": "SELECT user_id, round(sum(value * (length(props) + 1)) / sum(length(props) + 1), 6) AS loss FROM events GROUP BY user_id",
    "best_checkpoint": "SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS loss FROM events WHERE NOT isnan(value) GROUP BY user_id",
    "lr_schedule": "SELECT l_orderkey, l_linenumber, round(0.0002 * least(l_linenumber / ceil(l_quantity * 0.03), 1.0), 12) AS rate FROM lineitem",
}
