"""URL rules with redirect equivalence.

A url is judged by the longest rule that fits its host and path.  Pages that
canonical links or meta redirects declare to be one page form components, found
by distributed rounds of star contraction; a page that no rule fits takes the
decision of its component, where an explicit allow goes before a block.

Every canonical link and refresh of a page counts.  Relative addresses are
resolved against the page's: with or without host, from the root or the folder,
a query alone, and ``.`` and ``..`` steps; base elements are not looked at.

Cases: a null url, or one without ``://``, has an empty host and path and no
rule; a null html declares nothing; an empty table gives no rows; rows that
repeat are judged alike; ends of links that are no page of the table still
carry decisions between pages, and a rule that fits such an end counts; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.components import connected_components
from lectern.storage import materialize, table

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a page names the address it stands for, or sends its reader: a tag, what makes it one, and the address.
_ADDRESS = r"""["']?([^"'\s>]+)"""
LINKS = (
    (r"(?i)<link\b[^>]*>", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"(?i)\bhref\s*=\s*" + _ADDRESS),
    (r"(?i)<meta\b[^>]*>", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"(?i)\burl\s*=\s*" + _ADDRESS),
)
_ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    fits = [
        (((host == h) | host.endswith("." + h)) & path.startswith(p), f"{h}{p}", verdict)
        for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    pick = [reduce(lambda c, x, k=k: c.when(x[0], x[k]), fits[1:], F.when(fits[0][0], fits[0][k])) for k in (1, 2)]
    return pick[0], pick[1]


def _node(url: Column) -> Column:
    """A url without its fragment, its scheme and host lower-cased."""
    whole = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(whole, "^[^/?#]*://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substring(whole, F.length(head) + 1, F.length(whole)))


def _named(html: Column) -> Column:
    """The addresses of all links and refreshes of a page."""
    found = [F.transform(_tags(html, tag, kind), _first(address)) for tag, kind, address in LINKS]
    return F.filter(F.concat(*found), lambda x: x != "")


def _tags(html: Column, tag: str, kind: str) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))


def _first(pattern: str):
    return lambda t: F.regexp_extract(t, pattern, 1)


def _without_steps(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` steps."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, none, step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, to: Column) -> Column:
    """The address that ``to`` names on the page ``base``."""
    scheme, origin = F.regexp_extract(base, "^([^/?#]*:)//", 1), F.regexp_extract(base, "^[^/?#]*://[^/?#]*", 0)
    page = F.regexp_extract(base, "^[^/?#]*://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(to, "^[^?#]*", 0), F.regexp_extract(to, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(page, "^(.*/)", 1)
    under = F.concat(F.when(folder == "", "/").otherwise(folder), path)
    return (
        F.when(to.rlike(_ABSOLUTE), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(path == "", F.concat(origin, page, rest))
        .when(to.startswith("/"), F.concat(origin, _without_steps(path), rest))
        .otherwise(F.concat(origin, _without_steps(under), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``src, dst``: pages' urls and the urls their canonical links and redirects name."""
    named = pages.where("url is not null and html is not null").select("url", F.explode(_named(F.col("html"))).alias("to"))
    whole = resolved(F.col("url"), F.col("to"))
    return named.select(_node(F.col("url")).alias("src"), _node(whole).alias("dst")).where("src <> dst")


def judge_urls(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``."""
    edges = materialize(alias_edges(pages).distinct(), "url-edges")
    parts = connected_components(edges, "src", "dst")
    rule, verdict = rule_of(url_host(F.col("node")), url_path(F.col("node")))
    own = parts.select("node", "component", verdict.alias("own"))
    decided = own.groupBy("component").agg(
        F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("passed")
    )
    passed = parts.join(decided.where("passed is not null"), "component").select("node", "passed")
    url = F.col("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = (
        pages.select("page_id", url, F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"))
        .select("page_id", "host", "path", _node(url).alias("node"), rule.alias("rule"), verdict.alias("own"))
    )
    return judged.join(passed, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict")
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_equivalence": _query}
def _sql() -> str:
    """The same in SQL: links and refreshes, relative addresses, and the decisions of components."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def host(x: str) -> str:
        after = f"CASE WHEN strpos({x}, '://') > 0 THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
        return f"coalesce(translate(regexp_extract({after}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"

    def path(x: str) -> str:
        after = f"CASE WHEN strpos({x}, '://') > 0 THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
        return f"coalesce(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '')"

    def node(x: str) -> str:
        whole = f"regexp_replace({x}, '#.*$', '')"
        head = f"regexp_extract({whole}, '^[^/?#]*://[^/?#]*')"
        return f"translate({head}, '{_UPPER}', '{_LOWER}') || substr({whole}, length({head}) + 1)"

    def steps(x: str) -> str:
        lists = f"list_transform(string_split({x}, '/'), lambda s: [s])"
        folded = (
            f"list_reduce({lists}, lambda a, b: CASE WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END "
            "WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END)"
        )
        return f"array_to_string({folded}, '/') || CASE WHEN string_split({x}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"

    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in order
    )
    blocks = ", ".join(f"'{h}{p}'" for verdict, h, p in RULES if verdict == "block")
    own = f"CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END"
    named = ", ".join(
        f"list_transform(list_filter(regexp_extract_all(html, {quoted(tag)}), lambda t: regexp_matches(t, {quoted(kind)})), "
        f"lambda t: regexp_extract(t, {quoted(address)}, 1))"
        for tag, kind, address in LINKS
    )
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
j AS (SELECT *, CASE {rules} END AS rule FROM p),
v AS (SELECT *, {own} AS own FROM j),
t0 AS (SELECT url, unnest(flatten([{named}])) AS dest FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
t1 AS (SELECT url, dest, regexp_extract(url, '^([^/?#]*:)//', 1) AS scheme, regexp_extract(url, '^[^/?#]*://[^/?#]*') AS origin,
  regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) AS page, regexp_extract(dest, '^[^?#]*') AS dp, regexp_extract(dest, '^[^?#]*(.*)$', 1) AS rest
  FROM t0 WHERE dest <> ''),
t2 AS (SELECT *, CASE WHEN starts_with(dest, '/') THEN dp ELSE coalesce(nullif(regexp_extract(page, '^(.*/)', 1), ''), '/') || dp END AS under FROM t1),
t3 AS (SELECT url, CASE WHEN regexp_matches(dest, '{_ABSOLUTE}') THEN dest WHEN starts_with(dest, '//') THEN scheme || dest
  WHEN dp = '' THEN origin || page || rest ELSE origin || {steps('under')} || rest END AS dst FROM t2),
e AS (SELECT {node('url')} AS a, {node('dst')} AS b FROM t3),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT DISTINCT a AS n, a AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
m0 AS (SELECT DISTINCT a AS node, {host('a')} AS host, {path('a')} AS path FROM l),
m1 AS (SELECT *, CASE {rules} END AS rule FROM m0),
m2 AS (SELECT node, {own} AS own FROM m1),
c AS (SELECT r.n AS node, max(CASE WHEN own = 'allow' THEN 1 ELSE 0 END) AS al, max(CASE WHEN own = 'block' THEN 1 ELSE 0 END) AS bl
  FROM r JOIN m2 ON m2.node = r.m GROUP BY r.n)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN al = 1 THEN 'allow' WHEN bl = 1 THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN c USING (node)"""


ORACLES = {"op9_url_equivalence": _sql()}
