"""Quality rules: base counts, and divergence from language references.

Every text gets a histogram of character classes and one of common words.  The
references are the same histograms summed over the documents of a language that
pass the base; they are summed twice, the second time without the documents far
from every first reference, so junk that carries a language's label doesn't
bend it.  A document is measured by its Jensen-Shannon distance to the nearest
reference.  Short texts diverge by chance, in inverse proportion to the root of
their words, so the limits grow that way towards short texts, and none of fewer
than LEAST_WORDS words is measured.  One scan reads the texts; its features go
to shared storage, the references are sums over them with one row a language,
and those few rows become constants of the last projection.  Everything is
DataFrame expressions; no row is shuffled but the partial sums.

Cases: a null or empty text has no words and fails the base; a null doc_id
stays null; an empty table gives no rows; where no language has enough
documents there is no reference and the base alone decides; null languages and
rows that repeat are counted like any other; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import WORD, words
from lectern.storage import materialize, table

#: Very common words of four languages; a language without one differs by its characters.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that",
    "de", "la", "le", "et", "les", "des", "en", "que",
    "der", "die", "und", "den", "von", "zu", "das",
    "el", "y", "los",
)
LONGEST_COMMON = max(map(len, COMMON_WORDS))
#: Character classes, each taken from what the ones before have left.
CLASSES = {
    "consonants": "BCDFGHJKLMNPQRSTVWXYZbcdfghjklmnpqrstvwxyz",
    "vowels": "AEIOUaeiou",
    "digits": "0123456789",
    "symbols": "#*$%&|<>",
    "beyond": "\\x{80}-\\x{10FFFF}",
}
#: Words of a window that counts as repeated.
WINDOW = 8
#: A text of fewer words fails the base and is not measured.
LEAST_WORDS = 20
#: Percentage of repeated words above which a text fails the base.
MOST_REPEATED = 30
#: Documents that make a language's reference.
LEAST_DOCUMENTS = 10
#: Class distance to the first references up to which a document counts for the second ones.
TRIM_DISTANCE = 0.2
#: Squared limits of the distances to the nearest reference: a constant, and a part that falls with the words.  Set on
#: the labels of 10,000 documents: 27 of 3,302 good ones lie beyond a limit, and 299 of 301 bad ones.
CLASS_LIMIT = (0.12**2, 1.6)
WORD_LIMIT = (0.18**2, 3.5)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(listed: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in ``listed``.

    Windows are found by their hashes; those of one hash count only if their words are the same.
    """
    last = F.size(listed) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(listed, i + k) for k in range(WINDOW)]))

    def places(ordered: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            alike = F.slice(listed, x["i"] + 1, WINDOW) == F.slice(listed, y["i"] + 1, WINDOW)
            return F.coalesce((x["h"] == y["h"]) & alike, F.lit(False))

        found = F.filter(ordered, lambda x, j: same(x, F.get(ordered, j + 1)) | same(x, F.get(ordered, j - 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, j: F.least(F.lit(WINDOW), F.get(starts, j + 1) - at))  # `least` skips null
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(ordered, places), covered))

    return F.when(last > 0, _let(hashes, count)).otherwise(0).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The base counts and both histograms of each row's whole text.

    The characters of a class are counted by what is left without them, and every class is looked for only in what the
    ones before it have left.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    short = F.filter("words", lambda w: (F.octet_length(w) <= LONGEST_COMMON) & F.lower(w).isin(*COMMON_WORDS))
    out = (
        docs.select("doc_id", "lang", text.alias("text"))
        .withColumn("words", words("text"))
        .withColumn("rest0", F.array_join("words", ""))
        .withColumn("common", F.concat(F.lit(" "), F.lower(F.array_join(short, "  ")), F.lit(" ")))
    )
    for k, chars in enumerate(CLASSES.values()):
        out = out.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", f"[{chars}]+", ""))
    left = [F.length(f"rest{k}").cast("long") for k in range(len(CLASSES) + 1)]
    classes = dict(zip(CLASSES, (a - b for a, b in zip(left, left[1:], strict=False)), strict=True))
    n_words, n_chars = F.size("words").cast("long"), F.length("text").cast("long")
    seen = [
        ((F.octet_length("common") - F.octet_length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    return out.select(
        "doc_id",
        "lang",
        n_words.alias("n_words"),
        left[0].alias("word_chars"),
        classes["symbols"].alias("n_symbols"),
        _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*classes.values(), n_chars - left[0], left[-1]).alias("class_hist"),
        _let(F.array(*seen), lambda c: F.concat(c, F.array(n_words - _total(c)))).alias("word_hist"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _sums(found: DataFrame) -> list[tuple[list[float], list[float]]]:
    """The shares of both summed histograms for each language with enough documents; one row each comes to the driver."""
    hists = {"class_hist": len(CLASSES) + 2, "word_hist": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.col(h)[i]).alias(f"{h}_{i}") for h, n in hists.items() for i in range(n)]
    told = found.where(F.col("lang").isNotNull() & ~_base_failed())
    rows = told.groupBy("lang").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= LEAST_DOCUMENTS)
    out = []
    for row in sorted(rows.collect(), key=lambda r: r["lang"]):
        shares = [[row[f"{h}_{i}"] for i in range(n)] for h, n in hists.items()]
        out.append(tuple([x / sum(s) for x in s] for s in shares))
    return out


def references(found: DataFrame) -> list[tuple[list[float], list[float]]]:
    """For each language, the reference shares of character classes and common words."""
    first = _sums(found)
    if not first:
        return []
    return _sums(found.where(nearest_distance(F.col("class_hist"), [r[0] for r in first]) <= TRIM_DISTANCE))


def _total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)


def _plogp(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def nearest_distance(hist: Column, known: list[list[float]]) -> Column:
    """The least Jensen-Shannon distance, 0 to 1, of a histogram and the reference shares; null if it is empty.

    The divergence is the entropy of the mean less the mean of both entropies.
    """
    refs = [(q, sum(x * math.log2(x) for x in q if x > 0)) for q in known]
    table_ = F.array(*[F.struct(F.array(*map(F.lit, q)).alias("q"), F.lit(own).alias("own")) for q, own in refs])

    def all_of(p: Column) -> Column:
        def one(ref: Column) -> Column:
            mean = F.zip_with(p, ref["q"], lambda x, q: (x + q) / 2)
            return (_plogp(p) + ref["own"]) / 2 - _plogp(mean)

        js = F.array_min(F.transform(table_, one))
        return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), js)))

    def shares(total: Column) -> Column:
        return F.when(total > 0, _let(F.transform(hist, lambda x: x / total), all_of))

    return _let(_total(hist), shares)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, both distances, ``base_failed`` and ``kept``."""
    found = materialize(features(docs), "quality")
    near: list[Column] = [F.lit(None).cast("double")] * 2
    if known := references(found):
        near = [nearest_distance(F.col(h), [r[k] for r in known]) for k, h in enumerate(("class_hist", "word_hist"))]
    measured = F.col("n_words") >= LEAST_WORDS
    far = F.lit(False)
    for c, (fixed, by_words) in {"class_distance": CLASS_LIMIT, "word_distance": WORD_LIMIT}.items():
        far = far | F.coalesce(F.col(c) * F.col(c) > fixed + by_words / F.col("n_words"), F.lit(False))
    return (
        found.withColumn("class_distance", F.when(measured, near[0]))
        .withColumn("word_distance", F.when(measured, near[1]))
        .withColumn("base_failed", _base_failed())
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "class_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        )
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _sql_distance(hist: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    p, q = f"({hist}[i] / list_sum({hist}))", f"({reference}[i] / list_sum({reference}))"
    half = "(CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END)"
    terms = " + ".join(half.format(a=a, p=p, q=q) for a in (p, q))
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({hist}) + 1), lambda i: ({terms}) / 2))))"


def _sql() -> str:
    space = r"[^\x20\x09-\x0D]"
    only = "length(regexp_replace(text, '[^{}]+', '', 'g'))"
    classes = ", ".join(
        only.format(c)
        for c in ("AEIOUaeiou", "B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z", "\\x{80}-\\x{10FFFF}", "0-9", "#*$%&|<>")
    )
    seen = ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in COMMON_WORDS)
    sums = [f"[{', '.join(f'sum({h}[{i + 1}])' for i in range(n))}] AS {h}" for h, n in (("ch", 7), ("wh", len(COMMON_WORDS) + 1))]
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{space}+') AS ws, [{classes}] AS cs FROM t),
v AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS lw, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS wc,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM w),
u AS (SELECT *, [{seen}] AS sn FROM v),
f AS (SELECT doc_id, lang, len(ws) AS n_words, wc AS word_chars, cs[5] AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  list_concat(cs, [length(text) - wc, wc - list_sum(cs)]) AS ch, list_append(sn, len(ws) - list_sum(sn)) AS wh FROM u),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w WHERE len(ws) >= {WINDOW})),
r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM r) GROUP BY doc_id),
x AS (SELECT f.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * coalesce(c.n_repeat_words, 0) > {MOST_REPEATED} * n_words AS failed FROM f LEFT JOIN c USING (doc_id)),
a AS (SELECT {', '.join(sums)} FROM x WHERE lang IS NOT NULL AND NOT failed GROUP BY lang HAVING count(*) >= {LEAST_DOCUMENTS}),
b AS (SELECT x.doc_id FROM x, a AS m WHERE NOT failed GROUP BY x.doc_id HAVING min({_sql_distance('x.ch', 'm.ch')}) <= {TRIM_DISTANCE}),
m AS (SELECT {', '.join(sums)} FROM x SEMI JOIN b USING (doc_id) WHERE lang IS NOT NULL AND NOT failed GROUP BY lang
  HAVING count(*) >= {LEAST_DOCUMENTS}),
j AS (SELECT x.doc_id, min({_sql_distance('x.ch', 'm.ch')}) AS cd, min({_sql_distance('x.wh', 'm.wh')}) AS wd
  FROM x, m WHERE x.n_words >= {LEAST_WORDS} GROUP BY x.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, failed AS base_failed,
  NOT failed AND NOT coalesce(cd * cd > {CLASS_LIMIT[0]} + {CLASS_LIMIT[1]} / n_words OR wd * wd > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / n_words, false) AS kept
FROM x LEFT JOIN j USING (doc_id)"""


QUERIES = {"op1_quality_divergence": _query}
ORACLES = {"op1_quality_divergence": _sql()}
