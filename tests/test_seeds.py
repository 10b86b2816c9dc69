"""Findings by class against all pairs of rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import seeds


def match(a, b):
    if a.text == b.text:
        return "exact"
    if a.key == b.key:
        return "normalized"
    if a.template == b.template:
        return "numeric_template"
    return "near_phrase" if SequenceMatcher(None, a.template, b.template, autojunk=False).ratio() >= 0.82 else None


def own(rows):
    """Kinds between classes, by all pairs: for equal templates the template, for near ones both."""
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            how = match(a, b)
            if how == "exact":
                out.add(("duplicate_text", a.text))
            elif how:
                kind = "seed_cross_role_similarity" if a.role != b.role else "seed_same_role_similarity" if a.grp != b.grp else None
                if kind:
                    out.add((kind, *sorted({a.template, b.template})))
    return out


def against(rows, other, name):
    out = set()
    for a in rows:
        for b in other:
            if match(a, b):
                out.add((name(a, b), a.template, b.template))
    return out


def table(spark, seed, n, first):
    rng = random.Random(seed)
    base = ["please read {n} pages", "the total is {n} items", "set it to {n} now", "Version {n} is out", "a wholly other line of text"]
    rows = []
    for k in range(n):
        t = rng.choice(base).replace("{n}", str(rng.randrange(3)))
        t = rng.choice([t, t.upper(), t + " ok", t.replace("e", "a", 1), "Ｘ" + t])
        rows.append((first + k, t, rng.choice(["train", "validation"]), rng.choice("pq")))
    rows += [(first + n, None, "train", "p")]
    df = spark.createDataFrame(rows, "id long, text string, role string, grp string")
    return df.withColumns({"key": T.normalized_key(F.col("text")), "template": T.numeric_template(F.col("text"))}).cache()


def test_findings(spark):
    seed, old, held = table(spark, 1, 45, 0), table(spark, 2, 25, 1000), table(spark, 3, 12, 2000)
    rows = {r.id: r for t in (seed, old, held) for r in t.collect()}
    sides = [[r for r in t.orderBy("id").collect() if r.text is not None] for t in (seed, old, held)]
    got = seeds.findings(seed, old, held).collect()
    assert all(match(rows[r.left], rows[r.right]) == r.match_kind for r in got)
    assert all(r.left < r.right and r.blocks == (r.kind not in ("seed_same_role_similarity", "v1_same_role_similarity")) for r in got)
    found = {(r.kind, rows[r.left].text) for r in got if r.kind == "duplicate_text"}
    found |= {(r.kind, *sorted({rows[r.left].template, rows[r.right].template})) for r in got if r.kind.startswith("seed_")}
    want = own(sides[0])
    assert found == want and {len(k) for k in want if k[0] != "duplicate_text"} == {2, 3}
    found = {(r.kind, rows[r.left].template, rows[r.right].template) for r in got if not r.kind.startswith(("seed_", "dup"))}
    want = against(sides[0], sides[1], lambda a, b: "v1_cross_role_similarity" if a.role != b.role else "v1_same_role_similarity")
    assert found == want | against(sides[0], sides[2], lambda a, b: "old_heldout_similarity")
    assert seeds.status(seeds.findings(seed)).first()["status"] == "blocked"


def test_nothing_found(spark):
    seed = table(spark, 1, 3, 0).where("id = 0")
    none = seed.limit(0)
    assert seeds.findings(seed, none, none).count() == 0
    assert tuple(seeds.status(seeds.findings(none)).first()) == ("draft_checks_passed", 0, 0)


def test_query(spark):
    """The registered query against all pairs of its rows."""
    from lectern.plans import splitting

    small = "/root/testdata/sf0.001"
    sides = [t.orderBy("id").collect() for t in splitting.seed_tables(spark, small)]
    rows = {r.id: r for side in sides for r in side}
    got = splitting.seed_findings(spark, small).collect()
    found = {(r.kind, rows[r.left].text) for r in got if r.kind == "duplicate_text"}
    found |= {(r.kind, *sorted({rows[r.left].template, rows[r.right].template})) for r in got if r.kind.startswith("seed_")}
    found |= {(r.kind, rows[r.left].template, rows[r.right].template) for r in got if not r.kind.startswith(("seed_", "dup"))}
    want = own(sides[0]) | against(sides[0], sides[1], lambda a, b: "v1_cross_role_similarity" if a.role != b.role else "v1_same_role_similarity")
    assert found == want | against(sides[0], sides[2], lambda a, b: "old_heldout_similarity") and len(found) > 100
