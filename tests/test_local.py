"""Scores inside a sentence against the alignment worked out by itself."""

import random
from difflib import SequenceMatcher

from lectern.operators import local


def test_local_scores(spark):
    rng = random.Random(4)
    cases, answers = [], []
    for i in range(60):
        text = "".join(rng.choice("ab字 1") for _ in range(rng.randrange(4, 20)))
        cuts = sorted(rng.sample(range(len(text) + 1), 4))
        targets = [(cuts[0], cuts[1], ["Ａ", "x", text[cuts[0] : cuts[1]]])] if i % 4 else None
        protected = [(cuts[2], cuts[3], text[cuts[2] : cuts[3]])]
        out = list(text)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(out) + 1)
            out[k : k + rng.randrange(0, 2)] = rng.choice(["A", "xy", ""])
        cases.append((i, text, targets, protected))
        if i % 7:
            answers.append((i, "".join(out) if i % 11 else None, "ok" if i % 5 else "error"))
    kind = "id int, text string, targets array<struct<start:int,end:int,accepted:array<string>>>, protected array<struct<start:int,end:int,text:string>>"
    found = local.local_scores(spark.createDataFrame(cases, kind), spark.createDataFrame(answers, "id int, prediction string, status string"))
    said, counts = {i: (o or "", s) for i, o, s in answers}, {}
    for r in found.collect():
        _, text, targets, protected = cases[r["id"]]
        output, status = said.get(r["id"], ("", "missing"))
        valid = status == "ok" and output.strip() != ""
        for own, spans, right, wrong in ((r["targets"], targets or [], "matched", "unmatched"), (r["protected"], protected, "preserved", "changed")):
            assert len(own) == len(spans)
            for got, (start, end, want) in zip(own, spans, strict=True):
                seen = local.span_output(text, output, start, end) if valid else None
                good = seen is not None and (" ".join(seen.split()) in {" ".join(w.split()).replace("Ａ", "A") for w in want} if right == "matched" else seen == want)
                state = "failed" if not valid else "unresolved_alignment" if seen is None else right if good else wrong
                assert got["observed"] == seen
                if "字" not in text:  # white space beside Han letters is no part of a surface
                    assert got["state"] == state
                counts[got["state"]] = counts.get(got["state"], 0) + 1
        codes = SequenceMatcher(None, text, output, autojunk=False).get_opcodes()
        outside = [(t, i, j, text[i:j], output[a:b]) for t, i, j, a, b in codes if t != "equal" and not any(s <= i and j <= e for s, e, _ in targets or [])]
        assert [tuple(e) for e in r["outside"]] == outside and r["source_kept"] == (valid and output == text) and r["status"] == status
    assert {"matched", "unmatched", "preserved", "changed", "failed"} <= set(counts)
    summary = {(r["kind"], r["state"]): r["n"] for r in local.local_summary(found).collect()}
    assert sum(n for (k, _), n in summary.items() if k != "case") == sum(counts.values())
    assert sum(n for (k, _), n in summary.items() if k == "case") == 60
