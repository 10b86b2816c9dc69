"""The mix restated document by document, and every stage of the pipeline on odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import blocks, bytebpe, languages, mixing
from lectern.llm.common import text_hash
from tests.llm.conftest import CLASHING, row


def restated(rows):
    """``{(doc_id, text): taken}``: whole turns of a source's line, then its first words once more."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(order)}
    left, target, free = sum(sizes.values()), {}, set(sizes)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = {}
    for s in order:
        line = sorted((r for r in rows if r.source == s and r.size), key=lambda r: (r.turn, r.doc_id is not None, r.doc_id or 0, r.hash, r.size))
        take = min(int(target[s] + 1e-9), 3 * sizes[s])
        full, rest = divmod(take, sizes[s]) if sizes[s] else (0, 0)
        at = 0
        for r in line:
            again = max(0, min(at + r.size, rest) - at)
            taken[r.doc_id, r.text] = full * r.size + again
            at += r.size
    return taken


@pytest.mark.parametrize("chunk", [4000, 7])
def test_taken_of_every_document(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    rows = []
    for k in range(300):
        source = rng.choice(["a", "b", "b", "b", "b", "c", "d", None])
        rows.append((None if k % 50 == 0 else k, " ".join(["w"] * rng.choice([0, 1, 30, 400, 1500])) + f" {k}", source))
    df = spark.createDataFrame(rows + [(900, None, "a"), (901, " ", "e")], "doc_id long, text string, source string").repartition(4)
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", text_hash()), 1)
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))
    known = df.select("doc_id", "text", "source", size.alias("size"), turn.alias("turn"), text_hash().alias("hash")).collect()
    want = restated(known)
    got = mixing.mixture(df).join(df.select(F.col("doc_id").alias("i"), "text", text_hash().alias("h")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    found = {(r.doc_id, r.text): r.taken for r in got.collect()}
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v} and sum(want.values()) > 50_000


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def odd_rows():
    words = "the old house by the river and the long road to town ".split()
    text = " ".join(words * 6)
    return [
        row(None, text), row(None, text), row(1, text + " end"), row(1, text), row(2, text), row(2, text), row(3, ""), row(4, None), row(5, " \n"), row(6, "12 34 ##", None, None),
        row(7, " ".join(words * 3000), "en", None), row(8, "x" * 50_000), row(9, "le vieux chemin de la maison " * 12, "fr"),
    ]


NAMES = ("language_id", "exact_dedup", "near_dedup", "mix_sources", "encode")


@pytest.mark.parametrize("name", NAMES)
def test_a_stage_on_an_empty_table(spark, empty, stages, name):
    out = stages[name](spark, empty, "")
    assert out.count() == 0 and (name == "encode" or out.columns == empty.columns)


@pytest.mark.parametrize("name", NAMES)
def test_a_stage_on_odd_rows(spark, stages, name):
    """Nulls, empty and very long texts, ids that repeat or lack, rows that repeat, columns with the stages' own names."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, CLASHING).repartition(3)
    out = stages[name](spark, df, "")
    if name == "encode":
        found = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect())
        table = bytebpe._token_bytes(open(public_tokenizers.path(bytebpe.RANKS), "rb").read())
        spelt = Counter((r.doc_id, b"".join(table[i] for i in np.frombuffer(r.ids, "<u4").tolist()).decode()) for r in out.collect())
        assert spelt == Counter((r[0], r[1] or "") for r in rows) and found.total() == len(rows)
        return
    assert out.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    given = Counter((r[0], r[1]) for r in rows)
    assert set(kept) <= set(given)
    if name == "language_id":
        # Rows of one text stay or go together; what has no letter goes.
        assert all(kept[k] in (0, n) for k, n in given.items()) and not any(kept[k] for k in given if not (k[1] or "").strip("\n 1234#"))
    elif name == "exact_dedup":
        assert Counter(t or "" for _, t in kept.elements()) == Counter({t or "": 1 for _, t in given})
        assert (2, rows[1][1]) in kept and (4, None) in kept
    elif name == "near_dedup":
        # Both rows of the smallest id stay; rows without id are in no group.
        assert kept[1, rows[3][1]] == kept[1, rows[2][1]] == 1 and not kept[2, rows[4][1]] and kept[None, rows[0][1]] == 2
        assert all(kept[k] == n for k, n in given.items() if k[0] in (3, 4, 5))
    else:
        assert not any(kept[k] for k in given if not (k[1] or "").strip()) and kept.total() > 0


def test_languages_without_ids(spark):
    """The sample is picked by row: rows that lack an id are learned from like others."""
    words = {"en": ["the", "and", "with", "this", "from", "house"], "fr": ["le", "dans", "avec", "cette", "pour", "maison"]}
    rng = random.Random(2)
    rows = [row(None, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for lang in ("en", "fr") for _ in range(40)]
    found = languages.identify(spark.createDataFrame(rows, CLASHING)).collect()
    assert Counter(r.lang_pred for r in found) == Counter({"en": 40, "fr": 40})


def test_windows_are_told_apart_by_128_bits(spark, monkeypatch):
    """Words that collide in one hash are words of their own: nothing is removed for it."""
    from lectern.llm import substrings

    rng = random.Random(3)
    texts = [" ".join(f"{k}w{rng.randrange(9)}" for _ in range(60)) for k in range(6)]
    texts.append(texts[0][:200])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frames = [(np.array([k]), np.array([True]), [t.encode()]) for k, t in enumerate(texts)]
    alone = [substrings._Block(*f) for f in frames]
    monkeypatch.setattr(substrings, "_HASHES", (lambda w: 7, substrings._HASHES[1]))
    collided = [substrings._Block(*f) for f in frames]
    assert len({w for b in collided for w in b.windows.tolist()}) == 1
    for a, b in zip(alone, collided, strict=True):
        assert (a.checks == b.checks).all() and (a.firsts()[0] == b.firsts()[0]).all()
    monkeypatch.undo()
    rows = {r.doc_id: r for r in substrings.factor_documents(df).collect()}
    assert rows[6].n_removed > 20 and not any(rows[k].n_removed for k in range(6))


def test_encode_holds_one_block_of_texts():
    """However long Spark's batch is, only a block's texts become objects; blocks are those of frames."""
    import tracemalloc

    texts = [f"{k} " + "ab " * 5000 for k in range(2000)] + [None, "", "é" * 40000]
    ids = [None, *range(len(texts) - 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    tracemalloc.start()
    try:
        run, size = bytebpe._pretokens(public_tokenizers.PATTERN, 4, 200_000), sum(len(t or "") for t in texts)
        n = sum(b.to_pydict()["kind"].count("documents") for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 100 and peak < size / 3
    whole = [(b, i.tolist(), h.tolist(), t) for b, i, h, t in blocks.cut_batches(iter([batch]), 200_000)]
    assert whole == [(b, i.tolist(), h.tolist(), t) for b, i, h, t in blocks.cut(iter([batch.to_pandas(integer_object_nulls=True)]), 200_000)]
