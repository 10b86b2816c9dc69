"""Each operator against a brute-force restatement on a small fixture, and its edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import blocks, bytebpe, exact_dedup, fuse, languages, licenses, mixing, neardup, pseudolm, quality, substrings, urls

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


OPERATORS = {
    "quality": quality.judge,
    "languages": languages.identify,
    "substrings": substrings.factor_documents,
    "licenses": licenses.scan,
    "mixing": mixing.mixture,
    "neardup": neardup.near_groups,
    "bytebpe": bytebpe.encode_with_public_ranks,
    "pseudolm": pseudolm.score_documents,
    "exact": exact_dedup.exact_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_id_and_repeated_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) == 5
    assert Counter(r["doc_id"] for r in got) == {None: 2, 5: 2, 6: 1}


def test_quality(docs):
    got = rows_of(quality.judge(docs))
    for r in docs.collect():
        w = words(r.text)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count, covered = Counter(runs), set()
        for i, run in enumerate(runs):
            if count[run] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""))
        assert (g.n_dup_lines, g.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (g.base_failed and g.kept) and (g.class_distance is None) == (len(w) < 20)


def test_quality_divergence(spark, docs):
    """The distances against numpy, from the same references."""
    found = quality.features(docs).cache()
    refs = quality.references(found)
    assert len(refs) == 2

    def distance(hist, ref):
        p, q = np.array(hist) / sum(hist), np.array(ref)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    got = rows_of(quality.judge(docs))
    for r in found.collect():
        if r.n_words >= quality.LEAST_WORDS:
            assert got[r.doc_id].class_distance == pytest.approx(min(distance(r.class_hist, x[0]) for x in refs), abs=1e-9)
            assert got[r.doc_id].word_distance == pytest.approx(min(distance(r.word_hist, x[1]) for x in refs), abs=1e-9)


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 400, languages.PIECE, languages.PIECE + 1, 2 * languages.PIECE, 2])
    scores, start, steps = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=3), rng.normal(size=(3, 3))
    got, low = languages.marginals(scores, lengths, start, steps), 0
    for n in lengths:
        want, _ = languages.pair_marginals(scores[None, low : low + n], start, steps)
        assert np.allclose(got[low : low + n], want[0])
        low += n


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_languages_edges(docs):
    got = rows_of(languages.identify(docs))
    for r in docs.collect():
        g = got[r.doc_id]
        assert 0 <= g.score <= 1 and (g.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = languages.identify(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_word_features_are_each_words_own():
    """A word's features don't depend on the words around it."""
    words_ = ["Maison,", "12", "été", "x", "the", "ñandú", "--", "The", "😀a"]
    ids, starts = languages.word_features(words_)
    apart = np.split(ids, starts[1:])
    for w, own in zip(words_, apart, strict=True):
        assert sorted(languages.word_features([w])[0].tolist()) == sorted(own.tolist())
    assert sorted(apart[4].tolist()) == sorted(apart[7].tolist()) and apart[1].tolist() == [1]


def test_code_switching():
    rows = [("en", f"the dog and cat of house {k}".split()) for k in range(30)] + [("fr", f"le chien de la maison été {k}".split()) for k in range(30)]
    model = languages.fit(rows)
    text = "the dog and the cat of the house le chien de la maison et le chat".split()
    table = languages._Scores(model)
    at = table.places_of([w.encode() for w in text])
    m = languages.marginals(table.rows[at].astype(float), np.array([len(text)]), model.start, model.steps)
    assert list(m[:8].argmax(axis=1)) == [0] * 8 and list(m[8:13].argmax(axis=1)) == [1] * 5


def test_substrings(docs):
    rows = sorted((r.doc_id, words(r.text)) for r in docs.collect())
    seen, want = set(), {}
    for doc, w in rows:
        gone = set()
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            if run in seen:
                gone.update(range(i, i + 20))
            seen.add(run)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[doc] = (len(w), len(gone), sha(kept.encode()), kept)
    got = rows_of(substrings.factor_documents(docs))
    texts = dict(rows)
    for doc, expected in want.items():
        g = got[doc]
        assert (g.n_words, g.n_removed, g.kept_sha256, g.kept_text) == expected
        covered = set()
        for start, n, ref, at in zip(g.starts, g.lengths, g.ref_docs, g.ref_starts, strict=True):
            assert n >= 20 and texts[doc][start : start + n] == texts[ref][at : at + n]
            assert (ref, at) < (doc, start)
            covered.update(range(start, start + n))
        assert len(covered) == g.n_removed
    assert any(w[1] for w in want.values())


def test_substrings_across_blocks(spark, monkeypatch):
    """Many blocks of one or two documents give what one block gives."""
    text = " ".join(f"w{k % 37}" for k in range(60))
    rows = [(i, f"a{i} b{i} " + " ".join(f"q{i}x{j}" for j in range(5)) + " " + text) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.factor_documents(df.coalesce(1)).collect()}
    many = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.factor_documents(df.repartition(12)).collect()}
    assert one == many and one[0][0] == 23 and one[5][0] == 60


def test_licenses(spark):
    texts = ["Released under the MIT License.", "all rights, RESERVED. cc-by x CC BY", None, "", "general\npublic license and General Public License",
             "Licensed under the Apache License, Version 2.0.", "Licensed under the new Apache License, Version 2.0.", "mit license", "allé rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(licenses.scan(df))
    assert [got[k].labels for k in range(9)] == ["mit", "cc-by,reserved", "", "", "gpl", "apache-2.0", "apache-2.0", "", ""]
    assert [(got[k].n_base, got[k].first_word, got[k].last_word) for k in (1, 4, 8)] == [(3, 0, 6), (2, 0, 4), (0, None, None)]
    assert got[0].score == 1.0 and got[2].score == 0.0 and 0.5 < got[6].score < 1


def test_license_rows_are_judged_each_by_its_own_text(spark):
    texts = [(None, "Released under the MIT License."), (None, "plain words only"), (3, "plain words"), (3, "Released under the MIT License."), (4, "Released under the MIT Licen\u017fe.")]
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in texts], "doc_id long, text string, row long, hits array<int>")
    got = Counter((r.doc_id, r.n_words, r.labels) for r in licenses.scan(df).collect())
    assert got == Counter([(None, 5, "mit"), (None, 3, ""), (3, 2, ""), (3, 5, "mit"), (4, 5, "mit")])


def test_license_base_against_brute_force(docs):
    got = rows_of(licenses.scan(docs))
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        assert got[r.doc_id].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def _targets(sizes):
    """Water-filling by repeated cutting."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3 * sizes[s]
            left -= fixed[s]


def test_mixing(docs):
    texts = docs.collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r.source] += len(words(r.text))
    want, got = _targets(sizes), rows_of(mixing.mixture(docs))
    taken = defaultdict(int)
    for r in texts:
        g = got[r.doc_id]
        assert g.size == len(words(r.text)) and g.source_size == sizes[r.source] and g.target == pytest.approx(want[r.source])
        assert 0 <= g.taken <= 3 * g.size
        taken[r.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {k: v.taken for k, v in rows_of(mixing.mixture(docs.repartition(3))).items()} == {k: v.taken for k, v in got.items()}


def test_mixing_stops_small_sources(spark):
    rows = [(k, "a " * 100, "big") for k in range(50)] + [(100 + k, "b c", "aaa") for k in range(3)] + [(200, "", "none")]
    got = rows_of(mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[100].target == 18.0 and [got[100 + k].taken for k in range(3)] == [6, 6, 6]
    assert got[200].target == 0.0 and sum(r.taken for r in got.values() if r.size == 100) == 4988


def test_schedule_has_no_runs(spark):
    """Any stretch of the schedule is near the shares."""
    needs = spark.createDataFrame([(0, 500, 0.0, 0.5, 1000), (1, 300, 0.5, 0.8, 1000), (2, 200, 0.8, 1.0, 1000)], "sid long, slots long, low double, high double, all_slots long")
    order = [r.sid for r in mixing.slot_schedule(spark, needs).orderBy("slot").collect()]
    assert Counter(order) == {0: 500, 1: 300, 2: 200}
    for low in range(0, 900, 100):
        part = Counter(order[low : low + 100])
        assert abs(part[0] - 50) <= 3 and abs(part[1] - 30) <= 3 and abs(part[2] - 20) <= 3


def brute_near(texts):
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_copies(docs):
    want = brute_near({r.doc_id: r.text for r in docs.collect()})
    got = {k: (r.n_shingles, r.component_id) for k, r in rows_of(neardup.near_groups(docs)).items()}
    assert got == want


def test_near_copies_in_a_crowd(spark):
    """One large group, chains between two groups, and texts that share only a passage."""
    import random

    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = {}
    for k in range(120):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        texts[k] = " ".join(w)
    for k in range(20):
        texts[200 + k] = " ".join(base[:30] + [f"y{k}{j}" for j in range(30)])
    chain = [f"c{j}" for j in range(80)]
    for k in range(10):
        texts[300 + k] = " ".join(chain[k * 3 : k * 3 + 50])
    got = {k: (r.n_shingles, r.component_id) for k, r in rows_of(neardup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6))).items()}
    assert got == brute_near(texts)


def template_family(pairs=200, shared=160, seed=3):
    """Texts of 200 words with one template each; two and two are similar at 0.754."""
    import random

    rng = random.Random(seed)
    template = [f"t{j}" for j in range(shared)]
    texts = {}
    for k in range(pairs):
        own = [f"o{k}x{j}" for j in range(204 - shared)]
        one, two = template + own, template + own[:-28] + [f"z{k}x{j}" for j in range(28)]
        ids = rng.sample(range(10**9), 2)
        texts[ids[0]], texts[ids[1]] = " ".join(one), " ".join(two)
    return texts


@pytest.mark.parametrize("m", [60, 600])
def test_near_candidates_grow_with_components_not_with_rows(m):
    comp = np.arange(m) % 3
    frame = neardup.pd.DataFrame({"tree": 0, "sign": [b"\0" * 2 * neardup.DEPTH] * m, "node": np.arange(m), "sketch": [b"\0" * (neardup.FUNCTIONS // 4)] * m,
                                  "n": 100, "comp": comp, "fresh": True})
    pairs = neardup.near_pairs(frame, True)
    assert {tuple(sorted((comp[a], comp[b]))) for a, b in zip(pairs["a"], pairs["b"], strict=True)} == {(0, 1), (0, 2), (1, 2)}
    assert len(pairs) == 3


@pytest.mark.parametrize("region_rows", [4096, 32])
def test_near_copies_in_a_template_family(spark, monkeypatch, region_rows):
    """Rows of the same region that fail the filters don't take the place of those that link; also in chunks."""
    if hasattr(neardup, "REGION_ROWS"):
        monkeypatch.setattr(neardup, "REGION_ROWS", region_rows)
    texts = template_family()
    got = {k: (r.n_shingles, r.component_id) for k, r in rows_of(neardup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6))).items()}
    want = brute_near(texts)
    assert len({c for _, c in want.values()}) == 200
    assert got == want


def test_bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bytebpe.RANKS), "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(bytebpe.encode_with_public_ranks(docs))
    for r in docs.collect():
        ids = known.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))
    whole = rows_of(bytebpe.encode_documents(docs, P.path(bytebpe.RANKS), P.PATTERN))
    for r in docs.collect():
        assert bytes(whole[r.doc_id].decoded) == (r.text or "").encode()
        assert np.frombuffer(bytes(whole[r.doc_id].ids), "<u4").tolist() == known.encode_ordinary(r.text or "")


def plain_log_prob(net, window, word, counts):
    """A word's log-probability in a window (words, None beyond the ends), by the definition alone."""
    h = blocks.WordHashes()
    leaf_of = {w: int(pseudolm.leaves_of(h.array([w]))[0]) for w in counts}
    totals = np.zeros(pseudolm.CLASSES * pseudolm.LEAVES)
    for w, n in counts.items():
        totals[leaf_of[w]] += n
    x = net.bias.astype(float)
    for k, w in enumerate(window):
        x = x + net.embed[0 if w is None else int(pseudolm.rows_of(h.array([w]))[0])] * net.place[k]
    x = np.tanh(x)
    per = totals.reshape(pseudolm.CLASSES, pseudolm.LEAVES)
    c, s = divmod(leaf_of[word], pseudolm.LEAVES)
    above = per.sum(axis=1) * np.exp(net.upper.astype(float) @ x)
    below = per[c] * np.exp(net.lower[c].astype(float) @ x)
    return math.log(above[c] / above.sum()) + math.log(below[s] / below.sum()) + math.log(counts[word] / totals[leaf_of[word]])


def test_pseudo_likelihood(spark, docs):
    """Every word's log-probability worked out by itself, from the same network; texts of any length."""
    got, rows = rows_of(pseudolm.score_documents(docs)), docs.collect()
    counts = Counter(w for r in rows for w in (r.text or "").encode().split())
    net = pseudolm.train(pseudolm.sample(docs, len(rows)))
    known = {}
    for r in rows:
        w = (r.text or "").encode().split()
        g = got[r.doc_id]
        assert g.n_words == len(w) and (g.score is None) == (not w)
        want = 0.0
        for t, word in enumerate(w):
            window = tuple(w[t + d] if 0 <= t + d < len(w) else None for d in pseudolm.OFFSETS)
            if len(w) > 500 and t % 97:  # a long text: words throughout it
                continue
            if (window, word) not in known:
                known[window, word] = plain_log_prob(net, window, word, counts)
            want += known[window, word]
        if len(w) <= 500:
            assert g.log_prob == pytest.approx(want, rel=1e-4, abs=1e-3)
            assert g.log_prob <= 0
        else:
            assert g.log_prob / len(w) == pytest.approx(want / len(range(0, len(w), 97)), rel=0.2)
    again = rows_of(pseudolm.score_documents(docs.repartition(2)))
    assert all(abs(again[k].log_prob - r.log_prob) < 1e-4 * (1 + abs(r.log_prob)) for k, r in got.items())


def test_pseudo_likelihoods_sum_to_one(docs):
    """Over the whole vocabulary, in windows of words at random, also ones that the network has never seen."""
    rows = docs.collect()
    counts = Counter(w for r in rows for w in (r.text or "").encode().split())
    net = pseudolm.train(pseudolm.sample(docs, len(rows)))
    h, vocabulary = blocks.WordHashes(), sorted(counts)
    leaves = pseudolm.leaves_of(h.array(vocabulary))
    totals = np.bincount(leaves, [counts[w] for w in vocabulary], pseudolm.CLASSES * pseudolm.LEAVES)
    share = np.log(np.array([counts[w] for w in vocabulary]) / totals[leaves])
    rng = np.random.default_rng(1)
    for _ in range(40):
        around = np.repeat(rng.integers(pseudolm.ROWS, size=(1, 4)), len(vocabulary), axis=0)
        assert np.exp(share + net.log_leaf(leaves, around, totals)).sum() == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood_is_fitted_on_every_text(spark, monkeypatch):
    """Words in pairs, of which the stretches that the fit starts from show three at most: it knows the other pairs too."""
    monkeypatch.setattr(pseudolm, "SAMPLE_ROWS", 3)
    monkeypatch.setattr(pseudolm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(pseudolm, "BLOCK_BATCH", 256)
    rows = [(k, " ".join([f"a{k % 40}", f"b{k % 40}"] * 60)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [r.score for r in pseudolm.score_documents(docs).collect()]
    assert len(scores) == 1200
    # A word's share of the corpus alone has log(1 / 80), about -4.4.
    assert sum(s > -2.2 for s in scores) > 1000, sorted(scores)[::100]


def test_blocks_are_averaged_by_words(spark, docs):
    """A round's network is the mean of what its blocks make, worked out by itself."""
    made = pseudolm.sample(docs.where("length(text) < 2000"), 50)
    net, sums = pseudolm._start(made.first, 5)
    parts = []
    for r in made.blocks.where("turn = 0").collect():
        at = blocks.unpack_places(bytes(r["body"])).astype(np.int64)
        parts.append(list(pseudolm._moved(net, sums, made.counts, blocks.unpack(bytes(r["hashes"]), "<u8"), at, np.frombuffer(bytes(r["lens"]), "<i8"))))
    got = pseudolm._averaged(net, sums, made.blocks.where("turn = 0"), made.counts)
    for name in pseudolm.TABLES:
        total, weight = np.zeros(getattr(net, name).shape), np.zeros(len(getattr(net, name)))
        for part in parts:
            ((places, change, n),) = [x[1:] for x in part if x[0] == name]
            for k, row in enumerate(np.arange(len(weight))[places]):
                total[row] += change[k] * n[k]
                weight[row] += n[k]
        used = weight > 0
        want = getattr(net, name).astype(float)
        want[used] += total[used] / weight[used].reshape(-1, *[1] * (want.ndim - 1))
        assert np.allclose(getattr(got, name), want, atol=1e-5) and used.any()


def test_pseudo_likelihood_reads_both_sides():
    """A word that both neighbours call for is likelier than one that they don't."""
    rng = np.random.default_rng(3)
    w = [f"w{k}".encode() for k in range(6)]
    stretches = []
    for _ in range(20000):
        a, b = rng.integers(3, size=2)
        stretches.append([w[a], w[3 + (a + b) % 3], w[b]])
    net = pseudolm.train(stretches)
    hashes = blocks.WordHashes().array(w)
    rows, leaves = pseudolm.rows_of(hashes), pseudolm.leaves_of(hashes)
    counts = np.bincount(leaves, minlength=pseudolm.CLASSES * pseudolm.LEAVES)
    assert len(set(leaves.tolist())) == 6
    right = 0
    for a in range(3):
        for b in range(3):
            around = np.array([[0, rows[a], rows[b], 0]] * 6)
            p = np.exp(net.log_leaf(leaves, around, counts))
            right += int(p.argmax() == 3 + (a + b) % 3 and p.max() > 0.8)
    assert right == 9


def test_exact_groups(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    got = rows_of(exact_dedup.exact_groups(docs))
    for text, ids in groups.items():
        for i in ids:
            g = got[i]
            assert (g.keep_id, g.group_size, g.kept, g.text_sha256) == (max(ids), len(ids), i == max(ids), sha(text.encode()))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 60000])
def test_fuse_filters(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    data = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.contains(data, keys).all()
    assert fuse.contains(data, rng.integers(2**63, 2**64 - 1, 100_000, dtype=np.uint64)).mean() < 0.0005
    assert n < 1000 or len(data) < 3 * n


def test_urls(spark):
    page = '<html><head><LINK href="{}" rel="canonical"></head></html>'
    refresh = '<meta http-equiv="refresh" content="0; URL={}">'
    rows = [
        (1, "http://a.net/x", None), (2, "http://A.example.net/en/x?y#z", ""), (3, "https://b.org/y", page.format("http://a.net/x")),
        (4, "https://c.org/y", page.format("//b.org/y")), (5, "https://d.org/fr/x", page.format("https://c.org/y#q")), (6, "https://e.org/z", refresh.format("/w")),
        (7, "https://e.org/w", refresh.format("http://q.example.com/de/1")), (8, None, None), (9, "nothing", ""), (10, "http://net", ""), (11, "http://xnet.org/", ""),
        (12, "http://f.org/a", page.format("http://gone.net/")), (13, "http://f.org/a", ""),
    ]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.net", "net/", "block"), 2: ("a.example.net", "example.net/en/", "allow"), 3: ("b.org", None, "allow"), 4: ("c.org", None, "allow"),
        5: ("d.org", "org/fr/", "allow"), 6: ("e.org", None, "block"), 7: ("e.org", None, "block"), 8: ("", None, "allow"), 9: ("", None, "allow"),
        10: ("net", None, "allow"), 11: ("xnet.org", None, "allow"), 12: ("f.org", None, "block"), 13: ("f.org", None, "block"),
    }
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rolling_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    both = blocks.rolling(np.concatenate([h, h]), 20)
    assert both[3] == both[53] and len(set(both[:50].tolist())) == 50 and len(blocks.rolling(h[:5], 20)) == 0


def test_url_addresses(spark):
    """Relative addresses against the standard resolver."""
    from urllib.parse import urljoin

    bases = ["http://a.org/x/y", "https://a.org", "http://a.org/q?b=1", "http://a.org/x/"]
    tos = ["../z", "?b=2", "/r/./s/../t", "//h.net/p", "http://c.d/e", "login?next=https://x", "", "./", "..", "z#f", "../../../up", "a/b/.."]
    rows = [(b, t) for b in bases for t in tos if t]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", urls.resolved(F.col("b"), F.col("t")).alias("r")).collect()
    assert [(r.b, r.t, r.r) for r in got] == [(b, t, urljoin(b, t)) for b, t in rows]


def alias_pages(seed=4):
    """Chains, cycles, conflicts, a giant component, ends that are no page, odd rows."""
    import random

    rng, pages = random.Random(seed), []
    hosts = ["a.com", "b.net", "example.net", "www.example.com", "c.org", "D.Org"]
    url = lambda k: f"http://{hosts[k % 6]}/{['en', 'de', 'fr', 'x'][k % 4]}/p{k}"
    link = ['<link rel="canonical" href="{}">', "<link href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<LINK REL='Canonical' HREF={}>"]
    for k in range(160):
        to = url(k + 1) if k < 40 else url(40) if k < 90 else url(rng.randrange(90, 400)) if k < 130 else f"../fr/p{rng.randrange(130, 160)}"
        html = "<html>" + link[k % 4].format(to) + (link[0].format(url(rng.randrange(300))) if k % 9 == 0 else "") + "<p>" + "x" * (20000 if k == 7 else 5)
        pages.append((k, url(k), html if k % 13 else None))
    pages += [(None, url(3), "<p>"), (None, url(3), None), (500, None, "<link rel=canonical href=http://b.net/x>"), (501, "no scheme", None), (502, "", "")]
    return pages


def test_urls_against_brute_force_and_sql(spark, tmp_path):
    pages = alias_pages()
    schema = "page_id long, url string, html string, host long, node string, component long, own string"
    df = spark.createDataFrame([(*p, 1, "n", 2, "allow") for p in pages], schema)
    node = lambda u: re.sub("#.*$", "", re.sub(r"^[^/?#]*://[^/?#]*", lambda m: m[0].lower(), u))
    split = lambda u: re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if u and "://" in u else ("", "")

    def rule(u):
        host, path = split(u)
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    from urllib.parse import urljoin

    near = defaultdict(set)
    for _, u, html in pages:
        for tag in re.findall(r"(?i)<(?:link|meta)[^>]*>", html or "") if u is not None else []:
            to = re.search(r"""(?i)(?:href=|url=)["']?([^"'\s>]+)""", tag)[1]
            a, b = node(u), node(urljoin(u, to))
            near[a].add(b)
            near[b].add(a)

    def component(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    want = []
    for i, u, _ in pages:
        name, verdict = rule(u)
        passed = {rule(x)[1] for x in component(node(u))} if u else set()
        want.append((i, split(u)[0].lower(), split(u)[1], name, verdict or ("allow" if "allow" in passed else "block" if "block" in passed else "allow")))
    got = [tuple(r) for r in urls.judge_urls(df).collect()]
    assert Counter(got) == Counter(want)
    assert sum(len(component(x)) > 40 for x in list(near)) > 40
    import duckdb

    df.select("page_id", "url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    assert Counter(con.execute(urls.ORACLES["op9_url_equivalence"]).fetchall()) == Counter(want)


def test_marginals_by_enumeration():
    """Every path of labels weighed by itself."""
    from itertools import product

    rng = np.random.default_rng(5)
    scores, start, steps = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want = np.zeros((5, 3))
    for path in product(range(3), repeat=5):
        weight = math.exp(start[path[0]] + sum(scores[t, path[t]] for t in range(5)) + sum(steps[path[t], path[t + 1]] for t in range(4)))
        for t in range(5):
            want[t, path[t]] += weight
    got = languages.marginals(scores, np.array([5]), start, steps)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_lexicon_and_word_labels(spark):
    rows = [("en", ("dog", "the,", "12")), ("en", ("Dog", "the", "la")), ("en", ("dog", "the", "la")), ("fr", ("la", "le")), ("fr", ("le", "la")), ("fr", ("le",))]
    assert languages.learned_lexicon(rows, ["en", "fr"]) == {"dog": 0, "the": 0, "le": 1}
    with_, without = (languages.word_features(["The", "la", "12"], x) for x in ({"the": 0}, {}))
    assert len(with_[0]) == len(without[0]) + 1 and with_[1].tolist() == [0, without[1][1] + 1, without[1][2] + 1]
    docs = [(2 * k, f"the dog and cat of house {k} dog", "en") for k in range(40)] + [(2 * k + 1, f"le chien de la maison été {k}", "fr") for k in range(40)]
    docs += [(None, "the dog 12 le chien maison", None), (900, None, None), (901, "", "en")]
    got = languages.label_words(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r.labels for r in got}
    assert len(got) == 83 and by_id[900] == [] and len(by_id[None]) == 6 and by_id[None][2] is None


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(5, "a " * 30, "s"), (5, "b " * 90, "s"), (None, "c " * 40, "s"), (None, "d " * 70, "s"), (None, None, None)] + [(k, "e " * (k + 1), "tt") for k in range(20)]
    taken = []
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, 1, 2) for r in part], "doc_id long, text string, source string, _times int, size long").repartition(3)
        taken.append(Counter((r.doc_id, r.size, r.taken) for r in mixing.mixture(df).collect()))
        assert mixing.repeat_by_mix(df).columns == df.columns and mixing.repeat_by_mix(df).count() >= 0
    assert taken[0] == taken[1]


def test_stages_decide_by_row(spark):
    """Rows that share an id are judged each by its text; copies without id, or with one id, stay once."""
    rows = [(5, "a b"), (5, "c d"), (6, "a b"), (None, "n n"), (None, "n n"), (7, "q q"), (7, "q q")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, text_hash int")
    got = Counter((r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect())
    assert got == Counter([(5, "c d"), (6, "a b"), (None, "n n"), (7, "q q")])
    near = Counter((r.doc_id, r.text) for r in neardup.drop_near_copies(df).collect())
    assert near == Counter([(5, "a b"), (5, "c d"), (None, "n n"), (None, "n n"), (7, "q q")])


def test_text_hash_is_the_same_on_both_sides(spark):
    from lectern.llm import common

    texts = ["", "a", "é😀" * 50, "x" * 1000, None]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").select(common.text_hash().alias("h")).collect()]
    assert got == [common.hash_of((t or "").encode()) for t in texts]


def test_words_of_a_block_are_those_of_split():
    """Without an object for every word: a block's words cost less memory than a list of them."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    texts = [None, "", " ", "  a  b ", "\ta\x0bb\x0cc\rd\n", "é x y\x85z\x1cw", "one", "x" * 5000]
    texts += ["".join(rng.choice(" \t\n\x0b\x0c\r\x1cab é") for _ in range(rng.randrange(40))) for _ in range(500)]
    sizes, at, listed = pseudolm._words(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    words = [(t or "").encode().split() for t in texts]
    flat = [x for w in words for x in w]
    assert sizes.tolist() == [len(w) for w in words] and listed == list(dict.fromkeys(flat))
    assert [listed[k] for k in at.tolist()] == flat
    long = pa.table({"block": pa.array([0], pa.int64()), "doc_id": pa.array([1], pa.int64()), "text": pa.array([b"ab cd ef gh " * 250_000], pa.binary())})
    pseudolm._cut(1)(long)
    tracemalloc.start()
    try:
        pseudolm._cut(1)(long)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30_000_000  # a list of a million words and their objects has 44 MB
