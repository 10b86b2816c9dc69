"""Alignment against a walk over both tokenizers' tokens, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment as A
from lectern.llm import pieces as P

PATHS = [public_tokenizers.path(n) for n in (A.A_MODEL, A.B_MODEL)]


def sides(text):
    """``(id, bytes)`` of both tokenizers' tokens of a whole text."""
    model = Tokenizer.from_file(PATHS[0])
    model.encode_special_tokens = True
    # Byte-level vocabularies write each byte as a character; the decoder undoes a whole sequence, so single tokens are put
    # together from the alphabet itself.
    alphabet, spare = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            alphabet[chr(b)] = b
        else:
            alphabet[chr(256 + spare)] = b
            spare += 1
    first = model.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(first.ids, first.tokens, strict=True)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def walked(text):
    """Groups, and the id pairs of all links."""
    if not text:
        return [], []
    a, b = sides(text)
    want = b" " + text.encode()
    if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
        return [], []
    owner = [[k for k, (_, t) in enumerate(side) for _ in t] for side in (a, b)]
    pairs = sorted(set(zip(*owner, strict=True)))
    groups, left, right = [], [], []
    for n in range(len(want)):
        for own, side, owners in ((left, a, owner[0]), (right, b, owner[1])):
            if n == 0 or owners[n] != owners[n - 1]:
                own.append(side[owners[n]][0])
        if n + 1 == len(want) or (owner[0][n] != owner[0][n + 1] and owner[1][n] != owner[1][n + 1]):
            groups.append((left, right))
            left, right = [], []
    return groups, [(a[i][0], b[j][0]) for i, j in pairs]


def restated(rows):
    """Rows of the query for ``(doc_id, text)``, sorted."""
    found = [(i, *walked(t)) for i, t in rows]
    counts = Counter(p for _, _, links in found for p in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(len(x) * len(y) for x, y in groups), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), written,
        ))
    return sorted(out, key=repr)


ODD = [
    "▁ marks", "a  b   c", "  lead", "trail ", "\x00nul", "tab\tline\n\nend", "<s> </s> <unk> <0x41> <|endoftext|>", "Ĥello Ġ", "naïve ﬁ é é ½",
    "日本語のテキスト", "😊👍🏽 ok", "a​b﻿c\xa0d\x85e", "don't we'LL 3.14159 1,000,000", " x ", "x" * 700, " ", "\n", "ǅ ß İ ſ", "﷽ ௵",
]


def test_same_as_walk(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None if k % 4 == 0 else 1000 + k, t) for k, t in enumerate(ODD)] + [(1001, ODD[1])]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, code long, n long, kind string").repartition(3)
    found = A.align_documents(df, *PATHS)
    assert sorted(map(tuple, found.collect()), key=repr) == restated(rows)
    pairs = Counter(tuple(r)[2:] for r in A.expand_groups(found).collect())
    want = Counter((x, y) for _, t in rows for left, right in walked(t)[0] for x in left for y in right)
    assert pairs == want


def test_small_blocks_make_no_difference(spark, docs, monkeypatch):
    few = docs.limit(25).cache()
    one = sorted(map(tuple, A.align_documents(few, *PATHS).collect()), key=repr)
    monkeypatch.setattr(A, "SPAN_BYTES", 500)
    small = [(r.doc_id, r.text.encode() if r.text is not None else b"") for r in few.collect()]
    known = A.tables(*[open(p, "rb").read() for p in PATHS])
    data = [open(p, "rb").read() for p in PATHS]
    for i, t in small:
        (alone,) = A.align(known, *data, [t])
        own = next(r for r in one if r[0] == i)
        assert tuple(int(alone.figures[f][0]) for f in A._FIGURES) == own[1:6] and alone.groups[0].decode() == own[8]


def test_words_read_as_the_whole():
    """Texts cut at every place where a word may end have the tokens of the whole."""
    rng = random.Random(2)
    bits = ["word", "é", "12", " ", " ", "  ", "\n", "'s", ".", "Ab", "日", "😊", "▁", "_", "\t", "<s>", "x", " a", " 7", "\xa0", "\x1c", "\x85", "́", "\u3000", "<|endoftext|>"]
    data = [open(p, "rb").read() for p in PATHS]
    plain, model = P.tokenizer(data[0], True), P.sentences(data[1])
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        parts = P.words(text)
        assert " ".join(parts) == text
        assert [i for p in parts for i in plain.encode(" " + p, add_special_tokens=False).ids] == plain.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in model.encode(p)] == model.encode(text)


def test_a_very_long_text(spark):
    text = "alpha beta gamma. " * 60_000
    row = A.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), *PATHS).first()
    groups, links = walked("alpha beta gamma. " * 100)
    assert row.n_a > 200_000 and len(row.groups.split(";")) == row.n_groups
    assert row.groups.startswith(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[:300]))


def test_digests_and_empty_table(spark, docs, empty):
    few = docs.limit(10).cache()
    whole = {r.doc_id: r.groups for r in A.align_documents(few, *PATHS).collect()}
    short = {r.doc_id: r.groups for r in A.align_documents(few, *PATHS, whole=False).collect()}
    assert short == {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in whole.items()}
    assert A.align_documents(empty, *PATHS).count() == 0


@pytest.mark.parametrize("side", [0, 1])
def test_token_bytes(side):
    data = open(PATHS[side], "rb").read()
    tokens = (A.a_tokens, A.b_tokens)[side](data)
    assert len(tokens) == (50257, 32000)[side] and all(tokens[3:])
