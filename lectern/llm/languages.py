"""Language identification by a linear-chain conditional random field.

Each word of a text is labelled with a language: affixes, character n-grams,
the word itself and a learned lexicon give its scores, learned transitions tie
it to its neighbours, and forward-backward gives every word's marginals, so a
text that switches language is labelled piece by piece.  A text's language is
the one with the largest sum of marginals over its words with letters; the
score is that sum's share.

The weights are fitted with numpy on a bounded sample of labelled rows
(:data:`SAMPLE_ROWS` rows, :data:`SAMPLE_WORDS` consecutive words of each).
Sampled stretches of different languages are put end to end, so that the
transitions are learned from sequences that switch.

Cases: a null text, or one without letters, is ``und`` with score 0, and so is
all where no labelled row can be learned from; null languages aren't learned;
equal sums go to the label first in code-point order; rows that repeat get the
same answer each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.blocks import cut, mix, tidied
from lectern.llm.common import drop_rows, hash_of, text_hash, words
from lectern.storage import table

#: Bounds of the sample that the weights are fitted on.
SAMPLE_ROWS = 2_400
SAMPLE_WORDS = 120
#: Lengths of the stretches that training sequences are made of.
STRETCH = (6, 40)
#: Weights are kept for so many hashed features; every word has so many of them.
BUCKETS = 1 << 17
#: A word's features are remembered up to so many words in a task.
REMEMBERED = 150_000
#: Words whose features are worked out at a time, and bytes of text labelled at a time; they bound a worker's memory.
FEATURE_WORDS = 16_384
LABEL_BYTES = 1_000_000
EPOCHS = 6
#: A word of the sample is in the lexicon if it is in so many of its rows, and in this share of them under one label.
LEXICON_ROWS = 3
LEXICON_SHARE = 0.9
#: Words of a text that one step of forward-backward runs over.
PIECE = 192
UNDETERMINED = "und"
#: The pipeline rejects texts without a language, and those of which no language has this share.
LEAST_SCORE = 0.3

_EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_/\\0123456789"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind + 1, dtype=np.uint64)
    for part in parts:
        h = mix(h * _PRIME + part.astype(np.uint64))
    return (h % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def _core(word: str) -> str:
    return word.lower().strip(_EDGES) if _has_letter(word) else ""


def learned_lexicon(rows: list[tuple[str, tuple[str, ...]]], labels: list[str]) -> dict[str, int]:
    """Words that the sample has seen under one label alone, or nearly, with the label's place."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, listed in rows:
        for core in {_core(w) for w in listed} - {""}:
            seen[core][labels.index(lang)] += 1
    found = {}
    for core, per in seen.items():
        (label, n), total = min(per.items(), key=lambda x: (-x[1], x[0])), per.total()
        if total >= LEXICON_ROWS and n >= LEXICON_SHARE * total:
            found[core] = label
    return found


def word_features(words: list[str], lexicon: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words end to end, and where each word's begin.

    The label under which the lexicon has the word, the word itself, prefixes and suffixes of up to three characters,
    three-character grams with the word's ends, characters beyond ASCII, and
    whether it has any; a word without letters has one feature of its own.
    """
    cores = [_core(w) for w in words]
    lens = np.array([len(c) for c in cores], dtype=np.int64)
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    full = np.flatnonzero(lens)
    n, start = lens[full], (np.cumsum(lens) - lens)[full]
    owner = np.repeat(np.arange(len(full)), n)
    # Each word between two edge marks.
    edged = np.full(len(codes) + 2 * len(full), ord("<"), dtype=np.uint64)
    edged[np.arange(len(codes)) + 2 * owner + 1] = codes
    low = start + 2 * np.arange(len(full))
    edged[low + n + 1] = ord(">")
    found = [(np.flatnonzero(lens == 0), np.ones(int((lens == 0).sum()), dtype=np.int64))]
    listed = np.array([(lexicon or {}).get(c, -1) for c in cores], dtype=np.int64)
    in_lexicon = np.flatnonzero(listed >= 0)
    if len(in_lexicon):
        found.append((in_lexicon, _bucket(10, listed[in_lexicon] + 1)))
    if len(full):
        place = np.arange(len(codes)) - np.repeat(start, n)
        spread = mix(codes + _PRIME * (place.astype(np.uint64) + np.uint64(1)))
        whole = np.add.reduceat(spread, start)
        beyond = codes > 127
        found.append((full, _bucket(0, whole)))
        found.append((full, _bucket(1, np.maximum.reduceat(beyond, start))))
        for k in (1, 2, 3):
            long = n >= k
            heads = [edged[low[long] + 1 + i] for i in range(k)]
            tails = [edged[low[long] + n[long] - i] for i in range(k)]
            found += [(full[long], _bucket(1 + k, *heads)), (full[long], _bucket(4 + k, *tails))]
        # As many grams as characters: their middles.
        middle = np.arange(len(codes)) + 2 * owner + 1
        found.append((full[owner], _bucket(8, edged[middle - 1], edged[middle], edged[middle + 1])))
        found.append((full[owner[beyond]], _bucket(9, codes[beyond])))
    word = np.concatenate([w for w, _ in found])
    ids = np.concatenate([i for _, i in found])
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=len(words))
    return ids[order], np.cumsum(counts) - counts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)


class _Scores:
    """Scores of distinct words for all labels, worked out once for each word in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.rows = np.empty((0, len(self.model.labels)), dtype="float32")
        self.letters = np.empty(0, dtype=bool)

    def places_of(self, flat: list[bytes]) -> np.ndarray:
        """Rows of ``rows`` and ``letters`` for these words; unseen ones are added."""
        if len(self.places) > REMEMBERED:
            self.clear()
        new = [w for w in dict.fromkeys(flat) if w not in self.places]
        rows, letters = [self.rows], [self.letters]
        for low in range(0, len(new), FEATURE_WORDS):
            decoded = [w.decode("utf-8", "replace") for w in new[low : low + FEATURE_WORDS]]
            ids, starts = word_features(decoded, self.model.lexicon)
            rows.append(np.add.reduceat(self.model.weights[ids], starts))
            letters.append(np.array([_has_letter(w) for w in decoded], dtype=bool))
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.rows, self.letters = np.concatenate(rows), np.concatenate(letters)
        return np.fromiter(map(self.places.__getitem__, flat), dtype=np.int64, count=len(flat))


def _unit(x: np.ndarray, axes: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Exact forward-backward over non-empty sequences laid end to end, all of them at once.

    Sequences are cut into pieces of PIECE words.  One pass multiplies up each
    piece's transfer matrix, one carries both messages across the pieces of a
    sequence, and one fills in the words; so the number of steps doesn't grow
    with the longest text.  Each position is normalised to stay in range.
    """
    k = scores.shape[1]
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(steps - steps.max()), np.exp(start - start.max())
    per = -(-lengths // PIECE)
    first_piece = np.cumsum(per) - per
    nth = np.arange(per.sum()) - np.repeat(first_piece, per)
    low = np.repeat(np.cumsum(lengths) - lengths, per) + nth * PIECE
    size = np.minimum(PIECE, np.repeat(lengths, per) - nth * PIECE)
    # Longest first: the pieces, or sequences, still running are a prefix.
    order = np.argsort(-size, kind="stable")
    at, sizes = low[order], size[order]
    running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    through = np.empty((len(order), k, k))
    through[:] = np.eye(k) * likely[at][:, None, :]
    for t in range(1, len(running)):
        n = running[t]
        through[:n] = _unit((through[:n] @ move) * likely[at[:n] + t][:, None, :], (1, 2))
    matrix = np.empty_like(through)
    matrix[order] = through
    into, out_of = np.empty((len(order), k)), np.ones((len(order), k))
    into[first_piece] = begin
    longest = np.argsort(-per, kind="stable")
    heads, counts = first_piece[longest], per[longest]
    going = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")
    for c in range(1, len(going)):
        p = heads[: going[c]] + c
        into[p] = _unit((into[p - 1][:, None, :] @ matrix[p - 1])[:, 0] @ move)
    for c in range(len(going) - 1, 0, -1):
        p = heads[: going[c]] + c
        out_of[p - 1] = _unit((matrix[p] @ out_of[p][:, :, None])[:, :, 0] @ move.T)
    forward, backward = np.empty_like(likely), np.empty_like(likely)
    into, out_of = into[order], out_of[order]
    for t in range(len(running)):
        i = at[: running[t]] + t
        forward[i] = _unit(likely[i] * (into[: running[t]] if t == 0 else forward[i - 1] @ move))
    backward[at + sizes - 1] = out_of
    for t in range(len(running) - 2, -1, -1):
        i = at[: running[t + 1]] + t
        backward[i] = _unit((likely[i + 1] * backward[i + 1]) @ move.T)
    return _unit(forward * backward)


def pair_marginals(scores: np.ndarray, start: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words, and summed ones of neighbouring labels, for sequences of one length (n, t, k)."""
    n, t, k = scores.shape
    likely = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps - steps.max())
    forward, backward = np.empty_like(likely), np.ones_like(likely)
    for i in range(t):
        a = likely[:, i] * (np.exp(start - start.max()) if i == 0 else forward[:, i - 1] @ move)
        forward[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (likely[:, i + 1] * backward[:, i + 1]) @ move.T
        backward[:, i] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        joint = forward[:, i - 1, :, None] * move * (likely[:, i] * backward[:, i])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both, pairs


def fit(rows: list[tuple[str, list[str]]], seed: int = 11) -> Model | None:
    """The CRF's weights by maximum likelihood (Adagrad over batches of switching sequences)."""
    rows = sorted({(lang, tuple(w)) for lang, w in rows if w})
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    by_label: list[list[tuple[str, ...]]] = [[] for _ in labels]
    for lang, w in rows:
        low = 0
        while low < len(w):
            size = int(rng.integers(*STRETCH))
            by_label[labels.index(lang)].append(w[low : low + size])
            low += size
    for own in by_label:
        rng.shuffle(own)
    # Stretches are dealt out by turns of a random label, so that sequences switch.
    flat_words, flat_labels = [], []
    left = [list(own) for own in by_label]
    while any(left):
        open_ = [j for j in range(k) if left[j]]
        j = open_[int(rng.integers(len(open_)))]
        for w in left[j].pop():
            flat_words.append(w)
            flat_labels.append(j)
    distinct = sorted(set(flat_words))
    lexicon = learned_lexicon(rows, labels)
    all_ids, starts = word_features(distinct, lexicon)
    features = dict(zip(distinct, np.split(all_ids, starts[1:]), strict=True))
    t = 48
    n = max(1, len(flat_words) // t)
    t = min(t, len(flat_words))
    gold = np.array(flat_labels[: n * t]).reshape(n, t)
    seqs = [flat_words[i * t : (i + 1) * t] for i in range(n)]
    model = Model(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    sums = {"w": np.full((BUCKETS, k), 1e-6), "s": np.full((k, k), 1e-6), "b": np.full(k, 1e-6)}
    eye = np.eye(k)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, 64):
            batch = order[low : low + 64]
            own = [features[w] for i in batch for w in seqs[i]]
            counts = np.array([len(f) for f in own])
            ids = np.concatenate(own)
            offsets = np.cumsum(counts) - counts
            scores = np.add.reduceat(model.weights[ids], offsets, axis=0).reshape(len(batch), t, k)
            both, pairs = pair_marginals(scores, model.start, model.steps)
            wrong = both - eye[gold[batch]]
            used, place = np.unique(ids, return_inverse=True)
            spread = np.repeat(wrong.reshape(-1, k), counts, axis=0)
            grad = np.stack([np.bincount(place, spread[:, j], len(used)) for j in range(k)], axis=1)
            grad = grad / len(batch) + 1e-5 * model.weights[used]
            sums["w"][used] += grad**2
            model.weights[used] -= 0.2 * grad / np.sqrt(sums["w"][used])
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[batch][:, :-1].ravel(), gold[batch][:, 1:].ravel()), 1)
            grad = (pairs - seen) / len(batch) + 1e-4 * model.steps
            sums["s"] += grad**2
            model.steps -= 0.1 * grad / np.sqrt(sums["s"])
            grad = wrong[:, 0].mean(axis=0)
            sums["b"] += grad**2
            model.start -= 0.1 * grad / np.sqrt(sums["b"])
    model.weights = model.weights.astype("float32")
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """SAMPLE_ROWS labelled rows by hash, SAMPLE_WORDS words of each from a hashed place on.

    The rows are counted first, so that a threshold on the hash leaves little
    more than the sample to be sorted, whatever the size of the table.
    """
    # By row, as ids may be null or repeat.
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("crf"), "doc_id", text_hash()), 1)
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", turn.alias("turn"))
    share = min(1.0, (1.2 * SAMPLE_ROWS + 100) / max(1, known.select("lang").count()))
    w = words(F.col("text"))
    spare = F.greatest(F.size("w") - SAMPLE_WORDS, F.lit(0)) + 1
    first = F.pmod(F.xxhash64("turn"), spare).cast("int") + 1
    rows = (
        known.where(F.col("turn") / F.lit(2.0**63) <= share)
        .select("lang", "turn", w.alias("w"))
        .where(F.size("w") > 0)
        .select("lang", "turn", F.slice("w", first, SAMPLE_WORDS).alias("w"))
        .orderBy("turn", "lang", "w")
        .limit(SAMPLE_ROWS)
    )
    return [(r["lang"], r["w"]) for r in rows.collect()]


def _label(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model)
        for _, ids, has, texts in cut(frames, LABEL_BYTES):
            split = [t.split() for t in texts]  # of bytes: ASCII white space alone
            lengths = np.array([len(ws) for ws in split], dtype=np.int64)
            at = scores.places_of([w for ws in split for w in ws])
            labels, values = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if len(at):
                table_, letters = scores.rows, scores.letters
                full = np.flatnonzero(lengths)
                m = marginals(table_[at].astype("float64"), lengths[full], model.start, model.steps)
                m = m * letters[at][:, None]
                firsts = np.cumsum(lengths[full]) - lengths[full]
                sums = np.add.reduceat(m, firsts, axis=0)
                counted = np.add.reduceat(letters[at].astype("float64"), firsts)
                best = sums.argmax(axis=1)
                for row, k in enumerate(full.tolist()):
                    if counted[row]:
                        labels[k] = model.labels[best[row]]
                        values[k] = min(1.0, sums[row, best[row]] / counted[row])
            yield pd.DataFrame(
                {"doc_id": pd.array([int(i) if h else None for i, h in zip(ids, has, strict=True)], dtype="Int64"),
                 "text_hash": np.array([hash_of(t) for t in texts], dtype=np.int64), "lang_pred": labels, "score": values}
            )

    return tidied(run)


def labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, lang_pred, score`` for each row's whole text."""
    model = fit(sample(docs))
    if model is None:
        return docs.select("doc_id", text_hash().alias("text_hash"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInPandas(_label(model), "doc_id long, text_hash long, lang_pred string, score double")


def _word_labels(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(model)
        names = np.array([*model.labels, None], dtype=object)
        for _, ids, has, texts in cut(frames, LABEL_BYTES):
            split = [t.split() for t in texts]
            lengths = np.array([len(ws) for ws in split], dtype=np.int64)
            at = scores.places_of([w for ws in split for w in ws])
            found = np.empty(0, dtype=object)
            if len(at):
                m = marginals(scores.rows[at].astype("float64"), lengths[lengths > 0], model.start, model.steps)
                found = names[np.where(scores.letters[at], m.argmax(axis=1), len(model.labels))]
            ends = np.cumsum(lengths)
            yield pd.DataFrame(
                {"doc_id": pd.array([int(i) if h else None for i, h in zip(ids, has, strict=True)], dtype="Int64"),
                 "labels": [found[b - n : b].tolist() for b, n in zip(ends, lengths, strict=True)]}
            )

    return run


def label_words(docs: DataFrame) -> DataFrame:
    """``doc_id, labels``: the language of every word of each row's whole text, null for words without letters.

    Without a labelled row to learn from there are no labels.
    """
    model = fit(sample(docs))
    if model is None:
        return docs.select("doc_id", F.array().cast("array<string>").alias("labels"))
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInPandas(_word_labels(model), "doc_id long, labels array<string>")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row's whole text."""
    return labelled(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told."""
    return drop_rows(docs, labelled(docs).where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_SCORE)))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_crf": _query}
ORACLES: dict[str, str] = {}
