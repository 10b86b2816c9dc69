"""Texts in words that a tokenizer reads apart without changing a token.

A word ends before a single space between two characters that are no white
space (nor U+2581).  No token crosses such a place where words take their space along
(byte-level BPE: the pattern starts a new match at the space), where white space
is dropped, or where no entry of the vocabulary has a space after another
character.  So each distinct word is encoded once however often it occurs, and a
very long text needs no more memory than its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from lectern.llm import blocks as B

#: U+2581 is a space to the sentencepiece model.
_BREAK = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")

#: Characters that are handed to a tokenizer in one call; bounds the objects it returns.
CALL_CHARS = 256_000


def words(text: str) -> list[str]:
    """``text`` cut at such spaces, which are left out; an empty text is one empty word."""
    return _BREAK.split(text)


class Words:
    """Texts as places in the list of their distinct words."""

    def __init__(self, texts: list[str], cut: Callable[[str], list[str]] = words) -> None:
        seen, counts, flat = B.Places(), [], [np.empty(0, dtype=np.int64)]
        for t in texts:
            own = cut(t)
            counts.append(len(own))
            flat.append(np.fromiter(map(seen.__getitem__, own), dtype=np.int64, count=len(own)))
        self.distinct = list(seen)
        self.places = np.concatenate(flat)
        #: Words before each text, and of all.
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each distinct word over each text's words."""
        return np.diff(np.concatenate([[0], np.cumsum(values[self.places])])[self.starts])

    def calls(self) -> Iterator[list[str]]:
        """Distinct words in lists of bounded size."""
        low, size = 0, 0
        for k, word in enumerate(self.distinct):
            if k > low and size + len(word) > CALL_CHARS:
                yield self.distinct[low:k]
                low, size = k, 0
            size += len(word) + 1
        if low < len(self.distinct):
            yield self.distinct[low:]


class Ragged:
    """Lists of numbers as one array and their places in it."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.fromiter((x for own in lists for x in own), dtype=np.int64, count=int(self.lens.sum()))

    def of(self, at: np.ndarray) -> np.ndarray:
        """The lists ``at``, one after the other."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def tokenizer(data: bytes, plain_specials: bool):
    """A ``tokenizers`` tokenizer from its file; with ``plain_specials``, special strings in texts are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(data)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = plain_specials
    return made


@lru_cache(maxsize=4)
def sentences(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


@lru_cache(maxsize=4)
def sentence_pieces(data: bytes) -> list[str]:
    model = sentences(data)
    return [model.id_to_piece(k) for k in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def spaces_lead(data: bytes) -> bool:
    """Whether no piece of a sentencepiece vocabulary has a space after another character."""
    return all("▁" not in piece.lstrip("▁") for piece in sentence_pieces(data))
