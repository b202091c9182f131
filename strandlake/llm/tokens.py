"""Token ids of whole texts, piece by piece.

Both tokenizers cut a text into pieces (words, digits, signs) and encode each piece by itself. A piece is encoded by the
tokenizer once and then looked up, as most pieces of a text are common. The pieces are cut here for texts of letters,
digits and signs whose classes are beyond doubt; any other text is encoded as a whole by the tokenizer.

Defined results: an empty text has no ids; a text of any length is encoded whole (it is held in memory, and so are its
ids); repeated texts are encoded alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np

from .common import KEPT

#: Letters beyond ASCII that are one code point in every normal form and have a lower case of one code point.
LETTERS = "À-ÖØ-öø-įı-ňŊ-ž"
SIGNS = "¡«»¿–—‘-”…€"
SPACES = "\t\n\r "
#: A text that has a piece with anything else, or with what may be a special token, is encoded as a whole.
ODD = re.compile(rf"[^\t\n\r -~{LETTERS}{SIGNS}]|<\|")
SHORT = "'(?:[stmd]|re|ve|ll)"
#: The pieces of word_bpe_49k, after lower-casing, and of byte_bpe_50k. White space that isn't in SPACES is a sign here, and so odd.
WORDS = re.compile(rf"[a-z{LETTERS}]++|{SHORT}|[0-9]|[^{SPACES}a-z{LETTERS}0-9]++")
BYTES = re.compile(rf" ?[A-Za-z{LETTERS}]++|{SHORT}| ?[0-9]++| ?[^{SPACES}A-Za-z{LETTERS}0-9]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Numbers(dict):
    """A number for each key, in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """ids of texts. keeps_space: whether white space makes tokens. cached, chars: pieces kept, and their characters, above
    which those that came only once since the last time are let go (and of the others the rarer ones beyond a half)."""

    def __init__(self, path: str, keeps_space: bool, cached: int = 500_000, chars: int = 20_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = BYTES.findall if keeps_space else lambda t: WORDS.findall(t.lower())
        self.cached, self.most_chars, self.chars = cached, chars, 0
        self.at = Numbers()
        self.ids, self.length, self.seen, self.odd = (np.zeros(0, x) for x in (np.uint32, np.int64, np.int64, bool))
        self.begin = self.length

    def _let_go(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.cached // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: self.cached // 2]])
        words = list(self.at)
        self.at = Numbers((words[k], n) for n, k in enumerate(keep.tolist()))
        self.ids = self.ids[_ranges(self.begin[keep], self.length[keep])]
        self.length, self.seen, self.odd = self.length[keep], np.zeros(len(keep), np.int64), self.odd[keep]
        self.begin = np.cumsum(self.length) - self.length
        self.chars = sum(map(len, self.at))
        if self.chars > self.most_chars // 2:  # very long pieces
            self.at, self.chars = Numbers(), 0
            self.ids, self.length, self.begin, self.seen, self.odd = (x[:0] for x in (self.ids, self.length, self.begin, self.seen, self.odd))

    def _learn(self) -> None:
        """Encode the pieces that were numbered since the last time; odd ones have no ids."""
        n = len(self.length)
        new = list(islice(reversed(self.at), len(self.at) - n))[::-1]
        odd = np.fromiter((ODD.search(w) is not None for w in new), bool, len(new))
        found = self.tokenizer.encode(["" if x else w for w, x in zip(new, odd, strict=True)], is_pretokenized=True, add_special_tokens=False)
        length = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])
        self.length, self.odd = np.concatenate([self.length, length]), np.concatenate([self.odd, odd])
        self.begin = np.cumsum(self.length) - self.length
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.chars += sum(map(len, new))

    def __call__(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many are each text's. end_id, if given, follows each text."""
        if len(self.at) > self.cached or self.chars > self.most_chars:
            self._let_go()
        words = [self.split(t) for t in texts]
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = int(stops[-1]) if len(texts) else 0
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, n)
        if len(self.at) > len(self.length):
            self._learn()
        self.seen += np.bincount(at, minlength=len(self.seen))
        lengths = self.length[at]
        ids = self.ids[_ranges(self.begin[at], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[stops]
        parts = np.split(ids, upto[:-1]) if len(texts) else []
        for k in set(np.searchsorted(stops, np.flatnonzero(self.odd[at]), "right").tolist()):
            parts[k] = np.asarray(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + len(tail)
        return np.concatenate([x for part in parts for x in (part, tail)] or [tail[:0]]), sizes


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... to length numbers, for each row."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    name = f"encoder {path} {keeps_space}"
    if name not in KEPT:
        KEPT.clear()
        KEPT[name] = Encoder(path, keeps_space)
    return KEPT[name]


def in_turn(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about size characters, each with the place of its first."""
    first = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield first, texts[first : k + 1]
            first, chars = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]
