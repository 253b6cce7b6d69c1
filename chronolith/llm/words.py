"""Splitting of texts into ASCII-blank-separated words, and whole-word token caches."""

from __future__ import annotations

import itertools
import re

import numpy as np


#: A letter or digit, then punctuation up to the word's end: the two are always tokens apart.
_TAIL = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|\Z)")
#: Words of ASCII and Latin-1 letters alone: normal forms of themselves but for case.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenCache(dict):
    """word (UTF-8 bytes) -> row of a table of token ids.

    Valid for tokenizers that fold case, drop white space, never join across it, and part letters from
    punctuation: a text's ids are then those of its words in turn.  New words of plain letters go to the
    tokenizer's model directly, all others through the whole tokenizer.  The table is emptied when it holds
    ``most`` words, so memory stays bounded.  Literal markers of the vocabulary are one id each, as the library reads
    them: they part a text, whatever their neighbours."""

    def __init__(self, tokenizer, most: int = 400_000) -> None:
        super().__init__()
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        # a byte that UTF-8 never has starts the word that stands for a marker
        self.markers = [(t.content.encode(), b"\xfe%d" % i, number) for i, (number, t) in enumerate(sorted(tokenizer.get_added_tokens_decoder().items())) if t.special]
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self[b"\xff"] = 0
        self.new: list[bytes] = []
        n = len(self.markers)
        for i, (_, word, _) in enumerate(self.markers):
            self[word] = 1 + i
        self.starts, self.sizes = np.array([0, *range(n)], np.int64), np.array([0, *[1] * n], np.int64)
        self.flat = np.array([number for *_, number in self.markers], np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        rest: list[int] = []
        for i, word in enumerate(words):
            if _PLAIN.fullmatch(word):
                letters = (word if word.isascii() else word.decode().lower().encode()).decode("latin-1").translate(self.letters)
                out.append([x.id for x in self.model.tokenize(letters)])
            else:
                out.append([])
                rest.append(i)
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
                out[i] = x.ids
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.most:
            self._reset()
        # one pass over all texts: a byte that UTF-8 never has stands between them, with no ids of its own
        joined = b" \xff ".join([t.encode() for t in texts])
        for literal, word, _ in self.markers:
            if literal in joined:
                joined = joined.replace(literal, b" " + word + b" ")
        joined = joined.lower()
        words = _TAIL.sub(rb" \1", joined).split()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            got = self._encode(self.new)
            sizes = np.array([len(x) for x in got], np.int64)
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum()))])
            self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, starts])
            self.new = []
        sizes = self.sizes[rows]
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        flat = self.flat[np.arange(total) + np.repeat(self.starts[rows] - before, sizes)]
        return np.split(flat, before[rows == 0])[: len(texts)] if texts else []
