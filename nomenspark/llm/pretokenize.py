"""Pre-tokens as the compiled tokenizer libraries cut them, and tables of distinct pre-tokens kept by a Python worker."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import regex


@lru_cache(maxsize=4)
def _newer(pattern: str) -> str:
    """Code points that the regex module already counts as letters or numbers and the compiled libraries, whose
    Unicode tables are older, do not. Found by asking the library's own pre-tokenizer about each candidate."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    named, letter = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\p{L}")
    out = []
    for c in map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)):
        if unicodedata.category(c) == "Cn" and named.match(c):
            if len(split.pre_tokenize_str(("a" if letter.match(c) else "1") + c)) > 1:
                out.append(c)
    return "".join(out)


def _latin(pattern: str) -> str:
    """The pattern for texts of code points below 256, its classes spelled out, in the syntax of re."""
    letters, numbers, spaces = ("".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    inside = {r"\s": spaces, r"\p{L}": letters, r"\p{N}": numbers}
    out, depth = [], 0
    for part in re.split(r"(\\s|\\S|\\p\{[LN]\}|\\.|[\[\]])", pattern):
        depth += (part == "[") - (part == "]")
        if part == r"\S":
            out.append(f"[^{spaces}]")
        else:
            out.append(part if part not in inside else inside[part] if depth else f"[{inside[part]}]")
    return "".join(out)


class Cutter:
    """Cuts texts by the pattern; the pieces joined give the text. Texts of code points below 256 go through re, which
    is faster; both ways give the same pieces."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer
        self.latin = re.compile(_latin(pattern)).findall
        self.newer = frozenset(_newer(pattern))
        #: U+0378 is unassigned in every table so far: neither letter, number nor space.
        self.plain = {ord(c): "\u0378" for c in self.newer}

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if not self.newer.isdisjoint(text):
                return [text[m.start() : m.end()] for m in self.iter(text.translate(self.plain))]
            return self.find(text)
        return self.latin(text)


class Words:
    """Distinct pre-tokens seen by this worker, numbered, with a ragged array of ids for each.

    encode(list of words) returns (flat ids, lengths). The table starts anew when it exceeds most words or four times as
    many ids, so its memory is bounded by that and one slice of text; results don't depend on what it holds. Words may be
    strings or bytes.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)  # a word that is looked up first is numbered
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lens = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _add(self, n: int, words: list[str]) -> None:
        flat, lens = self.encode(words)
        end = self.used + len(flat)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(end, len(self.flat)), np.int32)])
        if n + len(words) > len(self.starts):
            grow = max(n + len(words), len(self.starts))
            self.starts, self.lens = (np.concatenate([x[:n], np.empty(grow, np.int64)]) for x in (self.starts, self.lens))
        self.flat[self.used : end] = flat
        self.lens[n : n + len(words)] = lens
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.used = end

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, words of each text); new words are encoded."""
        if len(self.number) > self.most or self.used > 4 * self.most:
            self.clear()
        known = len(self.number)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if len(self.number) > known:
            try:
                self._add(known, list(islice(self.number, known, None)))
            except BaseException:
                self.clear()  # else numbers would stay without ids
                raise
        return at, counts

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, ids of each text)."""
        at, counts = self.numbers(texts)
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - lens), lens)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(bounds)
