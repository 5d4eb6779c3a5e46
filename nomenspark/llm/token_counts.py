"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch of distinct pre-tokens is one flat array of symbols with an owner for each. A round looks up the rank of every
adjacent pair, takes each sequence's lowest, and merges all of its occurrences that don't overlap, in every sequence at
once. Sequences with no pair left leave the batch; the symbols that survive are their counts. A merge with the new
symbol has a higher rank than the symbol, so merging all occurrences of a rank at once gives what one by one would.
Time is linear in a text's length in any script: long words are cut and merged in overlapping windows (windows.py).

No shuffle; memory is bounded by the slice of text and the worker's table of distinct pre-tokens.

Defined results: a null or empty text counts 0 tokens and 0 bytes; added special tokens inside a text are taken as the
library's default takes them (one token each, longest match first); repeated rows each get their row; an empty table
gives none; other columns are passed by.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .pretokenize import Cutter, Words
from .windows import Pieces

#: What the ByteLevel pre-tokenizer of the .json format splits by when use_regex is set. A fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 60


def byte_symbols() -> list[str]:
    """The printable character that the format writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = not any(model.get(k) for k in options) and not spec["normalizer"] and not spec["truncation"] and not spec["padding"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain:
            raise ValueError(f"{path}: only plain byte-level BPE is counted here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not counted here")
        vocab = model["vocab"]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.pattern = BYTE_LEVEL if pre.get("use_regex", True) else r"(?s).+"
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.pieces = Pieces(((bytes(byte_of[c] for c in x), i) for x, i in vocab.items() if all(c in byte_of for c in x)), self.survivors, lambda x: self.survivors([x])[0])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def survivors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat symbols, symbols of each) left of non-empty words when no pair can be merged."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), lens)
        out, left = np.zeros(len(words), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(sym):
            rank = np.full(len(sym), NONE)
            inner = own[1:] == own[:-1]
            rank[:-1][inner] = self.rank(sym[:-1][inner], sym[1:][inner])
            starts = np.flatnonzero(np.concatenate([[True], ~inner]))
            size = np.diff(np.concatenate([starts, [len(sym)]]))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            out[own[starts[done]]] = size[done]
            gone = np.repeat(done, size)
            left.append((own[gone], sym[gone]))
            hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank != NONE))
            if len(hit):  # hits next to each other overlap: every other one of such a run counts
                first = np.concatenate([[True], np.diff(hit) > 1])
                run = np.flatnonzero(first)
                hit = hit[(np.arange(len(hit)) - run[np.cumsum(first) - 1]) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = ~gone
            keep[hit + 1] = False
            sym, own = sym[keep], own[keep]
        of, flat = (np.concatenate(x) for x in zip(*left, strict=True))
        return flat[np.argsort(of, kind="stable")], out

    def count(self, words: list[str], batch: int = 1 << 20) -> np.ndarray:
        """Symbols left of each non-empty word, over batches of about so many bytes."""
        coded = [w.encode() for w in words]
        cut = np.cumsum([len(x) for x in coded]) // batch if coded else np.empty(0)
        bounds = [*np.flatnonzero(np.diff(cut, prepend=-1)), len(coded)]
        return np.concatenate([np.empty(0, np.int64), *(self.pieces.encode(coded[a:b])[1] for a, b in zip(bounds[:-1], bounds[1:], strict=True))])


@lru_cache(maxsize=2)
def _worker(path: str):
    merges = Merges(path)
    words = Words(lambda new: ((n := merges.count(new)).astype(np.int32), np.ones(len(n), np.int64)))
    special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
    return Cutter(merges.pattern), words, special


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, words, special = _worker(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts, found = part.column("text").to_pylist(), np.zeros(part.num_rows, np.int64)
                pieces = []
                for i, t in enumerate(texts):
                    if special and special.search(t):
                        between = special.split(t)
                        found[i] = len(between) - 1
                        pieces.append([w for x in between for w in cut(x)])
                    else:
                        pieces.append(cut(t))
                counts, lens = words.ids(pieces)
                total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                ends = np.cumsum(lens)
                n = total[ends] - total[ends - lens] + found
                size = pa.compute.binary_length(part.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "n_bytes": size, "n_tokens": pa.array(n)})

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
