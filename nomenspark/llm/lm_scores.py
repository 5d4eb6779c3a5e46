"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

The relations are: count tables of n-grams, partitioned by hash; the n-grams of the documents, exploded; their join; and
sums per document. They are held in blocks, so that a shuffled row carries many n-grams: documents are dealt to slices of
some 8 MB by a hash of key, text and row number (so that repeated rows spread), a slice sends its distinct n-grams with
their counts to the hash partitions, each partition adds up what all slices sent and answers every slice with the totals,
in the order of its n-grams, and the slice, whose texts lie where they lay, joins the answers to its tokens. A frequent
word is one entry of a slice, so no key is hot.

Counts leave out the document that is scored. The score of a word after a context is its count by the context's, else 0.4
times the score after the context without its first word; a single word has its count by the number of words, and one
that no other document holds counts as one.

Texts, keys, counts and totals are exchanged as zstd blocks, which is most of what lets trigrams through: keys are 64-bit
hashes at every length, so nothing is rounded or dropped.

A slice and a hash partition fit a task; their number grows with the corpus. Nothing but two totals reaches the driver.

Defined results: words are lower-cased within ASCII; a null or empty text, or one without words, has 0 words, score 0 and
no mean; very long texts are scored whole; repeated rows are documents of their own; an empty table gives none; other
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of
from .minhash import LOWER, grouped, mix

SLICE_BYTES, LEAST_SLICES, BACKOFF = 8 << 20, 32, 0.4
CODEC = pa.Codec("zstd", 3)
STEP = np.uint64(0x9E3779B97F4A7C15)


def squeeze(data: bytes) -> bytes:
    """A zstd block after its length."""
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def loosen(data: bytes) -> bytes:
    return CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts, plain or as blocks."""
    return [loosen(x).decode() if isinstance(x, bytes) else x for x in column.to_pylist()]


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte planes apart, as a block."""
    return squeeze(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(loosen(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text)"""
    flat, lens = [], []
    for t in texts:  # the words of one text at a time
        words = t.encode().translate(LOWER).split()
        flat.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        lens.append(len(words))
    return (np.concatenate(flat) if flat else np.empty(0, np.uint64)), np.array(lens, np.int64)


def grams(flat: np.ndarray, lens: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to order; of those that cross a text's start only the
    place is kept, with key 0."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = [mix(flat) | np.uint64(1)]
    for n in range(2, order + 1):
        key = np.zeros_like(flat)
        key[1:] = mix(out[-1][:-1] * STEP + out[0][1:]) | np.uint64(1)
        key[place < n - 1] = 0
        out.append(key)
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, which compresses."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def bounds(parts: int) -> np.ndarray:
    """First keys of the hash partitions but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def distinct_grams(sliced: DataFrame, order: int, parts: int) -> DataFrame:
    """part, slice, n, keys and counts of each slice's distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, cuts = None, bounds(parts)

        def done() -> Iterator[pa.RecordBatch]:
            flat, lens = (np.concatenate(x) for x in zip(*held, strict=True))
            for n, keys in enumerate(grams(flat, lens, order), 1):
                keys, counts = np.unique(keys, return_counts=True)
                keys, counts = (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)
                ends = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some, pa.int64()), "slice": pa.array([at] * len(some), pa.int64()), "n": pa.array([n] * len(some), pa.int32()),
                    "keys": pa.array([squeeze(pack(keys[ends[p] : ends[p + 1]])) for p in some], pa.binary()),
                    "counts": pa.array([planes(counts[ends[p] : ends[p + 1]]) for p in some], pa.binary()),
                })

        for batch in batches:
            for t, group in grouped(iter([batch]), ["slice"]):
                for g in range(int(group[-1]) + 1):
                    own = t.filter(pa.array(group == g))
                    if at is not None and own.column("slice")[0].as_py() != at:
                        yield from done()
                        held = []
                    at = own.column("slice")[0].as_py()
                    held.append(tokens(texts_of(own.column("text"))))
        if held:
            yield from done()

    return sliced.sortWithinPartitions("slice").mapInArrow(run, "part long, slice long, n int, keys binary, counts binary")


def merged(t: pa.Table) -> Iterator[tuple[int, list[int], list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per n of one hash partition: n, its rows, their keys, all distinct keys and their totals."""
    n = t.column("n").to_numpy()
    for k in np.unique(n).tolist():
        rows = np.flatnonzero(n == k).tolist()
        keys = [unpack(loosen(t.column("keys")[r].as_py())) for r in rows]
        counts = np.concatenate([from_planes(t.column("counts")[r].as_py()) for r in rows])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, where, counts)
        yield k, rows, keys, every, total


def answers(blocks: DataFrame, parts: int) -> DataFrame:
    """slice, n, part and the corpus's counts of the slice's n-grams in that partition."""

    def run(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {"slice": [], "n": [], "part": [], "totals": []}
        slices_, part = t.column("slice").to_pylist(), t.column("part")[0].as_py()
        for n, rows, keys, every, total in merged(t):
            for r, own in zip(rows, keys, strict=True):
                out["slice"].append(slices_[r])
                out["n"].append(n)
                out["part"].append(part)
                out["totals"].append(planes(total[np.searchsorted(every, own)]))
        return pa.table({"slice": pa.array(out["slice"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "part": pa.array(out["part"], pa.int64()), "totals": pa.array(out["totals"], pa.binary())})

    # a partition is a task: none depends on the session's number of shuffle partitions
    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(run, "slice long, n int, part long, totals binary")


def count_table(blocks: DataFrame) -> DataFrame:
    """part, n, key (hash) and total: the n-gram counts themselves."""

    def run(t: pa.Table) -> pa.Table:
        part, out = t.column("part")[0].as_py(), []
        for n, _, _, every, total in merged(t):
            out.append(pa.table({"part": pa.array(np.full(len(every), part)), "n": pa.array(np.full(len(every), n, np.int32)), "key": pa.array(every.view(np.int64)), "total": pa.array(total)}))
        return pa.concat_tables(out)

    return blocks.groupBy("part").applyInArrow(run, "part long, n int, key long, total long")


def backoff(keys: list[np.ndarray], totals: list[np.ndarray], doc: np.ndarray, lens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(natural log of each token's score, length of the n-gram that it was taken from). totals: corpus counts of the
    distinct keys other than 0 of each n, in order."""
    left = []  # the corpus's counts without the token's own document
    for own, total in zip(keys, totals, strict=True):
        distinct, at = np.unique(own, return_inverse=True)
        if len(distinct) and distinct[0] == 0:
            total = np.concatenate([[0], total])
        if len(total) != len(distinct):
            raise ValueError("a slice and its answers disagree")
        pair, where, here = np.unique(doc * np.int64(len(distinct)) + at, return_inverse=True, return_counts=True)
        left.append(np.where(own == 0, 0, total[at] - here[where]))
    rest = np.maximum(words - np.repeat(lens, lens), 1)
    score, used = np.maximum(left[0], 1) / rest, np.where(left[0] > 0, 1, 0)
    for n in range(2, len(keys) + 1):
        context = np.zeros(len(doc), np.int64)
        context[1:] = left[n - 2][:-1]
        seen = left[n - 1] > 0  # then the context is seen as well
        longer = keys[n - 1] != 0
        score = np.where(longer, np.where(seen, left[n - 1] / np.maximum(context, 1), BACKOFF * score), score)
        used = np.where(seen, n, used)
    return np.log(score), used


def slice_of(parts: int) -> Column:
    """The slice of a row of key and text. Repeated rows spread over all slices by their row numbers."""
    return F.pmod(F.xxhash64("key", "text", F.monotonically_increasing_id()), F.lit(parts)).cast("long")


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """The rows with their texts as blocks. kind: the key's type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = pa.array([squeeze(x.as_py().encode()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), blocks, batch.column("slice")], ["key", "text", "slice"])

    return rows.select("key", "text", "slice").mapInArrow(run, f"key {kind}, text binary, slice long")


def score(docs: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_top (words scored by an n-gram of full order), log_score (sum of natural logs) and mean_log of
    every row. order is the longest n-gram's length."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    size, words = rows.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    parts = max(LEAST_SLICES, -(-(size or 0) // SLICE_BYTES))
    words = words or 0
    sliced = rows.withColumn("slice", slice_of(parts))
    kind = rows.schema["key"].dataType.simpleString()
    sliced = packed(sliced, kind).repartition(parts, "slice")
    back = answers(distinct_grams(sliced, order, parts), parts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("key").combine_chunks()
        flat, lens = tokens(texts_of(left.column("text")))
        if not len(flat):
            zero = np.zeros(len(lens), np.int64)
            return pa.table({"key": own, "n_words": zero, "n_top": zero, "log_score": zero.astype(float)})
        order_ = np.lexsort((right.column("part").to_numpy(), right.column("n").to_numpy()))
        n = right.column("n").to_numpy()[order_]
        blocks = right.column("totals").to_pylist()
        got = [from_planes(blocks[r]) for r in order_]
        totals = [np.concatenate([np.empty(0, np.int64), *(g for g, m in zip(got, n, strict=True) if m == k)]) for k in range(1, order + 1)]
        doc = np.repeat(np.arange(len(lens)), lens)
        log, used = backoff(grams(flat, lens, order), totals, doc, lens, words)
        top = np.bincount(doc, used == order, len(lens)).astype(np.int64)
        return pa.table({"key": own, "n_words": lens, "n_top": top, "log_score": np.bincount(doc, log, len(lens))})

    scored = sliced.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(run, f"key {kind}, n_words long, n_top long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("key").alias(key), "n_words", "n_top", "log_score", mean.alias("mean_log"))
