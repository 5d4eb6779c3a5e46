"""Substring dedup: content-defined chunks with a gear rolling hash, and the exact bounds of repeated passages.

A text's words, joined by single spaces, are cut where the gear hash of the last 16 bytes has its top 5 bits clear, so that
a chunk holds about 32 bytes and its bounds depend on nearby bytes alone: after an insertion the same cuts come back. Chunks
are deduplicated by 64-bit digests: those that two or more rows hold are repeated.

Chunks say where to look. A window of min_words words that occurs twice has the same whole chunks in both places, so one that
holds a chunk that occurs once (and that lies far enough from the window's start to be cut alike everywhere) is out. Only
the others, some tenth of unshared text, are told by hashes of their own, which give the exact bounds: a word in a window that
other rows hold too is repeated, and runs of repeated words are the spans. So every shared passage of min_words words or more
is found, from its first word to its last, also if no chunk lies inside it. What a row repeats of itself is told apart.

Texts are dealt to slices by a hash of key, text and row number, so that repeated rows spread; a slice sends its distinct hashes, packed, to hash partitions, which answer it with a code
for each: first of the chunks, then of the windows that are left. A frequent one is one entry of a slice, so no key is hot.
Hashes have 64 bits: among 10^12 distinct windows some 30,000 are expected to meet another one's hash by chance.

Defined results: a null or empty text has no chunks; very long texts are cut whole; rows that share a doc_id are documents of
their own; equal documents repeat one another wholly; an empty table gives none; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_of
from .lm_scores import LEAST_SLICES, SLICE_BYTES, bounds, from_planes, loosen, pack, packed, planes, slice_of, squeeze, texts_of, unpack

WINDOW, MASK_BITS, LEAST, MOST = 16, 5, 12, 192
GEAR = np.random.default_rng(20260101).integers(0, 1 << WINDOW, 256, np.uint32).astype(np.uint16)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array. A cut within LEAST bytes after another is dropped, and stretches over MOST
    bytes are cut evenly from their start."""
    if not len(data):
        return np.empty(0, np.int64)
    h, k = GEAR[data], 1  # h[i] = sum of GEAR[data[i - j]] << j, in 16 bits: older bytes have left the register
    while k < WINDOW:
        older = np.zeros_like(h)
        older[k:] = h[:-k]
        h, k = h + (older << np.uint16(k)), 2 * k
    cuts = np.flatnonzero(h >> np.uint16(WINDOW - MASK_BITS) == 0) + 1
    if len(cuts):
        cuts = cuts[np.concatenate([[True], np.diff(cuts) > LEAST])]
    bounds = np.unique(np.concatenate([[0], cuts, [len(data)]]))
    gaps = np.diff(bounds)
    if (gaps > MOST).any():
        n = -(-gaps // MOST)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bounds = np.concatenate([np.repeat(bounds[:-1], n) + inner * MOST, bounds[-1:]])
    return bounds[1:]


STEP = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1  # null ids come last
SEVERAL = 4  # flag of a chunk that occurs more than once


class Slice:
    """The texts of one slice by doc_id: chunks, words and windows of k words, each with its row. Places are counted in
    the slice's texts, their words joined by single spaces."""

    def __init__(self, t: pa.Table, k: int):
        texts, ids = texts_of(t.column("text")), t.column("key").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.k = [ids[i] for i in order], k
        self.raw = [texts[i].encode() for i in order]
        self.words = [x.split() for x in self.raw]
        digests, heads, ends, firm, self.n_chunks, base = [], [], [], [], [], 0
        self.base = []  # place of each text
        for words in self.words:
            joined = b" ".join(words)
            to = cut_points(np.frombuffer(joined, np.uint8))
            head = np.concatenate([[0], to[:-1]])[: len(to)]
            digests.append(np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(head.tolist(), to.tolist(), strict=True)), np.uint64, len(to)))
            heads.append(base + head)
            ends.append(base + to)
            # neither the first nor the last, nor one of a stretch that was cut evenly: both ends are cuts by content
            inner = (head > 0) & (to < len(joined)) & (to - head < MOST)
            inner[1:] &= to[:-1] - head[:-1] < MOST
            firm.append(inner)
            self.n_chunks.append(len(to))
            self.base.append(base)
            base += len(joined) + 1
        self.heads, self.ends, self.firm = np.concatenate(heads), np.concatenate(ends), np.concatenate(firm)
        self.chunk_row = np.repeat(np.arange(len(self.raw)), self.n_chunks)
        self.chunks, _, self.chunk_where, rows = self.distinct(np.concatenate(digests), self.chunk_row)
        self.chunk_counts = rows + SEVERAL * (np.bincount(self.chunk_where, minlength=len(rows)) > 1)

    @staticmethod
    def distinct(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, first place and place of each, 1 or 2 rows that hold it, where 2 stands for more)"""
        every, first, where = np.unique(keys, return_index=True, return_inverse=True)
        last = np.zeros(len(every), np.int64)
        np.maximum.at(last, where, row)
        return every, first, where, 1 + (last > row[first])

    def look(self, codes: np.ndarray) -> None:
        """The windows that may be repeated. codes: of the distinct chunks; 1: other rows hold it, SEVERAL: it occurs
        more than once. Any other chunk rules out the windows that it lies in."""
        starts, stops = [], []
        for raw in self.raw:
            data = np.frombuffer(raw, np.uint8)
            word = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
            edge = np.flatnonzero(word[1:] != word[:-1])
            starts.append(edge[::2])
            stops.append(edge[1::2])
        codes = codes[self.chunk_where]
        self.shared = np.bincount(self.chunk_row, codes & 1, len(self.raw)).astype(np.int64)
        self.lens = np.array([len(x) for x in self.words], np.int64)
        self.starts, self.stops = np.concatenate(starts), np.concatenate(stops)
        row = np.repeat(np.arange(len(self.lens)), self.lens)
        left = np.repeat(np.cumsum(self.lens), self.lens) - np.arange(len(row))  # words to the text's end
        at = np.flatnonzero(left >= self.k)  # first words of windows
        size = self.stops - self.starts  # places of each word, joined by single spaces
        end = np.cumsum(size + 1) - 1
        single = (codes & SEVERAL == 0) & self.firm
        ends = np.append(self.ends[single], 1 << 62)
        inside = ends[np.searchsorted(self.heads[single], end[at] - size[at] + WINDOW + LEAST)] <= end[at + self.k - 1]
        self.at = at[~inside]
        self.window_row = row[self.at]
        flat = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, x), np.uint64, len(x)) for x in self.words])
        key, power = np.zeros(len(self.at), np.uint64), 1
        for j in range(self.k):
            key += flat[self.at + j] * np.uint64(power)
            power = power * int(STEP) % (1 << 64)
        windows, self.first, self.where, rows = self.distinct(key, self.window_row)
        rank = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.sent = (windows, rows, rank[self.window_row[self.first]])

    def spans(self, hit: np.ndarray, later: np.ndarray) -> list[list[dict]]:
        """Runs of the words of some windows, by row; later: of each of them, that it has occurred before."""
        at, row, out = self.at[hit], self.window_row[hit], [[] for _ in self.lens]
        new = np.flatnonzero((np.diff(at) > self.k) | (np.diff(row) > 0)) + 1
        for own in np.split(np.arange(len(at)), new) if len(at) else []:
            a, b = at[own[0]], at[own[-1]] + self.k
            out[row[own[0]]].append({"start": int(self.starts[a]), "end": int(self.stops[b - 1]), "words": int(b - a), "first": 2 * int(later[own].sum()) < len(own)})
        return out

    def found(self, codes: np.ndarray) -> tuple[list[list[dict]], ...]:
        """(spans, spans that the row itself holds before, spans that any row holds before) of each row. codes: of the
        windows that were sent; 1: repeated, 2: first of all here."""
        code = codes[self.where]
        hit = np.flatnonzero(code & 1)
        later = (code[hit] & 2 == 0) | (self.first[self.where[hit]] != hit)
        again = np.ones(len(self.where), bool)
        again[np.unique(self.where * np.int64(len(self.lens)) + self.window_row, return_index=True)[1]] = False
        within = np.flatnonzero(again)
        before = np.union1d(hit[later], within)
        return self.spans(hit, later), self.spans(within, again[within]), self.spans(before, np.ones(len(before), bool))


SPANS = "array<struct<start:int,end:int,words:int,first:boolean>>"


BLOCK_TYPE = "part long, slice long, keys binary, counts binary, ids binary"


def blocks(at: int, parts: int, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.Table:
    """part, slice and, packed, the slice's distinct hashes in that partition with their counts and first ids."""
    ends = np.concatenate([[0], np.searchsorted(keys, bounds(parts)), [len(keys)]])
    out = []
    for p in np.flatnonzero(np.diff(ends)).tolist():
        own = slice(ends[p], ends[p + 1])
        out.append((p, at, squeeze(pack(keys[own])), squeeze(counts[own].astype(np.uint8).tobytes()), planes(ids[own])))
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["part", "slice", "keys", "counts", "ids"])


def answers(sent: DataFrame, parts: int) -> DataFrame:
    """slice, part and the codes of the slice's hashes in that partition: 1 if two or more rows hold it, then 2 if its
    first row is here; SEVERAL if the row that holds it said so, or two or more do."""

    def run(t: pa.Table) -> pa.Table:
        slices_, part = t.column("slice").to_numpy(), t.column("part")[0].as_py()
        rows = np.argsort(slices_, kind="stable").tolist()
        keys = [unpack(loosen(t.column("keys")[r].as_py())) for r in rows]
        counts = np.concatenate([np.frombuffer(loosen(t.column("counts")[r].as_py()), np.uint8) for r in rows])
        ids = np.concatenate([from_planes(t.column("ids")[r].as_py()) for r in rows])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        again = np.bincount(where, counts & 3, len(every)) >= 2
        several = again | (np.bincount(where, counts & SEVERAL, len(every)) > 0)
        order = np.lexsort((np.arange(len(ids)), ids, where))  # by id, then slice
        first = np.zeros(len(ids), bool)
        first[order[np.concatenate([[True], np.diff(where[order]) > 0])]] = True
        codes = (again[where] * (1 + 2 * first) + SEVERAL * several[where]).astype(np.uint8)
        out = [squeeze(own.tobytes()) for own in np.split(codes, np.cumsum([len(x) for x in keys])[:-1])]
        return pa.table({"slice": pa.array(slices_[rows]), "part": pa.array([part] * len(rows), pa.int64()), "codes": pa.array(out, pa.binary())})

    # a partition is a task: neither depends on the session's number of shuffle partitions
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(run, "slice long, part long, codes binary")


def codes_of(t: pa.Table, n: int) -> np.ndarray:
    """The answers to one slice, in the order of its n hashes."""
    order = np.argsort(t.column("part").to_numpy())
    codes = np.frombuffer(b"".join(loosen(t.column("codes")[r].as_py()) for r in order.tolist()), np.uint8)
    if len(codes) != n:
        raise ValueError("a slice and its answers disagree")
    return codes


def repeated_spans(docs: DataFrame, scratch: Scratch, min_words: int = 25) -> DataFrame:
    """doc_id, n_chunks, n_shared_chunks (chunks that other rows hold too), spans, within and later of every row. spans:
    byte ranges of min_words words or more that other rows hold too; first: most of it occurs here for the first time, by
    doc_id. within: those that the row itself holds before. later: those that any row holds before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_SLICES, -(-size // SLICE_BYTES))
    dealt = packed(rows.withColumn("slice", slice_of(parts)), "bigint")
    sliced = dealt.repartition(parts, "slice")

    def chunks(t: pa.Table) -> pa.Table:
        own = Slice(t, min_words)
        return blocks(t.column("slice")[0].as_py(), parts, own.chunks, own.chunk_counts, np.zeros(len(own.chunks), np.int64))

    told = scratch.table(answers(sliced.groupBy("slice").applyInArrow(chunks, BLOCK_TYPE), parts), "chunks").select("slice", "part", "codes")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Slice(left, min_words)
        own.look(codes_of(right, len(own.chunks)))
        return blocks(left.column("slice")[0].as_py(), parts, *own.sent)

    both = sliced.groupBy("slice").cogroup(told.groupBy("slice"))
    back = answers(both.applyInArrow(windows, BLOCK_TYPE), parts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, chunk = Slice(left, min_words), pa.compute.equal(right.column("kind"), 0)
        own.look(codes_of(right.filter(chunk), len(own.chunks)))
        spans, within, later = own.found(codes_of(right.filter(pa.compute.invert(chunk)), len(own.sent[0])))
        of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first", pa.bool_())]))
        return pa.table({
            "doc_id": pa.array(own.ids, pa.int64()), "n_chunks": pa.array(own.n_chunks, pa.int64()), "n_shared_chunks": own.shared,
            "spans": pa.array(spans, of), "within": pa.array(within, of), "later": pa.array(later, of),
        })

    every = told.withColumn("kind", F.lit(0)).union(back.withColumn("kind", F.lit(1)))
    return sliced.groupBy("slice").cogroup(every.groupBy("slice")).applyInArrow(run, f"doc_id long, n_chunks long, n_shared_chunks long, spans {SPANS}, within {SPANS}, later {SPANS}")


def without_repeats(docs: DataFrame, scratch: Scratch, min_words: int = 25) -> DataFrame:
    """doc_id, text (null where it was) and n_removed (words) of every row: the texts without the passages of min_words
    words or more that occur before, in a row further up or in the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else cut_out(t, spans or []) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(texts, pa.string())], ["rid", "text"])

    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rows")
    found = repeated_spans(rows.select(F.col("rid").alias("doc_id"), "text"), scratch, min_words)
    spans = found.select(F.col("doc_id").alias("rid"), F.col("later").alias("spans")).where(F.size("spans") > 0)
    joined = rows.join(spans.hint("merge"), "rid", "left")
    new = joined.select("rid", "text", "spans").mapInArrow(run, "rid long, text string")
    return rows.select("rid", "doc_id", F.regexp_count(text_of(), F.lit(WORD)).alias("before")).join(new.hint("merge"), "rid").select(
        "doc_id", "text", (F.col("before") - F.regexp_count(text_of(), F.lit(WORD))).cast("long").alias("n_removed")
    )


def cut_out(text: str, spans: list[dict]) -> str:
    """The text without the byte ranges, which may overlap."""
    raw, out, at = text.encode(), [], 0
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if b > at:
            out.append(raw[at : max(a, at)])
            at = b
    return b"".join([*out, raw[at:]]).decode()
