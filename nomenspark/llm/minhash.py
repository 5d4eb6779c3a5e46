"""Near-duplicate documents by b-bit MinHash.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets form a class.
2. Each class has 120 minima: 24 bands of 5 give the buckets in which candidates meet, and the low 4 bits of each
   minimum are packed into a 60-byte signature. The share of equal 4-bit lanes, corrected for chance equality, is the
   estimate of the similarity.
3. Inside a bucket, cut into blocks, pairs whose estimate allows the threshold make a graph, of which each block gives
   a spanning forest; buckets of several blocks that still hold different components are compared over all pairs of
   blocks. The components are clusters: no link leaves one.
4. The full sets of each cluster meet once. Clusters up to a block are compared pair by pair there. Larger ones first
   in a few random dealings of blocks, of which each gives a spanning forest of confirmed links, then, if they still hold
   different components, over all pairs of blocks. A pair inside one component can't change it, so nothing is lost.
5. Components of classes are spread over the documents.

Copies with equal sets are one class, and no step writes down the pairs of a group: blocks give forests. What a task holds
is two blocks of signatures or sets; nothing but counts reaches the driver. Texts are joined to the clustered rows by
shuffle, never by broadcast. Every step is a table in the shared folder. At a similarity of exactly 0.8, 24 bands of 5
miss a pair with probability 7e-5, and the estimate's margin another 3e-5; both fall fast above it.

Defined results: every row is a document of its own, also where rows share a doc_id or have none, so the verdict of one
text never falls on another. A component has the smallest doc_id that its rows have, null if they have none, and one row
that is its first: that of the smallest doc_id, of equal ones (repeated rows) the first in the table. A null or empty
text, or one without words, has the empty set and links with nothing; fewer words than the shingle length make one
shingle; very long texts are taken whole; an empty table gives none; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, text_of
from .components import components

BANDS, ROWS, BLOCK, DEALINGS = 24, 5, 256, 3
HASHES = BANDS * ROWS
#: Below the threshold by so much, an estimate still makes a candidate: 4 standard deviations.
MARGIN = 0.15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_draw = np.random.default_rng(20260101)
MULTIPLY = _draw.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
ADD = _draw.integers(0, 1 << 64, HASHES, np.uint64)
PLACE = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
EQUAL_LANES = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total + h[i : len(h) - k + 1 + i] * PLACE[i])
    return np.unique(total)


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, signatures) of non-empty sets."""
    minima = np.empty((len(sets), HASHES), np.uint64)
    at = 0
    while at < len(sets):  # some 100,000 hashes at a time stay in the processor's cache
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 100_000):
            n, to = n + len(sets[to]), to + 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        work = np.empty_like(flat)
        for i in range(HASHES):
            np.multiply(flat, MULTIPLY[i], out=work)
            np.add(work, ADD[i], out=work)
            minima[at:to, i] = np.minimum.reduceat(work, starts)
        at = to
    minima >>= np.uint64(32)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
    for i in range(ROWS):
        keys = mix(keys * PLACE[i] + minima[:, i::ROWS])
    low = (minima & np.uint64(15)).astype(np.uint8)
    return keys.view(np.int64), low[:, 0::2] | low[:, 1::2] << 4


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row, corrected for lanes that are equal by chance."""
    same = EQUAL_LANES[a ^ b].sum(axis=1, dtype=np.int64) / HASHES
    return (same - 1 / 16) / (1 - 1 / 16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """rid, doc_id, n_shingles, digest, and for non-empty sets bands and signature, of every row of rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [shingle_set(t, k) for t in part.column("text").to_pylist()]
                some = np.array([len(s) > 0 for s in sets], bool)
                keys, packed = sketch([s for s in sets if len(s)]) if some.any() else (np.empty((0, BANDS), np.int64), np.empty((0, HASHES // 2), np.uint8))
                row = np.full(len(sets), -1)
                row[some] = np.arange(some.sum())
                yield pa.RecordBatch.from_pydict({
                    "rid": part.column("rid"), "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "bands": pa.array([keys[r].tolist() if r >= 0 else None for r in row], pa.list_(pa.int64())),
                    "signature": pa.array([packed[r].tobytes() if r >= 0 else None for r in row], pa.binary()),
                })

    return docs.mapInArrow(run, "rid long, doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that are sorted by keys, with the number of each row's group in its table."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return new

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        last = int(np.flatnonzero(bounds(t))[-1])
        if last:
            head = t.slice(0, last).combine_chunks()
            yield head, np.cumsum(bounds(head)) - 1
        held = t.slice(last)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, np.cumsum(bounds(held)) - 1


def pairs_within(group: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i < j of all pairs of rows in one group, where group is sorted; about most pairs at a time, cut
    between first rows, so that the pairs of one i come together."""
    n = len(group)
    ends = np.searchsorted(group, group, side="right")
    each = ends - np.arange(n) - 1
    total = np.cumsum(each)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        own = each[at:to]
        if m := int(own.sum()):
            i = np.repeat(np.arange(at, to), own)
            yield i, i + 1 + np.arange(m) - np.repeat(np.cumsum(own) - own, own)
        at = to


class Forest:
    """Union-find over labels; add() says whether it joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(i: np.ndarray, j: np.ndarray, comp: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the pairs, sorted by group, make a spanning forest of each group's components."""
    keep, at, forest = np.zeros(len(i), bool), -1, Forest()
    for n, (a, b, g) in enumerate(zip(comp[i].tolist(), comp[j].tolist(), group[i].tolist(), strict=True)):
        if g != at:
            at, forest = g, Forest()
        keep[n] = forest.add(a, b)
    return keep


def candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest (a, b) of the classes in each key and pair of blocks whose estimates allow the threshold.

    entries: key, b1, b2, cid, block, comp, n, signature; a pair of one component is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["key", "b1", "b2"]):
            col = {c: t.column(c).to_numpy() for c in ("cid", "block", "comp", "n", "b1", "b2")}
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            across, found = col["b1"] != col["b2"], []
            for i, j in pairs_within(group):
                ok = (col["comp"][i] != col["comp"][j]) & (~across[i] | (col["block"][i] != col["block"][j]))
                small, large = np.minimum(col["n"][i], col["n"][j]), np.maximum(col["n"][i], col["n"][j])
                ok &= small >= threshold * large - 1e-9
                i, j = i[ok], j[ok]
                ok = estimate(sig[i], sig[j]) >= threshold - MARGIN
                found.append((i[ok], j[ok]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                ok = spanning(i, j, col["comp"], group)
                yield pa.RecordBatch.from_pydict({"a": pa.array(col["cid"][i[ok]]), "b": pa.array(col["cid"][j[ok]])})

    cols = ("key", "b1", "b2", "cid", "block", "comp", "n", "signature")
    dealt = entries.select(*cols).repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of 0/1 matrices over the shared elements."""
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    held = np.cumsum(new) - 1
    shared = np.bincount(held)[held] > 1
    own, held = own[shared], held[shared]
    out = np.zeros((len(sets), len(sets)), np.float64)
    if len(held):
        place = np.cumsum(np.concatenate([[False], held[1:] != held[:-1]]))
        for at in range(0, int(place[-1]) + 1, columns):
            lo, hi = np.searchsorted(place, [at, at + columns])
            one = np.zeros((len(sets), min(columns, int(place[-1]) + 1 - at)), np.float32)
            one[own[lo:hi], place[lo:hi] - at] = 1
            out += one @ one.T
    return out.astype(np.int64)


def confirm(entries: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links in each cluster and pair of blocks, confirmed on the full sets.

    entries: cluster, b1, b2, cid, block, comp, shingles; a pair of one component is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["cluster", "b1", "b2"]):
            col = {c: t.column(c).to_numpy() for c in ("cid", "block", "comp", "b1", "b2")}
            lists = t.column("shingles").combine_chunks()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            size = np.diff(ends).astype(np.int64)
            bounds = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2 or (col["comp"][lo:hi] == col["comp"][lo]).all():
                    continue
                both = intersections(sets[lo:hi])
                link = 100 * both >= percent * (size[lo:hi, None] + size[None, lo:hi] - both)
                i, j = np.nonzero(np.triu(link, 1))
                i, j = i + lo, j + lo
                ok = col["comp"][i] != col["comp"][j]
                if col["b1"][lo] != col["b2"][lo]:
                    ok &= col["block"][i] != col["block"][j]
                i, j = i[ok], j[ok]
                ok = spanning(i, j, col["comp"], group)
                yield pa.RecordBatch.from_pydict({"a": pa.array(col["cid"][i[ok]]), "b": pa.array(col["cid"][j[ok]])})

    cols = ("cluster", "b1", "b2", "cid", "block", "comp", "shingles")
    dealt = entries.select(*cols).repartition("cluster", "b1", "b2").sortWithinPartitions("cluster", "b1", "b2")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def alone(rows: DataFrame) -> DataFrame:
    """Each block by itself."""
    return rows.withColumns({"b1": F.col("block"), "b2": F.col("block")})


def all_blocks(rows: DataFrame) -> DataFrame:
    """Each pair of blocks together: a row goes to as many groups as there are blocks."""
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), block_count() - 1)))
    return spread.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})


def block_count():
    return F.ceil(F.col("size") / BLOCK).cast("long")


def blocked(rows: DataFrame, *salt: str) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("cid", *salt), block_count()))


def with_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with comp: the class's root, itself if it has none."""
    return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys of more than one block that hold more than one component."""
    several = rows.where(F.col("size") > BLOCK).groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return several.where("lo <> hi").select(key)


def shingles(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid and the full set of the wanted classes; docs: rid, text; wanted: cid, which is the rid of a class's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [shingle_set(t, k).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"cid": part.column("cid"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    rows = docs.select(F.col("rid").alias("cid"), "text").join(wanted.select("cid").hint("merge"), "cid")
    return rows.select("cid", "text").mapInArrow(run, "cid long, shingles array<long>")


def first_of(*cols: str):
    """The least of rows by doc_id, null last, then by row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *cols))


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept (doc_id is
    component_id) and first (the one row of its component that stays) of every row. Links: 100 * intersection >= percent
    * union of the k-word shingle sets. row names a column of unique numbers, which then is returned too; docs must give
    the same rows each time it is read. Without it the rows are numbered in a table."""
    threshold = percent / 100
    rows = docs.select((F.col(row).cast("long") if row else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if not row:
        rows = scratch.table(rows, "rows")
    drawn = scratch.table(sketches(rows, k), "sketches")
    # one class for each set: its first row stands for it
    classes = scratch.table(
        drawn.where("n_shingles > 0").groupBy("digest").agg(first_of("rid").alias("m"))
        .select("digest", F.col("m.doc_id").alias("doc_id"), F.col("m.rid").alias("cid")), "classes")
    faces = drawn.select(F.col("rid").alias("cid"), "bands", "signature", F.col("n_shingles").alias("n")).join(classes.select("cid"), "cid", "left_semi")
    keyed = faces.select(F.explode("bands").alias("key"), "cid")
    met = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.table(keyed.join(met, "key"), "shared")
    faced = scratch.table(faces.select("cid", "signature", "n").join(shared.select("cid").distinct(), "cid", "left_semi"), "faces")
    # clusters by estimates
    entries = blocked(shared, "key").join(faced, "cid").withColumn("comp", F.col("cid"))
    near = scratch.table(candidates(alone(entries), threshold), "near")
    roots = components(near, scratch)
    rooted = scratch.table(with_component(shared, roots), "rooted")
    left = blocked(rooted.join(mixed(rooted, "key"), "key", "left_semi"), "key")
    further = scratch.table(candidates(all_blocks(left).join(faced, "cid"), threshold), "further")
    roots = components(roots.toDF("a", "b").union(further), scratch)
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).toDF("cid", "cluster")
    sized = members.groupBy("cluster").agg(F.count("*").alias("size"))
    wanted = scratch.table(classes.join(members, "cid").join(sized, "cluster"), "wanted")
    # links by full sets
    sets = scratch.table(shingles(rows, wanted, k), "sets")
    placed = wanted.select("cid", "cluster", "size")
    dealt = blocked(placed.withColumn("deal", F.explode(F.when(F.col("size") > BLOCK, F.sequence(F.lit(1), F.lit(DEALINGS))).otherwise(F.array(F.lit(1))))), "deal")
    dealt = alone(dealt.withColumn("block", F.col("deal") * block_count() + F.col("block"))).withColumn("comp", F.col("cid"))
    links = scratch.table(confirm(dealt.join(sets.hint("merge"), "cid"), percent), "links")
    roots = components(links, scratch)
    rooted = scratch.table(with_component(placed, roots), "placed")
    left = blocked(rooted.join(mixed(rooted, "cluster"), "cluster", "left_semi"), "cluster")
    more = scratch.table(confirm(all_blocks(left).join(sets.hint("merge"), "cid"), percent), "more")
    final = components(roots.toDF("a", "b").union(more), scratch)
    # the first row of each component, then of each class's component, then of each row's class
    placed = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = placed.groupBy("root").agg(first_of("cid").alias("m"))
    named = scratch.table(placed.join(low, "root").select("digest", F.col("m.doc_id").alias("component_id"), F.col("m.cid").alias("first")), "named")
    scratch.drop(classes, shared, faced, near, further, wanted, sets, links, more, *([] if row else [rows]))
    out = drawn.select("rid", "doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        *([F.col("rid").alias(row)] if row else []), "doc_id", "n_shingles", own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"), (F.col("rid") == F.coalesce("first", "rid")).alias("first"),
    )
