"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

1. Vectors that are equal in label and components form a class; one stands for all, and its size is counted.
2. A rotation is three rounds of random signs and a Hadamard transform; its hash is the largest coordinate and sign. Three
   of them make a table's key; each vector also enters the two keys next in likelihood (multiprobe), in 6 tables. At a
   cosine of 0.98 in 64 dimensions a pair misses all tables with probability of about 1e-5.
3. Vectors that share a key are compared in blocks, by cosine in double precision. A pair counts in the first key that
   its two vectors share, so no list of pairs is kept to drop repeats from: each block gives counts of links and a
   spanning forest of them.
4. Components come from the forests.

Large buckets are cut into blocks and all pairs of blocks are compared, so none is skipped or capped; what a task holds
is two blocks. Copies never meet one another.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, as does
one without a label; vectors of unlike length don't link; rows that share an id are one vector of several values; a null
id links with nothing and is kept; an empty table gives none; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .minhash import grouped, mix

TABLES, HASHES, BLOCK = 6, 3, 512
PROBES = HASHES


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows' fast Walsh-Hadamard transform, scaled to keep lengths; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probe_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """rows x TABLES x PROBES keys of unit vectors: the main one, and those with the least certain hashes replaced."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    r = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), TABLES, PROBES), np.int64)
    rows = np.arange(len(x))
    for t in range(TABLES):
        best, next_, gap = (np.empty((len(x), HASHES), k) for k in (np.int64, np.int64, np.float64))
        for k in range(HASHES):
            y = x
            for _ in range(3):
                y = hadamard(y * r.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            code = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best[:, k], next_[:, k] = code[:, 0], code[:, 1]
            gap[:, k] = size[rows, top[:, 0]] - size[rows, top[:, 1]]
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(PROBES):
            code = best.copy()
            if p:
                code[rows, order[:, p - 1]] = next_[rows, order[:, p - 1]]
            key = np.full(len(x), t + 1, np.uint64)
            for k in range(HASHES):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + code[:, k].astype(np.uint64))
            out[:, t, p] = key.view(np.int64)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(classes: DataFrame, seed: int) -> DataFrame:
    """cid and keys (TABLES * PROBES longs) of each class; label and length go into every key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lens = np.asarray(pa.compute.list_value_length(part.column("v")), np.int64)
                own = np.asarray(part.column("salt"), np.int64).view(np.uint64)
                out = np.empty((part.num_rows, TABLES * PROBES), np.int64)
                for n in np.unique(lens):
                    rows = np.flatnonzero(lens == n)
                    keys = probe_keys(unit(matrix(part.column("v").take(pa.array(rows)))), seed).reshape(len(rows), -1)
                    out[rows] = mix(keys.view(np.uint64) ^ mix(own[rows] + np.uint64(n))[:, None]).view(np.int64)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (TABLES * PROBES))
                yield pa.RecordBatch.from_pydict({"cid": part.column("cid"), "keys": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

    return classes.select("cid", "v", F.xxhash64("label").alias("salt")).mapInArrow(run, "cid long, keys array<long>")


def compare(entries: DataFrame, least: float) -> DataFrame:
    """Per key and pair of blocks: rows (a, b, n). With b null, class a has links to n vectors; else a and b are linked.

    entries: key, b1, b2, block, cid, salt, n, v, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["key", "b1", "b2"]):
            a, b, n = [], [], []
            bounds = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            col = {c: t.column(c).to_numpy() for c in ("key", "b1", "b2", "block", "cid", "salt", "n")}
            vectors, keys = t.column("v").combine_chunks(), matrix_of_longs(t.column("keys").combine_chunks())
            lens = np.asarray(pa.compute.list_value_length(vectors), np.int64)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                if len(np.unique(lens[lo:hi])) > 1 or len(np.unique(col["salt"][lo:hi])) > 1:
                    raise ValueError("one key holds two labels or lengths")  # the salt is 64 bits wide
                x = matrix(vectors.slice(lo, hi - lo))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                size = np.sqrt((x * x).sum(axis=1))
                u = x / size[:, None]
                cosine = u @ u.T
                i, j = np.nonzero(np.triu(cosine >= least - 1e-9, 1))
                close = np.flatnonzero(cosine[i, j] < least + 1e-9)  # rounding could decide: once more, unscaled
                ok = np.ones(len(i), bool)
                ok[close] = (x[i[close]] * x[j[close]]).sum(1) >= least * size[i[close]] * size[j[close]]
                i, j = i[ok] + lo, j[ok] + lo
                if col["b1"][lo] != col["b2"][lo]:
                    ok = col["block"][i] != col["block"][j]
                    i, j = i[ok], j[ok]
                ok = least_shared(keys, i, j) == col["key"][lo]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                each = np.bincount(i - lo, col["n"][j], hi - lo) + np.bincount(j - lo, col["n"][i], hi - lo)
                some = np.flatnonzero(each)
                a.append(col["cid"][lo + some]), b.append(np.full(len(some), -1)), n.append(each[some].astype(np.int64))
                up = list(range(hi - lo))

                def root(k: int, up=up) -> int:
                    while up[k] != k:
                        up[k] = up[up[k]]
                        k = up[k]
                    return k

                tree = []
                for p, q in zip((i - lo).tolist(), (j - lo).tolist(), strict=True):
                    if (r := root(p)) != (s := root(q)):
                        up[s] = r
                        tree.append((p + lo, q + lo))
                if tree:
                    p, q = np.array(tree).T
                    a.append(col["cid"][p]), b.append(col["cid"][q]), n.append(np.zeros(len(p), np.int64))
            if a:
                b = np.concatenate(b)
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(b, mask=b < 0), "n": pa.array(np.concatenate(n))})

    dealt = entries.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.mapInArrow(run, "a long, b long, n long")


def matrix_of_longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def least_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 20_000) -> np.ndarray:
    """For rows i and j of keys the least key that both have; the largest number if none."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), step):
        x, y = keys[i[k : k + step]], keys[j[k : k + step]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[k : k + step] = np.where(both, x, np.iinfo(np.int64).max).min(axis=1)
    return out


def near_vectors(df: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, seed: int = 20260101) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable, itself included) and kept (key
    is component_id) of every row. Links: equal labels, not null, and cosine >= least."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    # -0.0 and 0.0 are one value
    drawn = rows.select("id", F.when(valid, F.col("label")).alias("label"), F.when(valid, F.transform("v", lambda x: x + 0.0)).alias("v"))
    drawn = scratch.table(drawn, "vectors")
    sized = drawn.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = scratch.table(sized.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = scratch.table(keyed(classes, seed), "keys")
    each = keys.select("cid", F.explode(F.array_distinct("keys")).alias("key"))
    met = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.table(each.join(met, "key"), "shared")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    spread = shared.withColumn("block", F.pmod(F.xxhash64("cid", "key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.select("cid", "key", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    faces = classes.select("cid", "n", "v", F.xxhash64("label").alias("salt")).join(keys, "cid")
    found = scratch.table(compare(spread.join(faces, "cid"), least), "found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch).withColumnRenamed("node", "cid")
    placed = classes.select("cid", "label", "v", "low", "n").join(roots, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    total = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    named = scratch.table(placed.join(lowest, "root").select("label", "v", total, "component_id"), "named")
    scratch.drop(classes, keys, shared, found)
    out = drawn.join(named, ["label", "v"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
