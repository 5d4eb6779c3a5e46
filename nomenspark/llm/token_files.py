"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout, per partition of the ordered rows: NAME.ids holds the ids of its documents one after another as little-endian
unsigned integers (16 bits where the vocabulary allows, else 32); NAME.offsets holds n + 1 little-endian unsigned
64-bit offsets into it; NAME.keys is an Arrow file with the n keys. The manifest has one row per partition; a document
starts at its partition's base, the prefix sum of the ids before, plus its offset. Files are memory-mapped where their
folder is mounted, and read by ranges otherwise.

Rows are range-partitioned by key and sorted, so that the files in manifest order hold the documents in ascending key
order (null keys first, equal keys by a hash of their text). Each attempt of a task writes files of its own name, and
only the manifest, which is written as a table, says which ones count; a lost executor costs its running tasks. Only
the manifest reaches the driver: one row per partition.

Defined results: a null or empty text has the end id alone; repeated rows each get their place; an empty table gives an
empty manifest; other columns are passed by.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, text_of
from .pretokenize import Cutter, Words
from .token_counts import Merges

MANIFEST = "part int, name string, bits int, n_docs long, n_tokens long"


class Library:
    """Ids of whole texts by the tokenizers library; distinct pre-tokens are encoded once per worker where the file is
    plain byte-level BPE, whole texts are otherwise."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = 16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 32
        try:
            spec = Merges(path)
        except (ValueError, KeyError, TypeError):
            self.cut = None
            return
        self.cut, self.words = Cutter(spec.pattern), Words(self._words)
        self.special = regex.compile("(" + "|".join(map(regex.escape, spec.special)) + ")") if spec.special else None

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, owners = [], []
        for k in range(0, len(new), 2000):
            got = self.tokenizer.encode(new[k : k + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            owners.append(np.array(got.word_ids, np.int64) + k)
        return np.concatenate(ids), np.bincount(np.concatenate(owners), minlength=len(new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text)"""
        if self.cut is None:
            got = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.fromiter(map(len, got), np.int64, len(got))
        pieces = []
        for t in texts:
            if self.special and self.special.search(t):  # split() gives text, special token, text, ...
                pieces.append([w for i, x in enumerate(self.special.split(t)) for w in ([x] if i % 2 else self.cut(x))])
            else:
                pieces.append(self.cut(t))
        return self.words.ids(pieces)


@lru_cache(maxsize=2)
def _library(path: str) -> Library:
    return Library(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_tokens(df: DataFrame, path: str, out: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files below out and returns the manifest, read back from its own table there."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, name = _library(path), TaskContext.get().partitionId(), uuid.uuid4().hex
        kind, n_docs, n_tokens = np.dtype(f"<u{library.bits // 8}"), 0, 0
        store, root = filesystem(out)
        ids = offsets = keys = sink = None
        for batch in batches:
            for rows in slices(batch, "text"):
                if ids is None:
                    ids, offsets = (store.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "offsets"))
                    sink = store.open_output_stream(f"{root}/{name}.keys")
                    keys = pa.ipc.new_file(sink, pa.schema([rows.schema.field("key")]))
                    offsets.write(np.zeros(1, "<u8").tobytes())
                flat, lens = library.encode(rows.column("text").to_pylist())
                ends = np.cumsum(lens)
                flat = np.insert(flat, ends, end_id)  # before position ends[i], so after the last id of i
                ids.write(flat.astype(kind).tobytes())
                offsets.write((n_tokens + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
                keys.write_batch(rows.select(["key"]))
                n_docs, n_tokens = n_docs + len(lens), n_tokens + len(flat)
        if ids is not None:
            keys.close()
            for x in (ids, offsets, sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "bits": pa.array([library.bits], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    filesystem(out)[0].create_dir(filesystem(out)[1], recursive=True)
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file's numbers, memory-mapped where it is local."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.dtype(kind), "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(manifest: DataFrame, out: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key, start (ids of all documents before), n_tokens and raw (its ids as little-endian unsigned 32-bit integers)
    of every document in the files."""
    spark: SparkSession = manifest.sparkSession
    parts = sorted(manifest.collect(), key=lambda r: r.part)  # a row per partition
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in parts], dtype=np.int64)])
    table = [(r.name, r.bits, r.n_docs, int(b)) for r, b in zip(parts, bases[:-1], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(out)
        for batch in batches:
            for r in batch.to_pylist():
                ids = mapped(store, f"{root}/{r['name']}.ids", f"<u{r['bits'] // 8}")
                offsets = mapped(store, f"{root}/{r['name']}.offsets", "<u8").astype(np.int64)
                with store.open_input_file(f"{root}/{r['name']}.keys") as f:
                    keys = pa.ipc.open_file(f).read_all().column("key").combine_chunks()
                if len(keys) != r["n_docs"] or len(offsets) != len(keys) + 1 or offsets[-1] != len(ids):
                    raise OSError(f"{root}/{r['name']}: the files disagree")
                at = 0
                while at < len(keys):  # about 4 MB of ids at a time
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
                    o = offsets[at : to + 1]
                    raw = ids[o[0] : o[-1]].astype("<u4")
                    bounds = pa.array(((o - o[0]) * 4).astype(np.int32))
                    yield pa.RecordBatch.from_pydict({
                        "key": keys.slice(at, to - at), "start": pa.array(r["base"] + o[:-1]), "n_tokens": pa.array(np.diff(o)),
                        "raw": pa.Array.from_buffers(pa.binary(), to - at, [None, bounds.buffers()[1], pa.py_buffer(raw)]),
                    })
                    at = to

    rows = spark.createDataFrame(table, "name string, bits int, n_docs long, base long")
    return rows.repartition(max(1, len(table))).mapInArrow(run, f"key {kind}, start long, n_tokens long, raw binary").withColumnRenamed("key", key)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
