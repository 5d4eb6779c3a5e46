"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Texts are cut into pre-tokens. The distinct ones that a worker has not met yet become token-position rows; a recursive
query joins adjacent rows with the merge table and contracts each word's leftmost minimum-rank pair until none is left.
Decoding joins token rows with the vocabulary and aggregates their bytes in order of position.

Time is linear in a text's length in any script: words are cut where the vocabulary has no token over the cut, and what
is still long is contracted in overlapping windows (windows.py), which gives the same ids.

No shuffle: a document never leaves its partition. A worker's memory is bounded by the slice of text at hand, by the
tables of words and pieces (see pretokenize.Words) and by DuckDB's memory limit, beyond which it spills to the worker's
own temporary folder, which is removed. At a task's end all are given back. A lost executor costs its running tasks only.

Defined results: a null or empty text has no ids and decodes to no bytes; a pre-token of any length has the ids that it
would have if contracted whole; repeated rows each get their row; an empty table gives none; other columns are passed by.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, text_of
from .pretokenize import Cutter, Words
from .windows import Pieces

#: Bytes of the words that go through SHORT together.
BATCH = 200_000

#: One contraction a round and word. A row is a token at position p, with the next one's position q and id t2 and the
#: packed pair (rank, p, q) if the two can merge. The least packed pair of a word is its leftmost minimum-rank pair: its
#: row takes the merged id, the row at q goes, and only rows next to the contraction meet the merge table again.
#: Rows of a word that has no pair left come out once more with live = false.
SHORT = """
WITH RECURSIVE s(w, p, q, t, t2, pair, live) AS (
  SELECT x.w, x.p, x.q, x.t, x.t2, (m.r::BIGINT << 32) | (x.p << 16) | x.q, true
  FROM (SELECT w, p, lead(p) OVER (PARTITION BY w ORDER BY p) AS q, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS t2 FROM seed) x
  LEFT JOIN merges m ON m.a = x.t AND m.b = x.t2
  UNION ALL
  SELECT y.w, y.p, y.q, y.t, y.t2, CASE WHEN changed THEN (m.r::BIGINT << 32) | (y.p << 16) | y.q ELSE pair END, y.live
  FROM (
    SELECT s.w, s.p, s.pair, h.b IS NOT NULL AS live, s.p = h.p OR s.q = h.p AS changed,
      CASE WHEN s.p = h.p THEN h.q2 ELSE s.q END AS q,
      CASE WHEN s.p = h.p THEN h.r ELSE s.t END AS t,
      CASE WHEN s.p = h.p THEN h.after WHEN s.q = h.p THEN h.r ELSE s.t2 END AS t2
    FROM s JOIN (
      SELECT best.w, b, (b >> 32)::INT AS r, ((b >> 16) & 65535)::INT AS p, e.p AS eaten, e.q AS q2, e.t2 AS after
      FROM (SELECT w, min(pair) AS b FROM s WHERE live GROUP BY w) best LEFT JOIN s e ON e.w = best.w AND e.p = (best.b & 65535)::INT
    ) h ON h.w = s.w
    WHERE s.live AND s.p IS DISTINCT FROM h.eaten
  ) y LEFT JOIN merges m ON m.a = CASE WHEN y.changed THEN y.t END AND m.b = y.t2
)
SELECT w, p, t FROM s WHERE NOT live ORDER BY w, p
"""

#: For long runs: a round contracts all occurrences of the minimum-rank pair that do not overlap, from the leftmost
#: on. That is what one by one would give, as a merge with the new token has a higher rank than the token itself. In a
#: run of overlapping occurrences (a a a a) every other one counts. rounds bounds what one query holds.
LONG = """
WITH RECURSIVE s(w, p, t, live, k) AS (
  SELECT w, p, t, true, 0 FROM seed
  UNION ALL
  SELECT w, p, CASE WHEN hit THEN r ELSE t END, best IS NOT NULL, k + 1
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY p) AS eaten
    FROM (
      SELECT w, p, t, r, best, k, at_best AND (i - coalesce(off, 0)) % 2 = 1 AS hit
      FROM (
        SELECT *, max(CASE WHEN NOT at_best THEN i END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING) AS off
        FROM (
          SELECT *, coalesce(r = best, false) AS at_best, row_number() OVER (PARTITION BY w ORDER BY p) AS i
          FROM (
            SELECT *, min(r) OVER (PARTITION BY w) AS best
            FROM (
              SELECT x.w, x.p, x.t, x.k, m.r
              FROM (SELECT w, p, t, k, lead(t) OVER (PARTITION BY w ORDER BY p) AS n FROM s WHERE live AND k < $rounds) x
              LEFT JOIN merges m ON m.a = x.t AND m.b = x.n
            )
          )
        )
      )
    )
  )
  WHERE NOT coalesce(eaten, false)
)
SELECT w, p, t, live FROM s WHERE NOT live OR k = $rounds ORDER BY w, p
"""

DECODE = """
SELECT d, unhex(string_agg(h, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (t) GROUP BY d ORDER BY d
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """The relations of one rank file in an in-memory DuckDB of the worker."""

    def __init__(self, path: str, memory: str = "150MB"):
        ranks = load_ranks(path)
        a, b, r = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None:
                    a.append(x), b.append(y), r.append(rank)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces = Pieces(ranks.items(), self._contract, self._long)
        self.tables = {
            "merges": pa.table({k: pa.array(v, pa.int32()) for k, v in (("a", a), ("b", b), ("r", r))}),
            "vocabulary": pa.table({"t": pa.array(ranks.values(), pa.int32()), "h": pa.array([x.hex() for x in ranks], pa.string())}),
        }
        self.memory, self.open = memory, None

    @property
    def con(self) -> duckdb.DuckDBPyConnection:
        """The database with its tables; opened when first asked for, until release()."""
        if self.open is None:
            spill = tempfile.TemporaryDirectory(prefix="bpe-")
            con = duckdb.connect(config={"threads": 1, "memory_limit": self.memory, "temp_directory": spill.name})
            for name, table in self.tables.items():
                con.register("incoming", table)
                con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
                con.unregister("incoming")
            self.open = (con, spill)
        return self.open[0]

    def release(self) -> None:
        self.pieces.clear()
        if self.open is not None:
            con, spill = self.open
            self.open = None
            con.close()
            spill.cleanup()

    def _ask(self, query: str, seed: pa.Table, name: str = "seed", **parameters) -> dict[str, np.ndarray]:
        self.con.register(name, seed)
        try:
            return self.con.execute(query, parameters or None).fetchnumpy()
        finally:
            self.con.unregister(name)

    def _seed(self, words: list[bytes]) -> pa.Table:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        p = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lens), "p": p.astype(np.int32), "t": flat})

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word) of non-empty words."""
        return self.pieces.encode([w.encode() for w in words])

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each) of byte strings of up to 65,535 bytes, each contracted as one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        cut = (np.cumsum(size) - size) // BATCH
        at = np.concatenate([np.flatnonzero(np.diff(cut, prepend=-1)), [len(words)]]).tolist()
        flat, lens = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            got = self._ask(SHORT, self._seed(words[lo:hi]))
            lens.append(np.bincount(got["w"], minlength=hi - lo))
            flat.append(np.asarray(got["t"], np.int32))
        return np.concatenate(flat), np.concatenate(lens)

    def _long(self, word: bytes) -> np.ndarray:
        seed = self._seed([word])
        while True:
            got = self._ask(LONG, seed, rounds=max(1, min(64, 4_000_000 // seed.num_rows)))
            if not len(got["live"]) or not got["live"].any():
                return np.asarray(got["t"], np.int32)
            n = len(got["t"])
            seed = pa.table({"w": np.zeros(n, np.int32), "p": np.arange(n, dtype=np.int32), "t": np.asarray(got["t"], np.int32)})

    def decode(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence; an id that the vocabulary lacks is an error."""
        d = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        tokens = pa.table({"d": d, "p": np.arange(len(flat), dtype=np.int64), "t": np.asarray(flat, np.int32)})
        if len(flat) and int(self._ask("SELECT count(*) AS n FROM tokens ANTI JOIN vocabulary USING (t)", tokens, "tokens")["n"][0]):
            raise ValueError("an id is not in the vocabulary")
        got = self._ask(DECODE, tokens, "tokens")
        out = [b""] * len(lens)
        for i, x in zip(got["d"], got["bytes"], strict=True):
            out[i] = bytes(x)
        return out


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> tuple[Bpe, Cutter, Words]:
    bpe = Bpe(path)
    return bpe, Cutter(pattern), Words(bpe.encode_words)


def ragged(flat: np.ndarray, lens: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key and ids (array of int) of every row; with decoded, also the bytes that the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cut, words = _worker(path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    flat, lens = words.ids([cut(x) for x in part.column("text").to_pylist()])
                    out = {"key": part.column("key"), "ids": ragged(flat, lens)}
                    if decoded:
                        out["decoded"] = pa.array(bpe.decode(flat, lens), pa.binary())
                    yield pa.RecordBatch.from_pydict(out)
        finally:  # an idle worker holds neither the database nor its words
            bpe.release()
            words.clear()
            give_back()

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (binary) of every row; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _, _ = _worker(path, pattern)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    lists = part.column("ids")
                    lens = np.asarray(pa.compute.list_value_length(lists).fill_null(0), np.int64)
                    got = bpe.decode(np.asarray(lists.flatten(), np.int32), lens)
                    yield pa.RecordBatch.from_pydict({"key": part.column("key"), "decoded": pa.array(got, pa.binary())})
        finally:
            bpe.release()
            give_back()

    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
