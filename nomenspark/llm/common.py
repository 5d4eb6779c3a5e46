"""What the operators of this subpackage share: the cluster's shared folder, tables written there, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts: a run of bytes other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset (tests on one machine): a temporary one, which is then set."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nomenspark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables in the shared folder, so that lineage ends there and a lost executor costs only its running tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about most_bytes of text, or one row."""
    import numpy as np

    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
