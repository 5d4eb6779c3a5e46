"""Query op10_secrets. The network is no SQL; the base columns are held against plain patterns in the tests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .secret_scan import KINDS, scan, trained


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), trained())
    joined = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda f: f["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:-1]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), count(KINDS[-1]),
    )
