"""Query op9_minhash. Its brute-force version is in the tests."""

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, read
from .minhash import near_duplicates

SHINGLE, PERCENT = 4, 80


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "minhash"), SHINGLE, PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
