"""Query op8_substring_dedup. The rolling hash is no SQL; tests compare with shared word windows by brute force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .substring import repeated_spans


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"), Scratch(spark, "substring"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["words"])
    places = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select(
        "doc_id", "n_chunks", "n_shared_chunks", F.size("spans").cast("long").alias("n_spans"), words(F.col("spans")).alias("repeated_words"),
        words(F.col("later")).alias("later_words"), places("spans").alias("spans"),
        words(F.col("within")).alias("within_words"), places("within").alias("within"),
    )
