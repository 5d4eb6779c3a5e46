"""Query op5_mixing. Routing and the seeded cut are no SQL; tests hold it against the contract's arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .mixing import make_plan, rows_of, take

SEED = 20260101


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = rows_of(docs, F.array("source"), "doc_id", SEED)
    plan = make_plan(rows, Scratch(spark, "mixing"))
    stats = plan.sources.withColumnRenamed("source", "_source")
    return take(rows, plan).join(stats, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"),
        "source", "copies",
    )
