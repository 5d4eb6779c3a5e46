"""Descriptions as a stream: files of lines that arrive are parsed and categorized without state, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenspark.functions import descriptions as D
from nomenspark.sources.text import cleaned


def described(lines: DataFrame) -> DataFrame:
    """text, category and the parsed fields of lines (value); batch or stream."""
    text = lines.select(cleaned(F.col("value")).alias("text")).where("text IS NOT NULL")
    return text.select("text", D.category(F.col("text")).alias("category"), D.parse(F.col("text")).alias("v")).select("text", "category", "v.*")


def read_lines(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)


def write(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, each line exactly once; starts the query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
