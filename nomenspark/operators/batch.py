"""Batches of descriptions: one pass that keeps the order of its lines and counts as it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nomenspark.functions.grammar import parse_all


def parsed_lines(lines: DataFrame, line: str = "line", text: str = "text", seen: Observation | None = None) -> DataFrame:
    """line, input, canonical, ok and error of every line; the line number is what keeps the order. seen: an observation that
    gets total, ok and failed when a job has run, without a pass of its own."""
    rows = parse_all(lines.select(F.col(line).alias("line"), F.col(text).alias("input")), "line", "input")
    out = rows.select("line", "input", "canonical", F.col("error").isNull().alias("ok"), "error")
    if seen is not None:
        out = out.observe(seen, F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return out


def only_parsed(results: DataFrame) -> DataFrame:
    """The lines that parsed."""
    return results.where("ok").drop("ok", "error")


def table(results: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """One row each of row, one column each of columns, with the median of value; null, a stale cell, where nothing ran."""
    cells = [F.median(F.when(F.col(column) == c, F.col(value))).alias(c) for c in columns]
    return results.groupBy(row).agg(*cells)
