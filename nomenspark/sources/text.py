"""Lists of descriptions, tab-separated exports, annotation fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def cleaned(line: Column) -> Column:
    """A line without byte-order mark, comment and outer white space; null if nothing is left."""
    text = F.regexp_replace(line, f"^{BOM}", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(^|\s)#.*$", ""), r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """text of every line that holds a description."""
    return spark.read.text(path).select(cleaned(F.col("value")).alias("text")).where("text IS NOT NULL")


def clinvar_export(spark: SparkSession, path: str) -> DataFrame:
    """Distinct descriptions of a ClinVar export: the seventh and ninth column, several in one joined by |."""
    f = F.split("value", "\t")
    both = F.concat(F.split(F.coalesce(F.try_element_at(f, F.lit(7)), F.lit("")), r"\|"), F.split(F.coalesce(F.try_element_at(f, F.lit(9)), F.lit("")), r"\|"))
    found = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.explode(both).alias("text"))
    return found.select(F.trim("text").alias("text")).where(F.col("text").contains(":") & F.col("text").contains(".")).distinct()


def consequence_fields(info: Column, name: str, index: int) -> Column:
    """The index-th |-separated field (0-based) of each entry of an INFO value such as CSQ=a|b,c|d, empty ones dropped."""
    value = F.regexp_extract(info, rf"(?:^|;){name}=([^;]*)", 1)
    each = F.transform(F.split(value, ","), lambda x: F.coalesce(F.try_element_at(F.split(x, r"\|"), F.lit(index + 1)), F.lit("")))
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def json_patterns(text: Column) -> Column:
    """Descriptions in a JSON document of one of three layouts: an array of strings, an array of objects with input, or an
    object with either under patterns."""
    inner = F.coalesce(F.get_json_object(text, "$.patterns"), text)
    strings = F.from_json(inner, "array<string>")
    return F.transform(strings, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.input")).otherwise(x))
