"""Contig names, accessions and builds by a table of aliases: built in for the human assemblies, or from an assembly report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of NC_000001 to NC_000024 (1 to 22, X, Y) in each build. Fixed values of the public assemblies.
VERSIONS = {
    "GRCh37": (10, 11, 11, 11, 9, 11, 13, 10, 11, 10, 9, 11, 10, 8, 9, 9, 10, 9, 9, 10, 8, 10, 10, 9),
    "GRCh38": (11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10),
}
MITOCHONDRION = "NC_012920.1"
#: Other names of the builds.
BUILDS = {"grch37": "GRCh37", "hg19": "GRCh37", "b37": "GRCh37", "grch38": "GRCh38", "hg38": "GRCh38", "b38": "GRCh38"}


def build_of(name: Column) -> Column:
    """GRCh37 or GRCh38 of a build's name, with or without a patch; null for others."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"\.p\d+$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BUILDS.items() for x in kv]), plain)


def folded(name: Column) -> Column:
    """A contig's name without chr and case, M for MT."""
    plain = F.regexp_replace(F.upper(F.trim(name)), "^CHR", "")
    return F.when(plain == "MT", "M").otherwise(plain)


def aliases(spark: SparkSession) -> DataFrame:
    """build, name (as UCSC writes it) and accession of the human chromosomes: 50 rows."""
    names = [*map(str, range(1, 23)), "X", "Y"]
    rows = [(b, f"chr{n}", f"NC_{i:06d}.{v}") for b, vs in VERSIONS.items() for i, (n, v) in enumerate(zip(names, vs, strict=True), 1)]
    return spark.createDataFrame(rows + [(b, "chrM", MITOCHONDRION) for b in VERSIONS], "build string, name string, accession string")


def report_aliases(report: DataFrame, build: str) -> DataFrame:
    """build, name and accession from sources.assembly_report(): of each of its names that has a RefSeq accession."""
    names = F.explode(F.array_distinct(F.array_compact(F.array("name", "ucsc", "genbank"))))
    return report.where("refseq IS NOT NULL").select(F.lit(build).alias("build"), names.alias("name"), F.col("refseq").alias("accession")).distinct()


def with_accession(rows: DataFrame, table: DataFrame, name: str, build: str | Column) -> DataFrame:
    """rows with accession (an accession stays itself) and contig_error: unknown_build, unknown_contig or null. The table
    has a row a contig, so that it is joined by its size."""
    own = table.groupBy(F.col("build").alias("_build"), folded(F.col("name")).alias("_name")).agg(F.min("accession").alias("_accession"))
    wanted = rows.withColumns({"_want": build_of(F.lit(build) if isinstance(build, str) else build), "_fold": folded(F.col(name))})
    joined = wanted.join(own, (F.col("_want") == F.col("_build")) & (F.col("_fold") == F.col("_name")), "left")
    given = F.when(F.col(name).rlike(r"^[A-Z]{2}_\d+\.\d+$"), F.col(name))
    accession = F.coalesce(given, "_accession")
    error = F.when(accession.isNotNull(), F.lit(None)).when(F.col("_want").isNull(), "unknown_build").otherwise("unknown_contig")
    return joined.withColumns({"accession": accession, "contig_error": error}).drop("_want", "_fold", "_build", "_name", "_accession")


def named(rows: DataFrame, table: DataFrame, accession: str) -> DataFrame:
    """rows with name and build of an accession; of one that several builds share (the mitochondrion) the newest. Null for
    accessions that the table lacks."""
    own = table.groupBy(F.col("accession").alias("_accession")).agg(F.max_by("name", "build").alias("name"), F.max("build").alias("build"))
    return rows.join(own, F.col(accession) == F.col("_accession"), "left").drop("_accession")
