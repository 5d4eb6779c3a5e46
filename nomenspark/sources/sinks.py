"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenspark.functions import vcf as V

RESULT = ("line", "input", "normalized", "changed", "status", "detail")


def result_rows(df: DataFrame) -> DataFrame:
    """The columns of a normalization report: line, input, normalized, changed, status (ok or an error class), detail."""
    ok = F.col("error").isNull()
    return df.select("line", "input", F.when(ok, F.col("normalized")).otherwise("").alias("normalized"), F.when(ok, F.col("normalized") != F.col("input")).otherwise(False).alias("changed"), F.when(ok, "ok").otherwise(F.col("error")).alias("status"), F.coalesce("detail", F.lit("")).alias("detail"))


def write_results(df: DataFrame, path: str) -> None:
    df.select(*RESULT).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_vcf(records: DataFrame, path: str, header: list[str]) -> None:
    """Record lines in order of chrom and pos, in parts; every part begins with the header, so each is a file of its own."""
    line = V.write_line(*(F.col(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")))
    top = "\n".join([*header, "#" + "\t".join(f.upper() for f in V.FIELDS)])
    ordered = records.withColumn("_line", line).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            rows = b.column("value").to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [top, *rows] if first else rows})
            first = False

    ordered.select(F.col("_line").alias("value")).mapInArrow(run, "value string").write.text(path)


def info_header(name: str, number: str, kind: str, text: str) -> str:
    return f'##INFO=<ID={name},Number={number},Type={kind},Description="{text}">'


def transcript_rows(df: DataFrame) -> Column:
    """A transcripts JSON line of genomics.transcripts() columns."""
    return F.to_json(F.struct(F.col("tx").alias("id"), F.col("gene").alias("gene_symbol"), "strand", "exons"))


def annotation_value(alt: Column, term: Column, impact: Column, gene: Column, tx: Column, coding: Column, protein: Column) -> Column:
    """One entry of an ANN value: its fields by |, those that are unknown empty."""
    return F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (alt, term, impact, gene, tx, coding, protein)))


def annotated(hits: DataFrame, key: str) -> DataFrame:
    """key, genes, hgvs_c, transcripts and consequences of annotations (key, gene, tx, description, term): each a comma-joined
    list without repeats, in order of gene and transcript, and ann, all entries."""
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("gene", "tx", "description", "term"))).alias("_h"))
    listed = lambda name: F.array_join(F.array_distinct(F.array_compact(F.transform("_h", lambda x: x[name]))), ",")
    entry = F.transform("_h", lambda x: F.concat_ws("|", F.coalesce(x["term"], F.lit("")), F.coalesce(x["gene"], F.lit("")), F.coalesce(x["tx"], F.lit("")), F.coalesce(x["description"], F.lit(""))))
    return rows.select(key, listed("gene").alias("genes"), listed("description").alias("hgvs_c"), listed("tx").alias("transcripts"), listed("term").alias("consequences"), F.array_join(entry, ",").alias("ann"))


def summary(rows: DataFrame) -> DataFrame:
    """total, ok, failed and changed of result_rows()."""
    n, ok = F.count("*"), F.count_if(F.col("status") == "ok")
    return rows.agg(n.alias("total"), ok.alias("ok"), (n - ok).alias("failed"), F.count_if("changed").alias("changed"))


def timing_line(operation: Column, total: Column, ok: Column, seconds: Column) -> Column:
    """A timing record as JSON."""
    return F.to_json(F.struct(operation.alias("operation"), total.alias("total"), ok.alias("ok"), (total - ok).alias("failed"), seconds.alias("seconds"), F.round(F.try_divide(total, seconds), 3).alias("per_second")))


def projection_line(tx: Column, axis: Column, output: Column, reason: Column) -> Column:
    """A projected description as text: transcript, axis and what it is, or why there is none."""
    return F.concat_ws("\t", tx, axis, F.coalesce(output, F.concat(F.lit("unavailable: "), reason)))
