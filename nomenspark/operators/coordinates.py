"""Positions carried between coding, transcript and contig axes by joins with transcripts and exons.

transcripts: tx, cds_start and cds_end (1-based, inclusive, null if non-coding). exons: tx, contig, strand, number, t0, t1 in
the transcript and x0, x1 on the contig, 0-based half-open. Positions are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import stab


def cds_to_tx(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """rows (tx, base, off, utr3) with n: null on a non-coding transcript, for base 0, and before the transcript."""
    n = F.when(F.col("utr3"), F.col("cds_end") + F.col("base")).when(F.col("base") < 0, F.col("cds_start") + F.col("base")).when(F.col("base") > 0, F.col("cds_start") + F.col("base") - 1)
    joined = rows.join(transcripts.select("tx", "cds_start", "cds_end"), "tx")
    return joined.withColumn("n", F.when((n >= 1) & (F.col("cds_start") <= F.col("cds_end")), n)).drop("cds_start", "cds_end")


def tx_to_cds(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """rows (tx, n) with base and utr3."""
    joined = rows.join(transcripts.select("tx", "cds_start", "cds_end"), "tx")
    after = F.col("n") > F.col("cds_end")
    base = F.when(after, F.col("n") - F.col("cds_end")).when(F.col("n") < F.col("cds_start"), F.col("n") - F.col("cds_start")).otherwise(F.col("n") - F.col("cds_start") + 1)
    return joined.withColumns({"base": base, "utr3": after}).drop("cds_start", "cds_end")


def tx_to_genome(rows: DataFrame, exons: DataFrame) -> DataFrame:
    """rows (tx, n, off) with contig and g; rows outside the exons go. An intron offset counts along the transcript."""
    own = exons.select("tx", "contig", "strand", "t0", "t1", "x0", "x1")
    hit = rows.join(own, "tx").where((F.col("n") > F.col("t0")) & (F.col("n") <= F.col("t1")))
    into, off = F.col("n") - 1 - F.col("t0"), F.coalesce(F.col("off"), F.lit(0))
    g = F.when(F.col("strand") == 1, F.col("x0") + into + 1 + off).otherwise(F.col("x1") - into - off)
    return hit.withColumn("g", g).drop("strand", "t0", "t1", "x0", "x1")


def genome_to_tx(points: DataFrame, exons: DataFrame) -> DataFrame:
    """points (contig, g) with each transcript that has an exon there, and n."""
    own = exons.select("tx", "contig", "strand", "t0", "x0", "x1")
    hit = stab(points.withColumn("_g0", F.col("g") - 1), own, "contig", "_g0", "x0", "x1")
    n = F.col("t0") + 1 + F.when(F.col("strand") == 1, F.col("_g0") - F.col("x0")).otherwise(F.col("x1") - 1 - F.col("_g0"))
    return hit.withColumn("n", n).drop("_g0", "t0", "x0", "x1")


def introns(exons: DataFrame) -> DataFrame:
    """tx, contig, strand, number, left (last transcript base before it) and x0, x1 on the contig, from neighbouring exons."""
    w = Window.partitionBy("tx").orderBy("number")
    pair = exons.withColumns({"nx0": F.lead("x0").over(w), "nx1": F.lead("x1").over(w)}).where("nx0 IS NOT NULL")
    lo, hi = F.when(F.col("strand") == 1, F.col("x1")).otherwise(F.col("nx1")), F.when(F.col("strand") == 1, F.col("nx0")).otherwise(F.col("x0"))
    return pair.select("tx", "contig", "strand", "number", F.col("t1").alias("left"), lo.alias("lo"), hi.alias("hi")).withColumnsRenamed({"lo": "x0", "hi": "x1"})


def intron_position(points: DataFrame, exons: DataFrame) -> DataFrame:
    """points (contig, g) in introns: transcript base of the nearer exon end, and the signed offset from it. The middle of
    an odd intron belongs to the left exon."""
    hit = stab(points.withColumn("_g0", F.col("g") - 1), introns(exons), "contig", "_g0", "x0", "x1")
    after = F.when(F.col("strand") == 1, F.col("_g0") - F.col("x0") + 1).otherwise(F.col("x1") - F.col("_g0"))
    before = F.col("x1") - F.col("x0") - after + 1
    near = after <= before
    return hit.withColumns({"n": F.when(near, F.col("left")).otherwise(F.col("left") + 1), "off": F.when(near, after).otherwise(-before)}).drop("_g0", "left", "x0", "x1", "strand")


def codon(base: Column) -> Column:
    """struct(number, frame) of a position in the coding sequence; frame 0 to 2."""
    return F.when(base >= 1, F.struct(F.floor((base - 1) / 3 + 1).cast("long").alias("number"), ((base - 1) % 3).cast("int").alias("frame")))


def to_zero(one: Column) -> Column:
    """A 1-based position as a 0-based one; null for 0 and below, which no 1-based axis has."""
    return F.when(one >= 1, one - 1)


def to_one(zero: Column) -> Column:
    """A 0-based position as a 1-based one; null below 0, and at the largest number, beyond which there is none."""
    return F.when((zero >= 0) & (zero < 9223372036854775807), zero + 1)


def to_half_open(lo: Column, hi: Column) -> Column:
    """struct(lo, hi): a 1-based inclusive interval as a 0-based half-open one; null if it is none."""
    return F.when((lo >= 1) & (hi >= lo), F.struct((lo - 1).alias("lo"), hi.alias("hi")))


def codon_bases(number: Column) -> Column:
    """struct(lo, hi): the coding positions of a residue, 1-based inclusive."""
    return F.when(number >= 1, F.struct((3 * number - 2).alias("lo"), (3 * number).alias("hi")))


def valid_position(axis: Column, n: Column, length: Column, cds_start: Column, cds_end: Column) -> Column:
    """Whether a 1-based position (on c. relative to the start codon, none of them 0) lies on its sequence; on p. up to the
    stop's codon. Null where there is nothing to judge by."""
    tx = F.when(n > 0, cds_start + n - 1).otherwise(cds_start + n)
    residues = F.floor((cds_end - cds_start + 1) / 3)
    return (
        F.when(axis.isin("g", "n", "m", "o"), n.between(1, length)).when(axis == "c", (n != 0) & tx.between(1, length))
        .when(axis == "p", n.between(1, residues))
    )


def structure(placed: DataFrame) -> DataFrame:
    """tx, number, t0 and t1 of exons that are known on the contig alone (tx, strand, x0, x1): in transcript order, one after
    another."""
    order = F.when(F.col("strand") == 1, F.col("x0")).otherwise(-F.col("x0"))
    w = Window.partitionBy("tx").orderBy(order)
    size = F.col("x1") - F.col("x0")
    return placed.select("tx", F.row_number().over(w).alias("number"), (F.sum(size).over(w) - size).alias("t0"), F.sum(size).over(w).alias("t1"), "x0", "x1")
