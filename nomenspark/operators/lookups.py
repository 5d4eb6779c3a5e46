"""Keyed lookups: versions, preferred transcripts, sequence windows, liftover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenspark.functions.descriptions import base_accession

from .contigs import build_of
from .intervals import stab


def newest(transcripts: DataFrame) -> DataFrame:
    """base and the accession of its highest version."""
    version = F.regexp_extract("tx", r"\.(\d+)$", 1).try_cast("int")
    return transcripts.groupBy(base_accession(F.col("tx")).alias("base")).agg(F.max_by("tx", version).alias("tx"))


def resolve(wanted: DataFrame, transcripts: DataFrame) -> DataFrame:
    """wanted (acc) with found: the accession itself, else the highest version of its base; null if there is none."""
    exact = transcripts.select(F.col("tx").alias("acc"), F.col("tx").alias("_exact"))
    spare = newest(transcripts).withColumnsRenamed({"base": "_base", "tx": "_spare"})
    joined = wanted.withColumn("_base", base_accession(F.col("acc"))).join(exact, "acc", "left").join(spare, "_base", "left")
    return joined.withColumn("found", F.coalesce("_exact", "_spare")).drop("_exact", "_base", "_spare")


def lrg_names(hosted: DataFrame) -> DataFrame:
    """acc (LRG_1t1, LRG_1) and tx, the RefSeq record that it stands for. hosted: ng, lrg, selector (t1) and tx."""
    own = hosted.select(F.concat("lrg", "selector").alias("acc"), "tx")
    return own.union(hosted.select("lrg", "ng").distinct())


def sole_hosted(hosted: DataFrame) -> DataFrame:
    """ng and tx of the genomic records that host one transcript only."""
    return hosted.groupBy("ng").agg(F.count("*").alias("_n"), F.min("tx").alias("tx")).where("_n = 1").drop("_n")


def on_build(placed: DataFrame, build: str) -> DataFrame:
    """The placements (with a column build) of one build, by any of its names."""
    return placed.where(build_of(F.col("build")) == build_of(F.lit(build)))


def available_builds(placed: DataFrame) -> DataFrame:
    """tx and its builds, in order of name."""
    return placed.groupBy("tx").agg(F.array_sort(F.collect_set("build")).alias("builds"))


def preferred(transcripts: DataFrame) -> DataFrame:
    """Per gene the transcript to report: MANE Select, else Plus Clinical, else coding, else any; the first by name."""
    rank = F.when(F.col("mane") == "select", 0).when(F.col("mane") == "plus_clinical", 1).when(F.col("cds_start").isNotNull(), 2).otherwise(3)
    return transcripts.groupBy("gene").agg(F.min(F.struct(rank.alias("rank"), "tx")).alias("m")).select("gene", "m.tx", "m.rank")


def ranked(hits: DataFrame, variant: str) -> DataFrame:
    """Transcripts of each variant in order of report: one version a base accession, predicted ones only where no curated
    one is; MANE Select, Plus Clinical, coding, then by name. Adds rank, 1 first."""
    version = F.regexp_extract("tx", r"\.(\d+)$", 1).try_cast("int")
    one = hits.withColumn("_v", F.row_number().over(Window.partitionBy(variant, base_accession(F.col("tx"))).orderBy(version.desc()))).where("_v = 1")
    curated = F.col("tx").rlike("^N[MR]_")
    kept = one.withColumn("_any", F.max(curated).over(Window.partitionBy(variant))).where(curated | ~F.col("_any"))
    mane = F.when(F.col("mane") == "select", 0).when(F.col("mane") == "plus_clinical", 1).when(F.col("cds_start").isNotNull(), 2).otherwise(3)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(variant).orderBy(mane, "tx"))).drop("_v", "_any")


def chunks(sequences: DataFrame, size: int = 64, by: tuple[str, ...] = ("acc",)) -> DataFrame:
    """by, chunk and its bases: the stored form of sequences of any length. by: the columns that tell one sequence from another."""
    numbers = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))
    return sequences.select(*by, F.explode(numbers).alias("chunk"), "seq").select(*by, "chunk", F.substring("seq", F.col("chunk") * size + 1, F.lit(size)).alias("bases"))


def window(requests: DataFrame, stored: DataFrame, key: str, size: int = 64, by: tuple[str, ...] = ("acc",)) -> DataFrame:
    """requests (key, by, s, e) with bases [s, e): an equality join on (by, chunk), two or three chunks a request. It sorts
    whatever Spark reckons, as an estimate counts neither chunks nor their length."""
    need = requests.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / size).cast("int"), F.floor((F.col("e") - 1) / size).cast("int"))))
    got = need.join(stored.hint("merge"), [*by, "chunk"]).groupBy(key, *by, "s", "e").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("c"))
    first = F.element_at("c", 1)["chunk"]
    joined = F.array_join(F.transform("c", lambda x: x["bases"]), "")
    return got.select(key, *by, "s", "e", F.substring(joined, (F.col("s") - first * size + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")).alias("bases"))


def stars(review: Column) -> Column:
    return (
        F.when(review == "practice guideline", 4).when(review == "reviewed by expert panel", 3).when(review == "criteria provided, multiple submitters, no conflicts", 2)
        .when(review.startswith("criteria provided"), 1).otherwise(0)
    )


def lift(points: DataFrame, blocks: DataFrame, key: str, contig: str, at: str, p: str = "") -> DataFrame:
    """Points (1-based at) through the chain of highest score that spans them, the higher number on a tie: status lifted, gap or
    no_chain, the target q_name and 1-based q, the chain, and whether several chains span the point. p: prefix of these.

    blocks: chain, score, t_name, q_name, q_strand, q_size, t_lo, t_hi (of the chain), t0, t1, q0, 0-based half-open.
    """
    spans = blocks.select("chain", "score", F.col("t_name").alias("_t"), "q_name", "q_strand", "q_size", "t_lo", "t_hi").distinct()
    own = points.withColumns({"_p0": F.col(at) - 1, "_t": F.col(contig)})
    # chains span whole contigs, so they are dealt to wide bins; blocks are short and meet points in bins of their length
    spanned = stab(own.select(key, "_t", "_p0"), spans, "_t", "_p0", "t_lo", "t_hi", 1 << 24)
    best = spanned.groupBy(key, "_p0").agg(F.max(F.struct("score", "chain", "q_name", "q_strand", "q_size")).alias("m"), (F.count("*") > 1).alias("several")).select(key, "_p0", "m.*", "several")
    held = stab(own.select(key, "_t", "_p0"), blocks.select(F.col("t_name").alias("_t"), F.col("chain").alias("_chain"), "t0", "t1", "q0"), "_t", "_p0", "t0", "t1", 1 << 14)
    held = held.select(F.col(key).alias("_key"), "_chain", (F.col("q0") + F.col("_p0") - F.col("t0")).alias("_q"))
    moved = best.join(held, (F.col(key) == F.col("_key")) & (F.col("chain") == F.col("_chain")), "left")
    q = F.when(F.col("q_strand") == "-", F.col("q_size") - F.col("_q")).otherwise(F.col("_q") + 1)
    placed = moved.groupBy(key, "chain", "q_name", "several").agg(F.max(q).alias("q"))
    out = points.select(key).join(placed, key, "left")
    status = F.when(F.col("chain").isNull(), "no_chain").when(F.col("q").isNull(), "gap").otherwise("lifted")
    return out.select(key, status.alias(f"{p}status"), F.when(F.col("q").isNotNull(), F.col("q_name")).alias(f"{p}contig"), F.col("q").alias(f"{p}q"), F.col("chain").alias(f"{p}chain"), F.coalesce("several", F.lit(False)).alias(f"{p}several"))


def lift_builds(points: DataFrame, chains: DataFrame, key: str, contig: str, at: str, source: str, target: str) -> DataFrame:
    """lift() from one build to another, by any of their names. chains: blocks with the builds (source, target) that their
    file leads from and to; no chain file is read backwards."""
    own = chains.where((build_of(F.col("source")) == build_of(F.lit(source))) & (build_of(F.col("target")) == build_of(F.lit(target))))
    return lift(points, own.drop("source", "target"), key, contig, at)


def lift_37_to_38(points: DataFrame, chains: DataFrame, key: str, contig: str, at: str) -> DataFrame:
    return lift_builds(points, chains, key, contig, at, "GRCh37", "GRCh38")


def lift_38_to_37(points: DataFrame, chains: DataFrame, key: str, contig: str, at: str) -> DataFrame:
    return lift_builds(points, chains, key, contig, at, "GRCh38", "GRCh37")
