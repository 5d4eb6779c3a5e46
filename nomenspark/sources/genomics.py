"""FASTA, VCF, GFF3 and GTF, chains, assembly reports, transcript JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomenspark.functions import vcf as V

TRANSCRIPT = (
    "struct<id:string,gene_symbol:string,strand:string,sequence:string,cds_start:bigint,cds_end:bigint,exons:array<struct<number:int,start:bigint,end:bigint>>>"
)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """acc, note and seq (upper case) of every record; a record is one row, records are split between tasks."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "\r", "")
    body = F.when(F.instr("r", "\n") > 0, F.substr("r", F.instr("r", "\n") + 1)).otherwise("")
    return raw.select(F.substring_index(head, " ", 1).alias("acc"), F.when(F.instr(head, " ") > 0, F.substr(head, F.instr(head, " ") + 1)).otherwise("").alias("note"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records: chrom, pos, id, ref, alt (array), qual, filter, info (map), samples (array); lines that are none are left out."""
    return spark.read.text(path).select(V.parse_line(F.col("value")).alias("r")).where("r IS NOT NULL").select("r.*")


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, id and text of the ## lines."""
    lines = spark.read.text(path).where(F.col("value").startswith("##"))
    return lines.select(F.regexp_extract("value", r"^##([^=]+)=", 1).alias("kind"), F.nullif(F.regexp_extract("value", r"<ID=([^,>]+)", 1), F.lit("")).alias("id"), F.col("value").alias("text"))


def attributes(text: Column) -> Column:
    """The ninth column as a map: key=value;... or key "value"; ... The first of equal keys counts."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.when(x.rlike('^[^ =]+ "'), F.struct(F.regexp_extract(x, "^([^ ]+)", 1).alias("k"), F.regexp_extract(x, '"([^"]*)"', 1).alias("v"))).otherwise(
        F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).otherwise("").alias("v"))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """seqid, type, lo and hi (1-based, inclusive), strand, attrs of GFF3 and GTF rows; ill-formed rows have a problem."""
    f = F.split("value", "\t")
    get = lambda i: F.try_element_at(f, F.lit(i + 1))
    lo, hi = get(3).try_cast("long"), get(4).try_cast("long")
    problem = F.when(F.size(f) != 9, "columns").when(lo.isNull() | hi.isNull(), "position").when(lo > hi, "order").when(~get(6).isin("+", "-", ".", "?"), "strand")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(get(0).alias("seqid"), get(2).alias("type"), lo.alias("lo"), hi.alias("hi"), get(6).alias("strand"), attributes(F.coalesce(get(8), F.lit(""))).alias("attrs"), problem.alias("problem"))


def transcripts(features: DataFrame) -> DataFrame:
    """tx, gene, seqid, strand, exons (array of struct(number, lo, hi) in transcript order), cds_lo, cds_hi of annotation()
    rows. Exons are the exon rows, else UTR and CDS rows joined where they touch, else the CDS rows; without any, none."""
    fine = features.where("problem IS NULL")
    tx = F.coalesce(F.try_element_at("attrs", F.lit("transcript_id")), F.regexp_replace(F.try_element_at("attrs", F.lit("Parent")), "^(rna|transcript)[-:]", ""))
    gene = F.coalesce(F.try_element_at("attrs", F.lit("gene_name")), F.try_element_at("attrs", F.lit("gene_id")), F.try_element_at("attrs", F.lit("gene")))
    part = fine.where(F.col("type").isin("exon", "CDS", "UTR", "five_prime_UTR", "three_prime_UTR")).select(tx.alias("tx"), gene.alias("gene"), "seqid", "strand", "type", "lo", "hi").where("tx IS NOT NULL")
    span = F.struct("lo", "hi")
    # one group is one transcript's features
    got = part.groupBy("tx", "seqid", "strand").agg(
        F.max("gene").alias("gene"), F.array_sort(F.collect_set(F.when(F.col("type") == "exon", span))).alias("exon"), F.array_sort(F.collect_set(F.when(F.col("type") != "exon", span))).alias("other"),
        F.min(F.when(F.col("type") == "CDS", F.col("lo"))).alias("cds_lo"), F.max(F.when(F.col("type") == "CDS", F.col("hi"))).alias("cds_hi"))
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def touch(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (x["lo"] <= last["hi"] + 1), joined).otherwise(F.concat(done, F.array(x)))

    exons = F.when(F.size("exon") > 0, F.col("exon")).otherwise(F.aggregate("other", empty, touch))
    ordered = F.when(F.col("strand") == "-", F.reverse(exons)).otherwise(exons)
    numbered = F.transform(ordered, lambda x, i: F.struct((i + 1).alias("number"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    return got.select("tx", "gene", "seqid", "strand", numbered.alias("exons"), "cds_lo", "cds_hi")


def problems(features: DataFrame) -> DataFrame:
    return features.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def chains(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of UCSC chains: chain, score, t_name, q_name, q_strand, q_size, t_lo, t_hi, t0, t1, q0. A chain is one row of
    text up to a blank line; its blocks' starts are running sums."""
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"(?m)^#.*\n?", "").alias("r"))
    lines = F.filter(F.transform(F.split("r", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.split(F.element_at("lines", 1), r"\s+")
    raw = raw.select(lines.alias("lines")).where("size(lines) > 0 AND lines[0] LIKE 'chain %'")
    n = lambda i: F.element_at("h", i + 1).try_cast("long")
    rows = raw.select(head.alias("h"), F.transform(F.slice("lines", 2, 1 << 30), lambda x: F.transform(F.split(x, r"\s+"), lambda y: y.cast("long"))).alias("b"))
    start = F.struct(n(5).alias("t"), n(10).alias("q"), F.array().cast("array<struct<t0:bigint,t1:bigint,q0:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        size, dt, dq = F.element_at(b, 1), F.coalesce(F.try_element_at(b, F.lit(2)), F.lit(0)), F.coalesce(F.try_element_at(b, F.lit(3)), F.lit(0))
        block = F.struct(acc["t"].alias("t0"), (acc["t"] + size).alias("t1"), acc["q"].alias("q0"))
        return F.struct((acc["t"] + size + dt).cast("long").alias("t"), (acc["q"] + size + dq).cast("long").alias("q"), F.concat(acc["out"], F.array(block)).alias("out"))

    blocks = F.aggregate("b", start, step, lambda acc: acc["out"])
    out = rows.select(n(12).alias("chain"), n(1).alias("score"), F.element_at("h", 3).alias("t_name"), F.element_at("h", 8).alias("q_name"), F.element_at("h", 10).alias("q_strand"), n(8).alias("q_size"), n(5).alias("t_lo"), n(6).alias("t_hi"), F.explode(blocks).alias("x"))
    return out.select("chain", "score", "t_name", "q_name", "q_strand", "q_size", "t_lo", "t_hi", "x.*")


def assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """name, molecule, genbank, refseq and ucsc of an NCBI assembly report; na is null."""
    f = F.split("value", "\t")
    get = lambda i: F.nullif(F.trim(F.try_element_at(f, F.lit(i + 1))), F.lit("na"))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(get(0).alias("name"), get(2).alias("molecule"), get(4).alias("genbank"), get(6).alias("refseq"), get(9).alias("ucsc"))


def transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a transcript of a JSON file that is an array of them, or an object with transcripts. Unknown keys of the object
    are an error."""
    return transcripts_of_documents(spark.read.option("wholetext", True).text(path), "value")


def transcripts_of_documents(docs: DataFrame, column: str) -> DataFrame:
    """transcript_json() of a column of such documents."""
    text = docs.select(F.trim(column).alias("v"))
    known = F.array(F.lit("transcripts"), F.lit("proteins"), F.lit("genomic_sequences"))
    odd = F.array_except(F.json_object_keys("v"), known)
    checked = text.select(F.when(~F.col("v").startswith("[") & (F.size(odd) > 0), F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(odd, ", "))).cast("string")).otherwise(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.transcripts"))).alias("v"))
    return checked.select(F.explode(F.from_json("v", f"array<{TRANSCRIPT}>")).alias("t")).select("t.*")


def cdot(spark: SparkSession, path: str, build: str) -> DataFrame:
    """tx, gene, contig, strand, number, t0, t1, x0, x1 (0-based half-open) of the exons that a cdot JSON file places on a build;
    it gives exons as [genome start, genome end, number, transcript start (1-based), transcript end, gap]."""
    return exons_of_documents(spark.read.option("wholetext", True).text(path), "value", build)


def exons_of_documents(docs: DataFrame, column: str, build: str) -> DataFrame:
    """cdot() of a column of such documents."""
    kind = "struct<transcripts:map<string,struct<gene_name:string,genome_builds:map<string,struct<contig:string,strand:string,exons:array<array<string>>>>>>>"
    text = docs.select(F.from_json(column, kind)["transcripts"].alias("t"))
    each = text.select(F.explode("t").alias("tx", "r")).select("tx", F.col("r.gene_name").alias("gene"), F.try_element_at("r.genome_builds", F.lit(build)).alias("b")).where("b IS NOT NULL")
    n = lambda i: F.element_at("e", i + 1).cast("long")
    rows = each.select("tx", "gene", F.col("b.contig").alias("contig"), F.when(F.col("b.strand") == "-", -1).otherwise(1).alias("strand"), F.explode("b.exons").alias("e"))
    return rows.select("tx", "gene", "contig", "strand", (n(2) + 1).cast("int").alias("number"), (n(3) - 1).alias("t0"), n(4).alias("t1"), n(0).alias("x0"), n(1).alias("x1"))


def fasta_chunks(spark: SparkSession, path: str, size: int = 64) -> DataFrame:
    """acc, chunk and bases (size of them, upper case) of FASTA records of any length, as lookups.window() reads them.

    Lines are numbered inside their split of the file; what a record already has in the splits before is a running sum over
    one row a split. So neither a record nor a file is ever in one task."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.rtrim("value").alias("v"))
    name = F.when(F.col("v").startswith(">"), F.substring_index(F.substr("v", F.lit(2)), " ", 1))
    lines = lines.withColumns({"_name": name, "_n": F.when(name.isNull(), F.length("v")).otherwise(0)})
    here = Window.partitionBy("file", "block").orderBy("i")
    lines = lines.withColumns({"_acc": F.last("_name", ignorenulls=True).over(here), "_part": F.count("_name").over(here)})
    own = Window.partitionBy("file", "block", "_part").orderBy("i")
    lines = lines.withColumn("_before", F.sum("_n").over(own) - F.col("_n"))
    # what each split leaves to the next: its last record, and how many bases that has so far
    ends = lines.groupBy("file", "block").agg(F.max_by("_acc", "i").alias("_last"), F.max("_part").alias("_p"), F.max_by(F.col("_before") + F.col("_n"), "i").alias("_tail"))
    splits = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("_run", F.sum((F.col("_p") > 0).cast("int")).over(splits))
    since = Window.partitionBy("file", "_run").orderBy("block")
    ends = ends.withColumns({"_sum": F.sum("_tail").over(since), "_from": F.first("_last").over(since)})
    carry = ends.select("file", "block", F.lag("_from").over(splits).alias("_carried"), F.lag("_sum").over(splits).alias("_held"))
    rows = lines.where("_n > 0").join(carry, ["file", "block"])
    first = F.col("_part") == 0  # goes on with the record of the split before
    placed = rows.select(F.when(first, F.col("_carried")).otherwise(F.col("_acc")).alias("acc"), (F.col("_before") + F.when(first, F.coalesce("_held", F.lit(0))).otherwise(0)).alias("at"), F.upper("v").alias("v"))
    last = F.floor((F.col("at") + F.length("v") - 1) / size)
    cut = placed.where("acc IS NOT NULL").select("acc", "at", "v", F.explode(F.sequence(F.floor(F.col("at") / size), last)).alias("chunk"))
    start = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
    piece = F.substring("v", (start + 1).cast("int"), ((F.col("chunk") + 1) * size - F.greatest(F.col("at"), F.col("chunk") * size)).cast("int"))
    pieces = cut.select("acc", F.col("chunk").cast("int").alias("chunk"), F.struct("at", piece.alias("b")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort("ps"), lambda x: x["b"]), "")
    return pieces.groupBy("acc", "chunk").agg(F.collect_list("p").alias("ps")).select("acc", "chunk", joined.alias("bases"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """kind and path of the files that a reference manifest lists: its transcript_fastas, genome_fasta and cdot_json."""
    kind = "struct<transcript_fastas:array<string>,genome_fasta:string,cdot_json:string>"
    m = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind).alias("m"))
    each = F.concat(
        F.transform(F.coalesce("m.transcript_fastas", F.array().cast("array<string>")), lambda x: F.struct(F.lit("transcripts").alias("kind"), x.alias("path"))),
        F.array(F.struct(F.lit("genome").alias("kind"), F.col("m.genome_fasta").alias("path")), F.struct(F.lit("cdot").alias("kind"), F.col("m.cdot_json").alias("path"))),
    )
    return m.select(F.explode(each).alias("x")).select("x.*").where("path IS NOT NULL")


def manifest_chunks(spark: SparkSession, path: str, size: int = 64) -> DataFrame:
    """fasta_chunks() of all sequence files of a manifest; paths that are none of their own lie beside it."""
    base = path.rsplit("/", 1)[0]
    files = [r.path if "/" in r.path else f"{base}/{r.path}" for r in manifest(spark, path).where("kind <> 'cdot'").collect()]  # a handful of names
    out = fasta_chunks(spark, files[0], size)
    for f in files[1:]:
        out = out.union(fasta_chunks(spark, f, size))
    return out


def refseqgene(spark: SparkSession, path: str) -> DataFrame:
    """gene, ng, lrg, tx, selector (t1) and protein of a RefSeqGene summary: tab-separated tax_id, GeneID, Symbol, RSG, LRG, RNA,
    t, Protein, p, Category."""
    f = F.split("value", "\t")
    get = lambda i: F.nullif(F.nullif(F.trim(F.try_element_at(f, F.lit(i + 1))), F.lit("")), F.lit("-"))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(get(2).alias("gene"), get(3).alias("ng"), get(4).alias("lrg"), get(5).alias("tx"), get(6).alias("selector"), get(7).alias("protein")).where("ng IS NOT NULL")


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """acc, length, genes, transcripts, cds_lo, cds_hi (1-based, of the first CDS) and seq of GenBank flat records, which // ends;
    a record is one row."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"^\s+", "").alias("r")).where("r LIKE 'LOCUS%'")
    all_of = lambda p: F.array_distinct(F.regexp_extract_all("r", F.lit(p), F.lit(1)))
    one = lambda p, i=1: F.nullif(F.regexp_extract("r", p, i), F.lit(""))
    origin = F.when(F.instr("r", "ORIGIN") > 0, F.substr("r", F.instr("r", "ORIGIN") + 6)).otherwise("")
    place = r"(?m)^     CDS +\D*(\d+)(?:[^\n]*?\.\.>?(\d+))\D*$"
    return raw.select(
        one(r"(?m)^VERSION +(\S+)").alias("acc"), one(r"(?m)^LOCUS +\S+ +(\d+) bp").cast("long").alias("length"), all_of('/gene="([^"]+)"').alias("genes"), all_of('/transcript_id="([^"]+)"').alias("transcripts"),
        one(place).cast("long").alias("cds_lo"), one(place, 2).cast("long").alias("cds_hi"), F.upper(F.regexp_replace(origin, r"[\s\d]", "")).alias("seq"),
    )


def rs_records(records: DataFrame) -> DataFrame:
    """rs, chrom, pos, ref and alt, one row an alternative and rs number, of vcf() records whose ids name them."""
    ids = F.filter(F.split(F.coalesce("id", F.lit("")), ";"), lambda x: x.rlike("^rs[0-9]+$"))
    each = records.select(F.explode(ids).alias("name"), "chrom", "pos", "ref", "alt")
    return each.select(F.substr("name", F.lit(3)).cast("long").alias("rs"), "chrom", "pos", "ref", F.explode("alt").alias("alt"))
