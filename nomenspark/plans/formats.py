"""Queries over text formats, the full grammar and streams, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nomenspark import corpus, streaming
from nomenspark.functions import grammar
from nomenspark.operators import coordinates as C
from nomenspark.sources import genomics as G
from nomenspark.sources import sinks, text

from .effect import CONTIGS, placed
from .registry import Registry
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table


@query("a1_clean_lines", "SELECT vid, description AS text FROM variants WHERE vid % 3 <> 0", "variants")
def a1(spark, d):
    """Lines with comments, white space and byte-order marks, a third of them blank or comment only."""
    line = F.when(c("vid") % 3 == 0, F.when(c("vid") % 2 == 0, "   ").otherwise("# note")).when(c("vid") % 3 == 1, F.concat(F.lit(text.BOM + "  "), "description", F.lit("  # note"))).otherwise(F.concat("description", F.lit("\t")))
    return variants(spark, d).select("vid", text.cleaned(line).alias("text")).where("text IS NOT NULL")


@query("a7_attributes", "SELECT vid, acc AS id, axis AS note, 'first' AS tag FROM variants", "variants")
def a7(spark, d):
    """Attribute columns of both spellings."""
    gff = F.concat(F.lit("ID="), "acc", F.lit(";Note="), "axis", F.lit(";tag=first;tag=second"))
    gtf = F.concat(F.lit('ID "'), "acc", F.lit('"; Note "'), "axis", F.lit('"; tag "first"; tag "second";'))
    x = variants(spark, d).select("vid", G.attributes(F.when(c("vid") % 2 == 0, gff).otherwise(gtf)).alias("m"))
    return x.select("vid", F.element_at("m", "ID").alias("id"), F.element_at("m", "Note").alias("note"), F.element_at("m", "tag").alias("tag"))


@query("a13_consequence_fields", "SELECT vid, unnest(list_distinct([acc, concat('NP', vid % 2)])) AS field FROM variants", "variants")
def a13(spark, d):
    info = F.concat(F.lit("DP=3;CSQ=x|"), "acc", F.lit("|y,x|NP"), (c("vid") % 2).cast("string"), F.lit("|,x||z"))
    return variants(spark, d).select("vid", F.explode(text.consequence_fields(info, "CSQ", 1)).alias("field"))


@query("w1_transcripts_from_features", """SELECT tx, count(*)::INT AS n, min(x0) + 1 AS lo, max(x1) AS hi, CASE WHEN strand = 1 THEN min(x0) + 1 ELSE max(CASE WHEN number = 1 THEN x0 END) + 1 END AS first FROM (SELECT DISTINCT * FROM exons) GROUP BY tx, contig, strand""", "exons")
def w1(spark, d):
    """Exons as feature rows, back to transcripts."""
    row = F.struct(c("contig").alias("seqid"), F.lit("exon").alias("type"), (c("x0") + 1).alias("lo"), c("x1").alias("hi"), F.when(c("strand") == 1, "+").otherwise("-").alias("strand"), F.create_map(F.lit("transcript_id"), c("tx")).alias("attrs"), F.lit(None).cast("string").alias("problem"))
    x = G.transcripts(t(spark, d, "exons").select(row.alias("r")).select("r.*"))
    return x.select("tx", F.size("exons").alias("n"), F.array_min(F.transform("exons", lambda e: e["lo"])).alias("lo"), F.array_max(F.transform("exons", lambda e: e["hi"])).alias("hi"), F.element_at("exons", 1)["lo"].alias("first"))


@query("w6_spliced_length", "SELECT tx, sum(t1 - t0)::BIGINT AS length, count(*) AS exons FROM exons GROUP BY tx", "exons")
def w6(spark, d):
    return t(spark, d, "exons").groupBy("tx").agg(F.sum(c("t1") - c("t0")).alias("length"), F.count("*").alias("exons"))


@query("w4_anomalies", "SELECT sum(CASE WHEN (cds_end - cds_start + 1) % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS not_codons, count(*) FILTER (cds_start IS NULL) AS noncoding, count(*) FILTER (cds_end > len1 + len2 + len3) AS past_end FROM transcripts", "transcripts")
def w4(spark, d):
    x = t(spark, d, "transcripts")
    return x.agg(F.sum(F.when((c("cds_end") - c("cds_start") + 1) % 3 != 0, 1).otherwise(0)).alias("not_codons"), F.count_if(c("cds_start").isNull()).alias("noncoding"), F.count_if(c("cds_end") > c("len1") + c("len2") + c("len3")).alias("past_end"))


@query("w8_identity", """, h AS (SELECT sha256(concat(acc, ':', seq)) AS h FROM sequences)
SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS total, bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS mixed FROM h""", "sequences")
def w8(spark, d):
    """Whether two sets of sequences are the same, whatever their order: sums and exclusive ors of digest parts."""
    h = F.sha2(F.concat_ws(":", "acc", "seq"), 256)
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    each = t(spark, d, "sequences").select(h.alias("h")).select(part(1).alias("a"), part(16).alias("b"))
    return each.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("b").alias("mixed"))


@query("b2_result_rows", "SELECT vid AS line, description AS input, CASE WHEN vid % 4 = 0 THEN '' ELSE description END AS normalized, false AS changed, CASE WHEN vid % 4 = 0 THEN 'parse_error' ELSE 'ok' END AS status, '' AS detail FROM variants", "variants")
def b2(spark, d):
    x = variants(spark, d).select(c("vid").alias("line"), c("description").alias("input"), c("description").alias("normalized"), F.when(c("vid") % 4 == 0, "parse_error").alias("error"), F.lit(None).cast("string").alias("detail"))
    return sinks.result_rows(x)


_ALLELE = "edit IN ('del', 'dup', 'sub') AND axis IN ('g', 'c')"


@query("c13_alleles", f"""SELECT vid, CASE vid % 3 WHEN 0 THEN 'cis' WHEN 1 THEN 'trans' ELSE 'unknown' END AS phase, unnest([1, 2])::INT AS member, acc AS accession, unnest([s, e + 9])::VARCHAR AS start, unnest([edit, 'del']) AS edit FROM variants WHERE {_ALLELE}""", "variants")
def c13(spark, d):
    """Two members in one allele, in two, or of unknown phase."""
    body = F.expr("substr(description, length(acc) + 4)")
    other = F.concat((c("e") + 9).cast("string"), F.lit("del"))
    head = F.concat("acc", F.lit(":"), "axis", F.lit("."))
    allele = F.when(c("vid") % 3 == 0, F.concat(head, F.lit("["), body, F.lit(";"), other, F.lit("]"))).when(c("vid") % 3 == 1, F.concat(head, F.lit("["), body, F.lit("];["), other, F.lit("]"))).otherwise(F.concat(head, body, F.lit("(;)"), other))
    x = variants(spark, d).where(_ALLELE).select("vid", allele.alias("text"))
    p = grammar.parse_all(x, "vid", "text").select("vid", "phase", F.posexplode_outer("members").alias("member", "m"))
    return p.select("vid", "phase", (c("member") + 1).cast("int").alias("member"), "m.accession", "m.start", "m.edit")


@query("c4_full_grammar", "SELECT edit, count(*) AS n, count(*) AS same FROM (SELECT CASE WHEN edit = 'missense' THEN 'sub' ELSE edit END AS edit FROM variants) GROUP BY edit", "variants")
def c4(spark, d):
    p = grammar.parse_all(variants(spark, d), "vid", "description")
    return p.groupBy(F.element_at("members", 1)["edit"].alias("edit")).agg(F.count("*").alias("n"), F.count_if(c("canonical") == c("description")).alias("same"))


@query("c11_protein_forms", """SELECT vid, x.edit AS edit, x.n AS count FROM (SELECT vid, unnest([{'edit': 'frameshift', 'n': (2 + s % 30)::VARCHAR}, {'edit': 'del', 'n': ''}, {'edit': 'repeat', 'n': '7'}, {'edit': 'identity', 'n': ''}]) AS x FROM variants WHERE edit = 'missense')""", "variants")
def c11(spark, d):
    at = F.concat("ref", c("s").cast("string"))
    head = F.concat("acc", F.lit(":p."))
    forms = F.array(F.concat(head, at, F.when(c("ref") == c("alt"), "").otherwise(c("alt")), F.lit("fsTer"), (2 + c("s") % 30).cast("string")), F.concat(head, at, F.lit("del")), F.concat(head, at, F.lit("[7]")), F.concat(head, F.lit("=")))
    x = variants(spark, d).where("edit = 'missense'").select("vid", F.explode(forms).alias("text"))
    p = grammar.parse_all(x, "vid", "text")
    return p.select("vid", F.element_at("members", 1)["edit"].alias("edit"), F.element_at("members", 1)["count"].alias("count"))


@query("g_errors_as_data", "SELECT 'insertion at one position' AS error, count(*) AS n, min(length(acc) + 6 + length(s::VARCHAR)) AS first FROM variants WHERE edit = 'ins'", "variants")
def g_errors(spark, d):
    x = variants(spark, d).where("edit = 'ins'").select("vid", F.expr("concat(acc, ':', axis, '.', s, 'insA')").alias("text"))
    return grammar.parse_all(x, "vid", "text").groupBy("error").agg(F.count("*").alias("n"), F.min("error_at").cast("long").alias("first"))


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset, a temporary folder."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="nomenspark-stream-")


@query("x4_stream")
def x4(spark, d):
    """Descriptions written as files of lines, read as a stream, and the categories of what the stream wrote."""
    base = shared_folder(spark)
    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    sinks.write_text(variants(spark, d), "description", f"{root}/in")
    streaming.write(streaming.described(streaming.read_lines(spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("category").agg(F.count("*").alias("n"))


ORACLE["x4_stream"] = corpus.with_tables("variants") + """SELECT CASE WHEN axis = 'g' THEN CASE edit WHEN 'sub' THEN 'genomic_snv' ELSE concat('genomic_', edit) END
  WHEN axis = 'c' THEN CASE edit WHEN 'sub' THEN 'coding_snv' WHEN 'delins' THEN 'coding_del' WHEN 'inv' THEN 'other' ELSE concat('coding_', edit) END
  WHEN axis = 'p' THEN 'protein_sub' ELSE 'noncoding' END AS category, count(*) AS n FROM variants GROUP BY 1"""


@query("q9_multi_isoform", CONTIGS + """, r AS (SELECT vid, accession AS contig, 1000 + pos % 92000 AS g FROM vcf JOIN contigs USING (chrom))
SELECT r.vid, gene, e.tx, t0 + 1 + CASE WHEN e.strand = 1 THEN g - 1 - x0 ELSE x1 - g END AS n FROM r JOIN exons e ON r.contig = e.contig AND g - 1 >= x0 AND g - 1 < x1 JOIN transcripts x ON x.tx = e.tx WHERE cds_start IS NOT NULL""", "vcf", "exons", "transcripts")
def q9(spark, d):
    """Records on every coding transcript with an exon there, whether their contigs are named with chr or without."""
    points = placed(spark, t(spark, d, "vcf")).where("accession IS NOT NULL").select("vid", c("accession").alias("contig"), (1000 + c("pos") % 92000).alias("g"))
    x = C.genome_to_tx(points, t(spark, d, "exons"))
    return x.join(t(spark, d, "transcripts").where("cds_start IS NOT NULL").select("tx", "gene"), "tx").select("vid", "gene", "tx", "n")
