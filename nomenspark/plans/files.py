"""Queries over files in the formats that the readers and writers know: written to the shared folder, and read from there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import grammar
from nomenspark.operators import contigs as K
from nomenspark.sources import genomics as G
from nomenspark.sources import sinks
from nomenspark.sources import text as X

from .formats import shared_folder
from .genomics import hits
from .registry import Registry
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table


def folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def written(spark, df, column: str = "line") -> str:
    """Where the rows of text lie, in files of their own."""
    path = folder(spark)
    sinks.write_text(df, column, path)
    return path


def one_file(spark, lines: list[str]) -> str:
    path = folder(spark)
    sinks.write_text(spark.createDataFrame([(1, "\n".join(lines))], "n int, line string").coalesce(1), "line", path)
    return path


@query("a2_record_file", "SELECT chrom, pos, ref, alt, CASE WHEN alt2 = '' THEN 1 ELSE 2 END AS n_alt, (dp + 1)::VARCHAR AS dp, CASE WHEN filter = '.' THEN NULL ELSE filter END AS filter FROM vcf", "vcf")
def a2(spark, d):
    """Records of a file, each with an INFO key twice, of which the last counts."""
    alt = F.when(c("alt2") == "", c("alt")).otherwise(F.concat_ws(",", "alt", "alt2"))
    info = F.concat(F.lit("DP="), c("dp").cast("string"), F.lit(";DB;DP="), (c("dp") + 1).cast("string"))
    line = F.concat_ws("\t", "chrom", c("pos").cast("string"), F.lit("."), "ref", alt, F.lit("."), "filter", info)
    path = written(spark, t(spark, d, "vcf").select(line.alias("line")).union(spark.createDataFrame([("##fileformat=VCFv4.3",), ("#CHROM\tPOS",), ("not a record",)], "line string")))
    x = G.vcf(spark, path)
    return x.select("chrom", "pos", "ref", F.element_at("alt", 1).alias("alt"), F.size("alt").alias("n_alt"), F.element_at("info", "DP").alias("dp"), "filter")


def fasta_files(spark, d, lines: int = 60) -> str:
    cut = F.regexp_replace("seq", f"(.{{{lines}}})", "$1\n")
    return written(spark, t(spark, d, "tx_seqs").select(F.concat(F.lit(">"), "tx", F.lit(" a note\n"), F.rtrim(F.lower(cut))).alias("line")))


@query("a4_fasta", "SELECT tx AS acc, 'a note' AS note, seq FROM tx_seqs", "tx_seqs")
def a4(spark, d):
    return G.fasta(spark, fasta_files(spark, d))


@query("a4_fasta_chunks", "SELECT tx AS acc, i::INT AS chunk, substr(seq, 64 * i + 1, 64) AS bases FROM (SELECT tx, seq, unnest(range(0, (length(seq) + 63) // 64)) AS i FROM tx_seqs)", "tx_seqs")
def a4c(spark, d):
    """Chunks by line, wherever a file is split."""
    return G.fasta_chunks(spark, fasta_files(spark, d))


@query("a5_manifest", "SELECT tx AS acc, i::INT AS chunk, substr(seq, 64 * i + 1, 64) AS bases FROM (SELECT tx, seq, unnest(range(0, (length(seq) + 63) // 64)) AS i FROM tx_seqs) UNION ALL SELECT 'chrT', 0, 'ACGTACGT'", "tx_seqs")
def a5(spark, d):
    """Sequences of all files that a manifest lists."""
    listed = {"transcript_fastas": [fasta_files(spark, d)], "genome_fasta": one_file(spark, [">chrT test", "ACGT", "acgt"]), "cdot_json": "none.json", "transcript_count": 1}
    return G.manifest_chunks(spark, one_file(spark, [json.dumps(listed)]))


@query("a6_cdot", "SELECT tx, gene, contig, strand, number, t0, t1, x0, x1 FROM exons JOIN (SELECT tx, gene FROM transcripts) USING (tx)", "exons", "transcripts")
def a6(spark, d):
    """Exons as cdot documents have them, one a transcript."""
    ex = F.concat(F.lit("["), F.concat_ws(",", "x0", "x1", c("number") - 1, c("t0") + 1, "t1", F.lit("null")), F.lit("]"))
    g = t(spark, d, "exons").join(t(spark, d, "transcripts").select("tx", "gene"), "tx")
    g = g.groupBy("tx", "gene", "contig", "strand").agg(F.array_join(F.array_sort(F.collect_list(ex)), ",").alias("e"))  # three exons
    sign = F.when(c("strand") == 1, "+").otherwise("-")
    doc = F.format_string('{"transcripts":{"%s":{"gene_name":"%s","genome_builds":{"GRCh38":{"contig":"%s","strand":"%s","exons":[%s]}}}}}', "tx", "gene", "contig", sign, "e")
    return G.exons_of_documents(g.select(doc.alias("doc")), "doc", "GRCh38")


@query("a8_transcript_json", "SELECT tx AS id, gene AS gene_symbol, seq AS sequence, cds_start, cds_end FROM tx_seqs", "tx_seqs")
def a8(spark, d):
    """Objects of transcripts and bare arrays."""
    one = F.to_json(F.struct(c("tx").alias("id"), c("gene").alias("gene_symbol"), c("seq").alias("sequence"), "cds_start", "cds_end"))
    doc = F.when(c("k") % 2 == 0, F.concat(F.lit('{"transcripts":['), one, F.lit("]}"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    return G.transcripts_of_documents(t(spark, d, "tx_seqs").select(doc.alias("doc")), "doc").select("id", "gene_symbol", "sequence", "cds_start", "cds_end")


@query("a9_chain_file", "SELECT chain, score, t_name, q_name, q_strand, q_size, t_lo, t_lo + 2900 AS t_hi, t0, t1, q0 FROM chain_blocks", "chain_blocks")
def a9(spark, d):
    """Chains of three blocks with gaps of 100 and 50 bases."""
    x = t(spark, d, "chain_blocks").groupBy("chain", "score", "t_name", "q_name", "q_strand", "q_size", "t_lo").agg(F.min("q0").alias("q"))
    head = F.concat_ws(" ", F.lit("chain"), "score", "t_name", F.lit("200000 +"), "t_lo", c("t_lo") + 2900, "q_name", "q_size", "q_strand", "q", c("q") + 2800, "chain")
    return G.chains(spark, written(spark, x.select(F.concat(head, F.lit("\n900 100 50\n900 100 50\n900\n")).alias("line"))))


_REPORT = [f"{n}\tassembled-molecule\t{n}\tChromosome\tCM0006{62 + i}.{v}\t=\tNC_{i:06d}.{w}\tPrimary Assembly\t1000\tchr{n}" for i, n, v, w in ((1, "1", 2, 11), (2, "2", 2, 12), (23, "X", 2, 11))] + ["HSCHR1_CTG1\tunlocalized-scaffold\t1\tChromosome\tKI270706.1\t=\tna\tPrimary Assembly\t175055\tna"]


@query("a10_assembly_report", "SELECT * FROM (VALUES ('GRCh38', '1', 'NC_000001.11'), ('GRCh38', 'chr1', 'NC_000001.11'), ('GRCh38', 'CM000663.2', 'NC_000001.11'), ('GRCh38', '2', 'NC_000002.12'), ('GRCh38', 'chr2', 'NC_000002.12'), ('GRCh38', 'CM000664.2', 'NC_000002.12'), ('GRCh38', 'X', 'NC_000023.11'), ('GRCh38', 'chrX', 'NC_000023.11'), ('GRCh38', 'CM000685.2', 'NC_000023.11')) x(build, name, accession)")
def a10(spark, d):
    """A report's names as aliases."""
    return K.report_aliases(G.assembly_report(spark, one_file(spark, ["# Sequence-Name\tSequence-Role", *_REPORT])), "GRCh38")


@query("a11_export", "SELECT DISTINCT description AS text FROM variants UNION SELECT 'NM_000001.1:c.1A>G'", "variants")
def a11(spark, d):
    """Descriptions of two columns, several in one."""
    line = F.concat_ws("\t", *[F.lit("x")] * 6, F.concat("description", F.lit("|no description")), F.lit("x"), F.when(c("vid") % 2 == 0, "NM_000001.1:c.1A>G").otherwise("-"))
    return X.clinvar_export(spark, written(spark, variants(spark, d).select(line.alias("line")).union(spark.createDataFrame([("#header",)], "line string"))))


@query("a12_json_layouts", "SELECT vid, description AS text FROM variants", "variants")
def a12(spark, d):
    one = F.to_json(F.array("description"))
    objects = F.to_json(F.array(F.struct(c("description").alias("input"))))
    given = F.when(c("vid") % 3 == 0, one).when(c("vid") % 3 == 1, objects).otherwise(F.concat(F.lit('{"patterns":'), one, F.lit("}")))
    return variants(spark, d).select("vid", F.explode(X.json_patterns(given)).alias("text"))


@query("a14_gene_summary", "SELECT gene, concat('NG_', lpad(k::VARCHAR, 6, '0'), '.1') AS ng, CASE WHEN k % 2 = 0 THEN concat('LRG_', k) END AS lrg, tx, CASE WHEN k % 2 = 0 THEN 't1' END AS selector FROM transcripts", "transcripts")
def a14(spark, d):
    even = c("k") % 2 == 0
    line = F.concat_ws("\t", F.lit("9606"), "k", "gene", F.concat(F.lit("NG_"), F.lpad(c("k").cast("string"), 6, "0"), F.lit(".1")), F.when(even, F.concat(F.lit("LRG_"), "k")).otherwise(""), "tx", F.when(even, "t1").otherwise(""), F.lit("-"), F.lit(""), F.lit("reference standard"))
    return G.refseqgene(spark, written(spark, t(spark, d, "transcripts").select(line.alias("line")))).drop("protein")


@query("a14_flat_records", "SELECT tx AS acc, len AS length, gene AS first_gene, tx AS first_tx, coalesce(cds_start, 1) AS cds_lo, coalesce(cds_end, 9) AS cds_hi, seq FROM tx_seqs", "tx_seqs")
def a14g(spark, d):
    lower = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n  61 ")
    text = F.format_string(
        'LOCUS       %s %d bp    mRNA    linear   PRI\nVERSION     %s\nFEATURES             Location/Qualifiers\n     gene            1..%d\n                     /gene="%s"\n     CDS             %d..%d\n                     /gene="%s"\n                     /transcript_id="%s"\nORIGIN\n   1 %s\n//',
        "tx", "len", "tx", "len", "gene", F.coalesce("cds_start", F.lit(1)), F.coalesce("cds_end", F.lit(9)), "gene", "tx", lower,
    )
    x = G.genbank(spark, written(spark, t(spark, d, "tx_seqs").select(text.alias("line"))))
    return x.select("acc", "length", F.element_at("genes", 1).alias("first_gene"), F.element_at("transcripts", 1).alias("first_tx"), "cds_lo", "cds_hi", "seq")


@query("a15_rs_file", "SELECT rs, chrom, pos, ref, alt FROM rsids UNION ALL SELECT rs + 1000000, chrom, pos, ref, alt FROM rsids WHERE rs % 2 = 0", "rsids")
def a15(spark, d):
    """Numbers of a file of known changes, two of some records."""
    name = F.concat(F.lit("rs"), c("rs").cast("string"))
    ids = F.when(c("rs") % 2 == 0, F.concat(name, F.lit(";rs"), (c("rs") + 1000000).cast("string"), F.lit(";other"))).otherwise(name)
    line = F.concat_ws("\t", "chrom", c("pos").cast("string"), ids, "ref", "alt", F.lit("."), F.lit("."), F.lit("."))
    return G.rs_records(G.vcf(spark, written(spark, t(spark, d, "rsids").select(line.alias("line")))))


@query("b1_result_lines", "SELECT vid AS line, description AS input, 'ok' AS status FROM variants", "variants")
def b1(spark, d):
    """Results as JSON lines, read again."""
    path = folder(spark)
    sinks.write_json(variants(spark, d).select(c("vid").alias("line"), c("description").alias("input"), F.lit("ok").alias("status")), path)
    return spark.read.schema("line long, input string, status string").json(path)


@query("b2_summary", "SELECT count(*) AS total, count(*) FILTER (vid % 4 <> 0) AS ok, count(*) FILTER (vid % 4 = 0) AS failed, count(*) FILTER (vid % 4 = 1) AS changed FROM variants", "variants")
def b2(spark, d):
    new = F.when(c("vid") % 4 == 1, F.concat("description", F.lit("="))).otherwise(c("description"))
    x = variants(spark, d).select(c("vid").alias("line"), c("description").alias("input"), new.alias("normalized"), F.when(c("vid") % 4 == 0, "parse_error").alias("error"), F.lit(None).cast("string").alias("detail"))
    return sinks.summary(sinks.result_rows(x))


_HITS = """, h AS (SELECT DISTINCT p.vid, x.tx, x.gene, CASE WHEN x.cds_start IS NULL THEN 'non_coding_transcript_variant' ELSE 'sequence_variant' END AS term FROM points p JOIN transcripts x ON p.contig = x.contig AND g > g0 AND g <= g0 + len1 + len2 + len3 + 400)
"""


@query("q10_annotation_lists", _HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY gene, tx) AS i FROM h), g AS (SELECT vid, gene, min(i) AS i FROM r GROUP BY ALL), k AS (SELECT vid, term, min(i) AS i FROM r GROUP BY ALL)
SELECT a.vid, genes, transcripts, consequences, ann FROM (SELECT vid, string_agg(tx, ',' ORDER BY i) AS transcripts, string_agg(term || '|' || gene || '|' || tx || '|' || tx || ':c.1', ',' ORDER BY i) AS ann FROM r GROUP BY vid) a
JOIN (SELECT vid, string_agg(gene, ',' ORDER BY i) AS genes FROM g GROUP BY vid) b USING (vid) JOIN (SELECT vid, string_agg(term, ',' ORDER BY i) AS consequences FROM k GROUP BY vid) e USING (vid)""", "points", "transcripts")
def q10(spark, d):
    """What a record's INFO says of all transcripts over it: lists without repeats, in order of gene and transcript."""
    x = hits(spark, d).select("vid", "gene", "tx", F.concat("tx", F.lit(":c.1")).alias("description"), F.when(c("cds_start").isNull(), "non_coding_transcript_variant").otherwise("sequence_variant").alias("term"))
    return sinks.annotated(x, "vid").select("vid", "genes", "transcripts", "consequences", "ann")


@query("b3_annotation_values", "SELECT vid, concat(alt, '|missense_variant|MODERATE||', acc, '|', description, '|') AS ann FROM variants WHERE edit = 'sub'", "variants")
def b3(spark, d):
    none = F.lit(None).cast("string")
    v = variants(spark, d).where("edit = 'sub'")
    return v.select("vid", sinks.annotation_value(c("alt"), F.lit("missense_variant"), F.lit("MODERATE"), none, c("acc"), c("description"), none).alias("ann"))


@query("b3_header_lines", "SELECT '##INFO=<ID=GENE,Number=.,Type=String,Description=\"Genes\">' AS line UNION ALL SELECT '##INFO=<ID=ANN,Number=.,Type=String,Description=\"Annotations\">'")
def b3h(spark, d):
    path = one_file(spark, ["##fileformat=VCFv4.3", sinks.info_header("GENE", ".", "String", "Genes"), sinks.info_header("ANN", ".", "String", "Annotations"), "#CHROM\tPOS"])
    return G.vcf_header(spark, path).where("kind = 'INFO'").select(c("text").alias("line"))


@query("b5_transcripts_of_features", "SELECT tx AS id, contig_strand AS strand, 3 AS n, len1 + len2 + len3 AS spliced FROM (SELECT *, CASE WHEN strand = 1 THEN '+' ELSE '-' END AS contig_strand FROM transcripts)", "exons", "transcripts")
def b5(spark, d):
    """Feature rows as transcript JSON lines, and their exons' lengths."""
    line = F.concat_ws("\t", "contig", F.lit("src"), F.lit("exon"), c("x0") + 1, "x1", F.lit("."), F.when(c("strand") == 1, "+").otherwise("-"), F.lit("."), F.concat(F.lit("Parent=transcript:"), "tx"))
    x = G.transcripts(G.annotation(spark, written(spark, t(spark, d, "exons").select(line.alias("line")))))
    j = F.from_json(sinks.transcript_rows(x), "struct<id:string,strand:string,exons:array<struct<number:int,lo:bigint,hi:bigint>>>")
    return x.select(j.alias("j")).select("j.id", "j.strand", F.size("j.exons").alias("n"), F.aggregate("j.exons", F.lit(0).cast("long"), lambda a, e: a + e["hi"] - e["lo"] + 1).alias("spliced"))


@query("b6_timing", "SELECT tool, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM tool_runs GROUP BY tool", "tool_runs")
def b6(spark, d):
    x = t(spark, d, "tool_runs").groupBy("tool").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"), F.sum("seconds").alias("s"))
    j = F.from_json(sinks.timing_line(c("tool"), c("n"), c("k"), c("s")), "struct<operation:string,total:bigint,ok:bigint,failed:bigint>")
    return x.select(j.alias("j")).select(c("j.operation").alias("tool"), "j.total", "j.ok", "j.failed")


@query("b7_projection_lines", "SELECT vid, concat(acc, chr(9), axis, chr(9), CASE WHEN axis = 'p' THEN 'unavailable: no protein' ELSE description END) AS line FROM variants", "variants")
def b7(spark, d):
    return variants(spark, d).select("vid", sinks.projection_line(c("acc"), c("axis"), F.when(c("axis") != "p", c("description")), F.lit("no protein")).alias("line"))


@query("w2_loader_problems", "SELECT problem, count(*) AS n FROM (SELECT CASE vid % 5 WHEN 1 THEN 'columns' WHEN 2 THEN 'position' WHEN 3 THEN 'order' WHEN 4 THEN 'strand' END AS problem FROM variants) WHERE problem IS NOT NULL GROUP BY problem", "variants")
def w2(spark, d):
    """Feature rows, four fifths of them ill-formed in one way each."""
    k = c("vid") % 5
    line = F.concat_ws("\t", "acc", F.lit("src"), F.lit("exon"), F.when(k == 2, "x").otherwise(c("s").cast("string")), F.when(k == 3, "1").otherwise((c("s") + 5).cast("string")), F.lit("."), F.when(k == 4, "x").otherwise("+"), F.lit("."))
    return G.problems(G.annotation(spark, written(spark, variants(spark, d).select(F.when(k == 1, line).otherwise(F.concat(line, F.lit("\tID=1"))).alias("line")))))


@query("w10_built_transcripts", "SELECT tx, gene, contig AS seqid, min(x0) + 1 AS cds_lo, max(x1) AS cds_hi FROM exons JOIN (SELECT tx, gene FROM transcripts) USING (tx) WHERE number <> 2 GROUP BY ALL", "exons", "transcripts")
def w10(spark, d):
    """Transcripts built from CDS rows alone."""
    x = t(spark, d, "exons").where("number <> 2").join(t(spark, d, "transcripts").select("tx", "gene"), "tx")
    attrs = F.format_string('gene_id "%s"; transcript_id "%s";', "gene", "tx")
    line = F.concat_ws("\t", "contig", F.lit("src"), F.lit("CDS"), c("x0") + 1, "x1", F.lit("."), F.when(c("strand") == 1, "+").otherwise("-"), F.lit("0"), attrs)
    return G.transcripts(G.annotation(spark, written(spark, x.select(line.alias("line"))))).select("tx", "gene", "seqid", "cds_lo", "cds_hi")


# ---- forms of the grammar


def _forms(name: str, where: str, text: str, wanted: str, columns: tuple[str, ...] = ("edit",)):
    """Descriptions of one form, and what the first member has in some columns."""

    @query(name, f"SELECT vid, {wanted} FROM variants WHERE {where}", "variants")
    def run(spark, d):
        p = grammar.parse_all(variants(spark, d).where(where).select("vid", F.expr(text).alias("text")), "vid", "text")
        m = F.try_element_at("members", F.lit(1))
        return p.select("vid", *[(c(x) if x in ("phase", "error") else m[x]).alias(x) for x in columns])


_C, _G = "edit = 'del' AND axis = 'c'", "edit = 'del' AND axis = 'g'"
_forms("c7_positions", _C, "concat(acc, ':c.', CASE vid % 4 WHEN 0 THEN '-3' WHEN 1 THEN '*5' WHEN 2 THEN concat(s, '+12') ELSE concat(s, '-?') END, 'del')", "CASE vid % 4 WHEN 0 THEN '-3' WHEN 1 THEN '*5' WHEN 2 THEN concat(s, '+12') ELSE concat(s, '-?') END AS start, 'del' AS edit", ("start", "edit"))
_forms("c8_uncertain_ranges", _G, "concat(acc, ':g.(', s, '_', s + 5, ')_(', s + 20, '_', s + 30, ')del')", "concat('(', s, '_', s + 5, ')') AS start, concat('(', s + 20, '_', s + 30, ')') AS \"end\"", ("start", "end"))
_forms("c8_ends_of_chromosomes", _G, "concat(acc, ':g.pter_', s, 'del')", "'pter' AS start, s::VARCHAR AS \"end\"", ("start", "end"))
_forms("c9_edits", _G, "concat(acc, ':g.', s, CASE vid % 4 WHEN 0 THEN 'A>G' WHEN 1 THEN concat('_', s + 3, 'inv') WHEN 2 THEN '=' ELSE concat('_', s + 1, 'insACGT') END)", "CASE vid % 4 WHEN 0 THEN 'sub' WHEN 1 THEN 'inv' WHEN 2 THEN 'identity' ELSE 'ins' END AS edit, CASE vid % 4 WHEN 0 THEN 'G' WHEN 3 THEN 'ACGT' ELSE '' END AS alt", ("edit", "alt"))
_forms("c9_repeats", _C, "concat(acc, ':c.', s, 'CAG[', 5 + vid % 9, ']')", "'repeat' AS edit, (5 + vid % 9)::VARCHAR AS count", ("edit", "count"))
_forms("c10_payloads", "edit = 'ins' AND axis = 'g'", "concat(acc, ':g.', s, '_', e, 'ins', CASE vid % 3 WHEN 0 THEN 'ACG' WHEN 1 THEN '100_120inv' ELSE 'N[20]' END)", "'ins' AS edit", ("edit",))
_forms("c12_axes", "edit = 'del'", "concat(acc, ':', axis, '.', s, 'del')", "axis, 'del' AS edit", ("axis", "edit"))
_forms("c14_rings", _G, "concat(acc, ':g.', s, '_', s + 9, 'del::', s + 50, '_', s + 60, 'del')", "'ring' AS phase", ("phase",))
_MISSENSE = "edit = 'missense'"
_forms("c11_further_forms", _MISSENSE, "concat(acc, ':p.', CASE vid % 4 WHEN 0 THEN '0' WHEN 1 THEN '?' WHEN 2 THEN concat(ref, s, 'dup') ELSE concat('Ter', s, 'GlnextTer', 3 + s % 9) END)", "CASE vid % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'unknown' WHEN 2 THEN 'dup' ELSE 'extension' END AS edit", ("edit",))
_forms("g4_duplication_with_insertion", _G, "concat(acc, ':g.', s, '_', s + 3, 'dupinsACG')", "'duplication with an insertion' AS error", ("error",))
_forms("g7_several_bases", _G, "concat(acc, ':g.', s, 'AC>GT')", "'several bases substituted' AS error", ("error",))
_forms("g8_residues_after_a_stop", _MISSENSE, "concat(acc, ':p.', ref, s, '_', alt, s + 1, 'insAlaTerGly')", "'residues after a stop' AS error", ("error",))
_forms("g9_stop_at_once", _MISSENSE, "concat(acc, ':p.', ref, s, 'TerfsTer1')", "'stop at once' AS error", ("error",))
_forms("g10_unchanged_anchor", _MISSENSE, "concat(acc, ':p.', ref, s, ref, 'fsTer5')", "'unchanged first residue' AS error", ("error",))
_forms("g12_start_loss", _MISSENSE, "concat(acc, ':p.Met1', CASE WHEN alt = 'Met' THEN 'Val' ELSE alt END)", "'start loss as a substitution' AS error", ("error",))
