"""Queries over records, effects and corpora of results, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import effects as E
from nomenspark.functions import sequences as S
from nomenspark.functions import vcf as V
from nomenspark.operators import analytics as A
from nomenspark.operators import contigs as K
from nomenspark.operators import coordinates as C

from .registry import Registry
from .sequence import _CODONS, _KEY, _PREFIX
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table

# ---- records

_REC = f"""
, r0 AS (SELECT *, {_PREFIX.format(a='ref', b='alt')} AS p FROM vcf), r1 AS (SELECT *, reverse(substr(ref, p + 1)) AS rr, reverse(substr(alt, p + 1)) AS ra FROM r0),
r2 AS (SELECT *, {_PREFIX.format(a='rr', b='ra')} AS q FROM r1), r AS (SELECT vid, chrom, pos + p AS pos, substr(ref, p + 1, length(ref) - p - q) AS ref, substr(alt, p + 1, length(alt) - p - q) AS alt FROM r2)
"""


def records(spark, d):
    return t(spark, d, "vcf")


@query("q1_trim", _REC + "SELECT vid, pos, ref, alt FROM r", "vcf")
def q1t(spark, d):
    return records(spark, d).select("vid", V.trim(c("pos"), c("ref"), c("alt")).alias("x")).select("vid", "x.*")


#: The records of build 38, stated apart from the table that the engine joins.
CONTIGS = """, contigs AS (SELECT * FROM (VALUES ('chr1', 'NC_000001.11'), ('chr2', 'NC_000002.12'), ('chr3', 'NC_000003.12'), ('chr4', 'NC_000004.12'), ('chr5', 'NC_000005.10'), ('chr6', 'NC_000006.12'), ('chr7', 'NC_000007.14'), ('chr8', 'NC_000008.11'),
  ('chr9', 'NC_000009.12'), ('chr10', 'NC_000010.11'), ('chr11', 'NC_000011.10'), ('chr12', 'NC_000012.12'), ('chr13', 'NC_000013.11'), ('chr14', 'NC_000014.9'), ('chr15', 'NC_000015.10'), ('chr16', 'NC_000016.10'), ('chr17', 'NC_000017.11'),
  ('chr18', 'NC_000018.10'), ('chr19', 'NC_000019.10'), ('chr20', 'NC_000020.11'), ('chr21', 'NC_000021.9'), ('chr22', 'NC_000022.11'), ('chrX', 'NC_000023.11'), ('Y', 'NC_000024.10'), ('chrM', 'NC_012920.1')) x(chrom, accession))
"""


def placed(spark, rows, build="GRCh38"):
    """rows with the accession of chrom, and contig_error."""
    return K.with_accession(rows, K.aliases(spark), "chrom", build)


@query("q1_record_to_description", _REC + CONTIGS + """SELECT vid, concat(accession, CASE WHEN accession LIKE 'NC_012920%' THEN ':m.' ELSE ':g.' END, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN concat(pos, ref, '>', alt)
  WHEN ref = '' THEN concat(pos - 1, '_', pos, 'ins', alt) ELSE concat(pos, CASE WHEN length(ref) > 1 THEN concat('_', pos + length(ref) - 1) ELSE '' END, CASE WHEN alt = '' THEN concat('del', ref) ELSE concat('delins', alt) END) END) AS description,
  CASE WHEN accession IS NULL THEN 'unknown_contig' WHEN ref = '' AND alt = '' THEN 'no_change' END AS error
FROM (SELECT vid, accession, pos, ref, alt FROM r LEFT JOIN contigs USING (chrom)) WHERE accession IS NOT NULL AND (ref <> '' OR alt <> '')
UNION ALL SELECT vid, NULL, CASE WHEN accession IS NULL THEN 'unknown_contig' ELSE 'no_change' END FROM r LEFT JOIN contigs USING (chrom) WHERE accession IS NULL OR (ref = '' AND alt = '')""", "vcf")
def q1(spark, d):
    x = placed(spark, records(spark, d)).select("vid", "contig_error", V.description(c("accession"), c("pos"), c("ref"), c("alt")).alias("description"))
    return x.select("vid", "description", F.coalesce("contig_error", F.when(c("description").isNull(), "no_change")).alias("error"))


@query("q3_accessions", CONTIGS + """SELECT DISTINCT 'GRCh38' AS build, v.chrom, accession, CASE WHEN accession IS NULL THEN 'unknown_contig' END AS contig_error FROM vcf v LEFT JOIN contigs USING (chrom)
UNION ALL SELECT DISTINCT 'hg19', v.chrom, CASE WHEN accession LIKE 'NC_012920%' THEN accession ELSE split_part(accession, '.', 1) || '.' || (split_part(accession, '.', 2)::INT - 1) END, CASE WHEN accession IS NULL THEN 'unknown_contig' END FROM vcf v LEFT JOIN contigs USING (chrom)
UNION ALL SELECT DISTINCT 'mm10', chrom, NULL, 'unknown_build' FROM vcf""", "vcf")
def q3(spark, d):
    """Each build's accessions, by any of its names; the older human build is one version behind throughout."""
    names = records(spark, d).select("chrom").distinct().withColumn("build", F.explode(F.array(F.lit("GRCh38"), F.lit("hg19"), F.lit("mm10"))))
    return placed(spark, names, c("build")).select("build", "chrom", "accession", "contig_error")


@query("q3_names_of_accessions", CONTIGS + "SELECT DISTINCT accession, CASE chrom WHEN 'Y' THEN 'chrY' ELSE chrom END AS name, 'GRCh38' AS build FROM vcf JOIN contigs USING (chrom) UNION ALL SELECT 'NC_000099.1', NULL, NULL", "vcf")
def q3b(spark, d):
    found = placed(spark, records(spark, d).select("chrom").distinct()).where("accession IS NOT NULL").select("accession")
    other = spark.createDataFrame([("NC_000099.1",)], "accession string")
    return K.named(found.union(other), K.aliases(spark), "accession").select("accession", "name", "build")


@query("q5_edit_to_record", """, x AS (SELECT vid, seq, s + 1 AS s, CASE WHEN e > s THEN e ELSE s + 1 END AS e, payload, CASE vid % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'dup' WHEN 2 THEN 'inv' WHEN 3 THEN 'delins' ELSE 'ins' END AS edit FROM edits WHERE payload <> '')
SELECT vid, CASE WHEN edit = 'del' OR (edit = 'delins' AND length(payload) <> e - s + 1) THEN s - 1 WHEN edit = 'dup' THEN e ELSE s END::BIGINT AS pos,
  CASE edit WHEN 'del' THEN substr(seq, s - 1, e - s + 2) WHEN 'dup' THEN substr(seq, e, 1) WHEN 'inv' THEN substr(seq, s, e - s + 1) WHEN 'ins' THEN substr(seq, s, 1) ELSE CASE WHEN length(payload) = e - s + 1 THEN substr(seq, s, e - s + 1) ELSE substr(seq, s - 1, e - s + 2) END END AS ref,
  CASE edit WHEN 'del' THEN substr(seq, s - 1, 1) WHEN 'dup' THEN concat(substr(seq, e, 1), substr(seq, s, e - s + 1)) WHEN 'inv' THEN translate(reverse(substr(seq, s, e - s + 1)), 'ACGT', 'TGCA') WHEN 'ins' THEN concat(substr(seq, s, 1), payload)
    ELSE CASE WHEN length(payload) = e - s + 1 THEN payload ELSE concat(substr(seq, s - 1, 1), payload) END END AS alt FROM x""", "edits")
def q5(spark, d):
    x = t(spark, d, "edits").where("payload <> ''").withColumn("edit", F.expr("CASE vid % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'dup' WHEN 2 THEN 'inv' WHEN 3 THEN 'delins' ELSE 'ins' END"))
    e = F.when(c("e") > c("s"), c("e")).otherwise(c("s") + 1)
    return x.select("vid", V.record(c("edit"), c("s") + 1, e, c("payload"), F.lit(""), c("seq")).alias("r")).select("vid", "r.*")


@query("q8_split_multiallelic", "SELECT vid, unnest(CASE WHEN alt2 = '' THEN [alt] ELSE [alt, alt2] END) AS alt FROM vcf", "vcf")
def q8(spark, d):
    alts = F.filter(F.array("alt", "alt2"), lambda x: x != "")
    return records(spark, d).select("vid", F.explode(F.when(c("alt2") == "", F.array("alt")).otherwise(alts)).alias("alt"))


@query("e8_record_types", "SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = 1 THEN 'insertion' WHEN length(alt) = 1 THEN 'deletion' WHEN length(ref) = length(alt) THEN 'mnv' ELSE 'complex' END AS kind, count(*) AS n, max(pos + length(ref) - 1) AS last, count(*) FILTER (filter = 'PASS') AS n_pass FROM vcf GROUP BY 1", "vcf")
def e8(spark, d):
    return records(spark, d).groupBy(V.kind(c("ref"), c("alt")).alias("kind")).agg(F.count("*").alias("n"), F.max(V.end_position(c("pos"), c("ref"))).alias("last"), F.count_if(c("filter") == "PASS").alias("n_pass"))


@query("a3_record_lines", "SELECT vid, chrom, pos, ref, alt, dp::VARCHAR AS dp, CASE WHEN filter = '.' THEN NULL ELSE filter END AS filter FROM vcf", "vcf")
def a3(spark, d):
    line = F.concat_ws("\t", "chrom", c("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.concat(F.lit("DB;DP="), c("dp").cast("string")))
    x = records(spark, d).select("vid", V.parse_line(line).alias("r"))
    return x.select("vid", "r.chrom", "r.pos", "r.ref", F.element_at("r.alt", 1).alias("alt"), F.element_at("r.info", "DP").alias("dp"), "r.filter")


@query("b4_write_lines", "SELECT vid, concat_ws(chr(9), chrom, pos, '.', ref, CASE WHEN alt2 = '' THEN alt ELSE concat(alt, ',', alt2) END, '.', filter, concat('DB;DP=', dp)) AS line FROM vcf", "vcf")
def b4(spark, d):
    alts = F.when(c("alt2") == "", F.array("alt")).otherwise(F.array("alt", "alt2"))
    info = F.create_map(F.lit("DP"), c("dp").cast("string"), F.lit("DB"), F.lit(""))
    none = F.lit(None).cast("string")
    return records(spark, d).select("vid", V.write_line(c("chrom"), c("pos"), none, c("ref"), alts, none, c("filter"), info).alias("line"))


@query("q12_batch_statistics", "SELECT count(*) AS total, count(*) FILTER (pos % 5 <> 0) AS ok, count(*) FILTER (pos % 5 = 0) AS failed, round(count(*) FILTER (pos % 5 <> 0) / count(*), 6) AS rate FROM vcf", "vcf")
def q12(spark, d):
    """Lines whose position is no number fail; the others are records."""
    line = F.concat_ws("\t", "chrom", F.when(c("pos") % 5 == 0, "x").otherwise(c("pos").cast("string")), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."))
    return A.batch(records(spark, d).select(V.parse_line(line).isNotNull().alias("ok")))


# ---- effects

_NET = "CASE edit WHEN 'del' THEN -(e - s + 1) WHEN 'dup' THEN e - s + 1 WHEN 'ins' THEN length(alt) WHEN 'delins' THEN length(alt) - (e - s + 1) ELSE 0 END"


@query("r1_consequences", "SELECT term, rank::INT AS rank, CASE WHEN rank >= 13 THEN 'HIGH' WHEN rank >= 9 THEN 'MODERATE' WHEN rank >= 5 THEN 'LOW' ELSE 'MODIFIER' END AS impact FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in E.CONSEQUENCES) + ") x(term, rank)")
def r1(spark, d):
    x = spark.createDataFrame([(a,) for a, _ in E.CONSEQUENCES], "term string")
    return x.select("term", E.severity(c("term")).alias("rank"), E.impact(c("term")).alias("impact"))


@query("r2_residue_changes", "SELECT CASE WHEN s % 40 = 10 THEN CASE WHEN o = 'M' THEN CASE WHEN n = 'M' THEN 'start_retained_variant' ELSE 'start_lost' END WHEN o = n THEN CASE WHEN o = '*' THEN 'stop_retained_variant' ELSE 'synonymous_variant' END WHEN n = '*' THEN 'stop_gained' WHEN o = '*' THEN 'stop_lost' ELSE 'missense_variant' END WHEN o = n THEN CASE WHEN o = '*' THEN 'stop_retained_variant' ELSE 'synonymous_variant' END WHEN n = '*' THEN 'stop_gained' WHEN o = '*' THEN 'stop_lost' ELSE 'missense_variant' END AS effect, count(*) AS n FROM (SELECT s, substr('ARM*M*', (1 + s % 6)::INT, 1) AS o, substr('ARM*', (1 + e % 4)::INT, 1) AS n FROM variants) GROUP BY 1", "variants")
def r2(spark, d):
    number = F.when(c("s") % 40 == 10, 1).otherwise(c("s"))
    x = variants(spark, d).select(number.alias("k"), F.expr("substr('ARM*M*', CAST(1 + s % 6 AS INT), 1)").alias("o"), F.expr("substr('ARM*', CAST(1 + e % 4 AS INT), 1)").alias("w"))
    return x.groupBy(E.amino_acid_change(c("k"), c("o"), c("w")).alias("effect")).agg(F.count("*").alias("n"))


@query("r3_indel_changes", f"SELECT vid, CASE WHEN abs({_NET}) % 3 <> 0 THEN 'frameshift_variant' WHEN {_NET} > 0 THEN 'inframe_insertion' WHEN {_NET} < 0 THEN 'inframe_deletion' ELSE 'coding_sequence_variant' END AS effect FROM variants WHERE edit NOT IN ('sub', 'missense')", "variants")
def r3(spark, d):
    from nomenspark.functions.descriptions import indel_length

    v = variants(spark, d).where("edit NOT IN ('sub', 'missense')")
    return v.select("vid", E.indel_change(indel_length(c("edit"), c("s"), c("e"), c("alt"))).alias("effect"))


@query("r4_splice_changes", "SELECT vid, CASE WHEN off IS NULL THEN NULL WHEN abs(off) <= 2 THEN CASE WHEN off > 0 THEN 'splice_donor_variant' ELSE 'splice_acceptor_variant' END WHEN abs(off) <= 8 THEN 'splice_region_variant' ELSE 'intron_variant' END AS effect FROM cpos", "cpos", "transcripts")
def r4(spark, d):
    return t(spark, d, "cpos").select("vid", E.splice_change(c("off")).alias("effect"))


@query("r8_splice_sites", "SELECT site, count(*) AS n FROM (SELECT CASE WHEN off IS NULL THEN NULL WHEN abs(off) > 20 THEN 'near_splice' WHEN off > 0 THEN CASE WHEN off <= 2 THEN 'donor_canonical' WHEN off <= 6 THEN 'donor_extended' ELSE 'donor_region' END ELSE CASE WHEN off >= -2 THEN 'acceptor_canonical' WHEN off >= -12 THEN 'acceptor_extended' ELSE 'acceptor_region' END END AS site FROM cpos) GROUP BY site", "cpos", "transcripts")
def r8(spark, d):
    return t(spark, d, "cpos").groupBy(E.splice_site(c("off")).alias("site")).agg(F.count("*").alias("n"))


@query("r5_utr_changes", "SELECT vid, CASE WHEN utr3 THEN '3_prime_UTR_variant' WHEN base < 0 THEN '5_prime_UTR_variant' END AS effect FROM cpos", "cpos", "transcripts")
def r5(spark, d):
    return t(spark, d, "cpos").select("vid", E.utr_change(c("base"), c("utr3")).alias("effect"))


@query("r6_decay", """, x AS (SELECT vid, tx, cds_start + base - 1 AS ptc, cds_end, len1 + len2 + 1 AS j FROM cpos JOIN transcripts USING (tx) WHERE base > 0 AND NOT utr3 AND cds_end IS NOT NULL)
SELECT vid, tx, CASE WHEN ptc >= cds_end THEN 'not_premature' WHEN ptc >= j THEN 'last_exon' WHEN j - ptc > 55 THEN 'high' WHEN j - ptc >= 50 THEN 'medium' ELSE 'near_junction' END AS why, ptc < cds_end AND ptc < j AND j - ptc >= 50 AS triggered FROM x""", "cpos", "transcripts")
def r6(spark, d):
    last = t(spark, d, "exons").groupBy("tx").agg(F.count("*").alias("exons"), (F.max_by("t0", "number") + 1).alias("last"))
    x = C.cds_to_tx(t(spark, d, "cpos").where("base > 0 AND NOT utr3"), t(spark, d, "transcripts")).where("n IS NOT NULL")
    x = x.join(t(spark, d, "transcripts").select("tx", "cds_end"), "tx").join(last, "tx")
    return x.select("vid", "tx", E.decay(c("exons"), c("n"), c("cds_end"), c("last")).alias("x")).select("vid", "tx", "x.*")




@query("r7_start_context", "SELECT k, CASE WHEN substr(seq, 14, 1) IN ('A', 'G') AND substr(seq, 20, 1) = 'G' THEN 'strong' WHEN substr(seq, 14, 1) IN ('A', 'G') OR substr(seq, 20, 1) = 'G' THEN 'adequate' ELSE 'weak' END AS strength FROM sequences", "sequences")
def r7(spark, d):
    return t(spark, d, "sequences").select("k", E.kozak(F.substring("seq", 11, 10)).alias("strength"))


_CODE = f", codes(codon, aa) AS (VALUES {_CODONS})"


@query("s1_codons", "WITH codes(codon, aa) AS (VALUES " + _CODONS + ") SELECT aa, list(codon ORDER BY translate(codon, 'TCAG', '0123')) AS codons FROM codes GROUP BY aa")
def s1(spark, d):
    x = spark.createDataFrame([(a,) for a in sorted(set(S.CODE))], "aa string")
    return x.select("aa", E.codons_for(c("aa")).alias("codons"))


_HAMMING = "(CASE WHEN a.codon[1] <> b.codon[1] THEN 1 ELSE 0 END + CASE WHEN a.codon[2] <> b.codon[2] THEN 1 ELSE 0 END + CASE WHEN a.codon[3] <> b.codon[3] THEN 1 ELSE 0 END)"
_AA = "substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', {0}) + 2) / 3 AS INT), 1)"


@query("s2_back_translation", _CODE + f""", x AS (SELECT vid, ref, {_AA.format('ref')} AS o, {_AA.format('alt')} AS n FROM variants WHERE edit = 'missense')
SELECT vid, a.codon AS "from", b.codon AS "to" FROM x JOIN codes a ON a.aa = o JOIN codes b ON b.aa = n WHERE {_HAMMING} = 1""", "variants")
def s2(spark, d):
    from nomenspark.functions.descriptions import one_letter

    v = variants(spark, d).where("edit = 'missense'")
    return v.select("vid", F.explode(E.back_translate(one_letter(c("ref")), one_letter(c("alt")))).alias("x")).select("vid", "x.from", "x.to")


@query("s3_known_codon", _CODE + f""", x AS (SELECT vid, {_AA.format('alt')} AS n, substr('ACGT', (1 + s % 4)::INT, 1) || 'AG' AS codon FROM variants WHERE edit = 'missense')
SELECT vid, b.codon AS "to", ({_HAMMING})::INT AS n FROM x a JOIN codes b ON b.aa = a.n""", "variants")
def s3(spark, d):
    from nomenspark.functions.descriptions import one_letter

    v = variants(spark, d).where("edit = 'missense'")
    known = F.concat(F.expr("substr('ACGT', CAST(1 + s % 4 AS INT), 1)"), F.lit("AG"))
    return v.select("vid", F.explode(E.codon_changes(known, one_letter(c("alt")))).alias("x")).select("vid", "x.to", "x.n")


@query("s4_to_stop", _CODE + f', x AS (SELECT DISTINCT {_AA.format("ref")} AS o FROM variants WHERE edit = \'missense\') SELECT o AS aa, count(*) AS n FROM x JOIN codes a ON a.aa = o JOIN codes b ON b.aa = \'*\' WHERE {_HAMMING} = 1 GROUP BY o', "variants")
def s4(spark, d):
    from nomenspark.functions.descriptions import one_letter

    x = variants(spark, d).where("edit = 'missense'").select(one_letter(c("ref")).alias("aa")).distinct()
    return x.select("aa", F.size(E.back_translate(c("aa"), F.lit("*"))).cast("long").alias("n")).where("n > 0")


@query("t4_substitution_protein", _CODE + """, x AS (SELECT vid, acc, seq, s + 1 AS b, substr('CGTA', strpos('ACGT', substr(seq, s + 1, 1))::INT, 1) AS alt, 3 * (s // 3) + 1 AS f FROM edits),
y AS (SELECT vid, f, substr(seq, f, 3) AS o, concat(substr(seq, f, b - f), alt, substr(seq, b + 1, f + 2 - b)) AS n FROM x)
SELECT vid, ((f - 1) // 3 + 1)::BIGINT AS number, a.aa AS ref, z.aa AS alt FROM y JOIN codes a ON a.codon = o JOIN codes z ON z.codon = n""", "edits")
def t4(spark, d):
    x = t(spark, d, "edits")
    base = S.part(c("seq"), c("s"), F.lit(1))
    return x.select("vid", E.substitution_effect(c("seq"), c("s") + 1, F.translate(base, "ACGT", "CGTA")).alias("p")).select("vid", "p.*")


@query("t5_indel_protein", _CODE + f""", m AS (SELECT vid, seq, concat(left(seq, s), payload, substr(seq, e + 1)) AS mut, length(payload) - (e - s) AS net FROM edits),
uo AS (SELECT seq, string_agg(aa, '' ORDER BY i) AS old FROM (SELECT DISTINCT seq FROM m), (SELECT unnest(range(0, 85)) AS i) JOIN codes ON codon = substr(seq, 3 * i + 1, 3) GROUP BY seq),
un AS (SELECT mut, string_agg(aa, '' ORDER BY i) AS new FROM (SELECT DISTINCT mut FROM m), (SELECT unnest(range(0, 90)) AS i) JOIN codes ON codon = substr(mut, 3 * i + 1, 3) GROUP BY mut),
x AS (SELECT vid, net, old, new, {_PREFIX.format(a='old', b='new')} AS i FROM m JOIN uo USING (seq) JOIN un USING (mut)), y AS (SELECT *, strpos(substr(new, i + 1), '*') AS stop FROM x),
z AS (SELECT vid, i, stop, CASE WHEN string_split(old, '*')[1] = string_split(new, '*')[1] THEN 'identity' WHEN abs(net) % 3 <> 0 AND stop = 1 THEN 'stop_gained' WHEN abs(net) % 3 <> 0 THEN 'frameshift' ELSE 'in_frame' END AS kind FROM y)
SELECT vid, kind, CASE WHEN kind <> 'identity' THEN i + 1 END::BIGINT AS number, CASE WHEN kind = 'frameshift' AND stop > 0 THEN stop END::INT AS distance FROM z""", "edits")
def t5(spark, d):
    return t(spark, d, "edits").select("vid", E.indel_effect(c("seq"), c("s"), c("e"), c("payload")).alias("p")).select("vid", "p.*")


# ---- corpora and runs of tools


@query("y2_stratified_sample", """, n AS (SELECT description, category, count(*) OVER (PARTITION BY category) AS c, count(*) OVER () AS total, row_number() OVER (PARTITION BY category ORDER BY md5(concat('7', description)), description) AS r
  FROM (SELECT DISTINCT description, edit AS category FROM variants))
SELECT description, category FROM n WHERE r <= greatest(1, ceil(500 * c / total))""", "variants")
def y2(spark, d):
    x = variants(spark, d).select("description", c("edit").alias("category")).distinct()
    return A.stratified(x, "category", "description", 500, 7)


@query("y3_shards", "SELECT shard, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY description) - 1) % 8 AS shard FROM (SELECT DISTINCT description FROM variants)) GROUP BY shard", "variants")
def y3(spark, d):
    return A.shards(variants(spark, d).select("description").distinct(), "description", 8).groupBy("shard").agg(F.count("*").alias("n"))


@query("y4_throughput", "SELECT tool, count(*) AS total, count(*) FILTER (ok) AS ok, round(count(*) / nullif(sum(seconds), 0), 6) AS rate FROM tool_runs GROUP BY tool", "tool_runs")
def y4(spark, d):
    return t(spark, d, "tool_runs").groupBy("tool").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.round(F.try_divide(F.count("*"), F.sum("seconds")), 6).alias("rate"))


@query("y5_agreement", """SELECT coalesce(l.category, r.category) AS category, count(*) FILTER (l.ok AND r.ok) AS both_ok, count(*) FILTER (NOT coalesce(l.ok, false) AND NOT coalesce(r.ok, false)) AS both_failed, count(*) FILTER (l.ok AND NOT coalesce(r.ok, false)) AS only_left,
  count(*) FILTER (r.ok AND NOT coalesce(l.ok, false)) AS only_right, count(*) FILTER (l.ok AND r.ok AND l.output = r.output) AS agree, round(count(*) FILTER (l.ok AND r.ok AND l.output = r.output) / nullif(count(*) FILTER (l.ok AND r.ok), 0), 6) AS rate
FROM (SELECT * FROM tool_runs WHERE tool = 'left') l FULL JOIN (SELECT * FROM tool_runs WHERE tool = 'right') r ON l.input = r.input GROUP BY 1""", "tool_runs")
def y5(spark, d):
    x = t(spark, d, "tool_runs")
    return A.agreement(x.where("tool = 'left'"), x.where("tool = 'right'"), "input")


@query("y6_arbitrated", "SELECT CASE WHEN input % 10 = 0 THEN 'override' ELSE 'none' END AS verdict, count(*) AS n, count(*) FILTER (ok OR input % 10 = 0) AS accepted FROM tool_runs GROUP BY 1", "tool_runs")
def y6(spark, d):
    x = t(spark, d, "tool_runs")
    overrides = x.select("input").distinct().where("input % 10 = 0").withColumn("verdict", F.lit("override"))
    return A.arbitrate(x, overrides, "input").groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@query("y7_rates", "SELECT category, shard, median(seconds) AS median, min(seconds) AS least, max(seconds) AS most FROM tool_runs GROUP BY category, shard", "tool_runs")
def y7(spark, d):
    return t(spark, d, "tool_runs").groupBy("category", "shard").agg(F.median("seconds").alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


@query("y8_error_histogram", "SELECT category, count(*) AS n FROM tool_runs WHERE NOT ok GROUP BY category", "tool_runs")
def y8(spark, d):
    return t(spark, d, "tool_runs").where("NOT ok").groupBy("category").agg(F.count("*").alias("n"))


@query("y9_accession_inventory", "SELECT left(acc, 2) AS prefix, count(*) AS n, count(DISTINCT acc) AS accessions FROM variants GROUP BY 1", "variants")
def y9(spark, d):
    return A.inventory(variants(spark, d), "description")


@query("y10_census", "SELECT category, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM tool_runs GROUP BY 1, 2 UNION ALL SELECT category, NULL, count(*) FROM tool_runs GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM tool_runs", "tool_runs")
def y10(spark, d):
    return t(spark, d, "tool_runs").rollup("category", F.when(c("ok"), "ok").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))


@query("x5_batch_result", "SELECT count(*) AS total, count(*) FILTER (axis <> 'n') AS ok, count(*) FILTER (axis = 'n') AS failed, round(count(*) FILTER (axis <> 'n') / count(*), 6) AS rate FROM variants", "variants")
def x5(spark, d):
    from nomenspark.functions.descriptions import parse

    text = F.when(c("axis") == "n", F.concat("description", F.lit("?"))).otherwise(c("description"))
    return A.batch(variants(spark, d).select(parse(text)["edit"].isNotNull().alias("ok")))


@query("p4_all_equivalent", _KEY + "SELECT acc, count(*) AS n, min(key) IS NOT DISTINCT FROM max(key) AS same, min(vid) AS head FROM w GROUP BY acc", "edits")
def p4(spark, d):
    """Whether all changes of a sequence are one and the same, by their canonical keys."""
    x = t(spark, d, "edits").select("vid", "acc", S.canonical_spdi(c("acc"), c("seq"), c("s"), c("e"), c("payload")).alias("key"))
    return x.groupBy("acc").agg(F.count("*").alias("n"), (F.min("key").eqNullSafe(F.max("key"))).alias("same"), F.min("vid").alias("head"))
