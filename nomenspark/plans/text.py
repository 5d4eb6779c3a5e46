"""Queries over descriptions as text, with their oracles. The oracles start from the fields a description was written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import descriptions as D

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def variants(spark, d):
    return corpus.table(spark, d, "variants")


@query("c2_parse_common", "SELECT vid, acc AS accession, axis, s, e, edit, ref, alt FROM variants", "variants")
def c2(spark, d):
    return variants(spark, d).select("vid", D.parse(F.col("description")).alias("v")).select("vid", "v.*")


@query("y1_categories_and_round_trip", """
SELECT CASE WHEN axis = 'g' THEN CASE edit WHEN 'sub' THEN 'genomic_snv' ELSE concat('genomic_', edit) END
  WHEN axis = 'c' THEN CASE edit WHEN 'sub' THEN 'coding_snv' WHEN 'delins' THEN 'coding_del' WHEN 'inv' THEN 'other' ELSE concat('coding_', edit) END
  WHEN axis = 'p' THEN 'protein_sub' ELSE 'noncoding' END AS category, count(*) AS n, count(*) AS n_same FROM variants GROUP BY 1""", "variants")
def y1(spark, d):
    v = variants(spark, d).select("description", D.parse(F.col("description")).alias("v"))
    same = D.write(*(F.col(f"v.{c}") for c in ("accession", "axis", "s", "e", "edit", "ref", "alt"))) == F.col("description")
    return v.groupBy(D.category(F.col("description")).alias("category")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


@query("d1_write", "SELECT vid, description FROM variants", "variants")
def d1(spark, d):
    return variants(spark, d).select("vid", D.write(*(F.col(c) for c in ("acc", "axis", "s", "e", "edit", "ref", "alt"))).alias("description"))


@query("d2_protein_one_letter", """
SELECT vid, concat(acc, ':p.', substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', ref) + 2) / 3 AS INT), 1), s,
  substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', alt) + 2) / 3 AS INT), 1)) AS description FROM variants WHERE edit = 'missense'""", "variants")
def d2(spark, d):
    v = variants(spark, d).where("edit = 'missense'")
    return v.select("vid", D.protein_one_letter(*(F.col(c) for c in ("acc", "s", "ref", "alt"))).alias("description"))


@query("d3_rna_spelling", """
SELECT vid, concat(acc, ':r.', regexp_replace(replace(replace(replace(replace(substr(description, length(acc) + 4), 'T', 'u'), 'A', 'a'), 'C', 'c'), 'G', 'g'), '^$', '')) AS description
FROM variants WHERE axis IN ('c', 'n')""", "variants")
def d3(spark, d):
    return variants(spark, d).where("axis IN ('c', 'n')").select("vid", D.as_rna(F.col("description")).alias("description"))


@query("d4_spellings", """
SELECT vid, unnest([concat(acc, ':p.', ref, s, alt), concat(acc, ':p.(', ref, s, alt, ')'), concat(acc, ':p.', o, s, n), concat(acc, ':p.(', o, s, n, ')')]) AS spelling
FROM (SELECT *, substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', ref) + 2) / 3 AS INT), 1) AS o,
  substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', alt) + 2) / 3 AS INT), 1) AS n FROM variants WHERE edit = 'missense')""", "variants")
def d4(spark, d):
    v = variants(spark, d).where("edit = 'missense'")
    return v.select("vid", F.explode(D.spellings(*(F.col(c) for c in ("acc", "s", "ref", "alt")))).alias("spelling"))


@query("d6_caret", "SELECT vid, concat(description, chr(10), repeat(' ', length(acc)), '^') AS shown FROM variants", "variants")
def d6(spark, d):
    return variants(spark, d).select("vid", D.caret(F.col("description"), F.instr(F.col("description"), ":") - 1).alias("shown"))


@query("e1_accession_class", """
SELECT vid, CASE WHEN kind IN (0, 1, 2, 3, 4, 12) THEN 'refseq' WHEN kind IN (5, 6, 7) THEN 'lrg' WHEN kind IN (8, 9, 10) THEN 'ensembl' ELSE 'uniprot' END AS class,
  CASE WHEN kind IN (0, 5, 9, 12) THEN 'g' WHEN kind IN (1, 6, 8) THEN 'c' WHEN kind = 2 THEN 'n' WHEN kind IN (3, 7, 10, 11) THEN 'p' END AS axis,
  kind IN (1, 2, 4, 6, 8) AS is_transcript, kind = 2 AS is_noncoding FROM accessions""", "accessions")
def e1(spark, d):
    a = F.col("acc")
    return corpus.table(spark, d, "accessions").select(
        "vid", D.accession_class(a).alias("class"), D.inferred_axis(a).alias("axis"), D.is_transcript(a).alias("is_transcript"), D.is_noncoding(a).alias("is_noncoding"))


@query("c6_accession_parts", """
SELECT vid, CASE kind WHEN 0 THEN 'NC' WHEN 1 THEN 'NM' WHEN 2 THEN 'NR' WHEN 3 THEN 'NP' WHEN 4 THEN 'XM' WHEN 5 THEN 'LRG' WHEN 6 THEN 'LRG' WHEN 7 THEN 'LRG' WHEN 8 THEN 'ENST' WHEN 9 THEN 'ENSG' WHEN 10 THEN 'ENSMUSP' WHEN 12 THEN 'NG' END AS prefix,
  CASE WHEN kind IN (0, 1, 2, 3, 4, 12) THEN six WHEN kind IN (5, 6, 7) THEN plain WHEN kind IN (8, 9, 10) THEN eleven END AS number,
  CASE WHEN kind IN (0, 1) THEN n WHEN kind IN (2, 3, 10) THEN 1 WHEN kind = 4 THEN 2 WHEN kind = 8 THEN 4 END::INT AS version FROM accessions""", "accessions")
def c6(spark, d):
    return corpus.table(spark, d, "accessions").select("vid", D.accession_parts(F.col("acc")).alias("a")).select("vid", "a.*")


@query("e3_lengths", """
SELECT vid, e - s + 1 AS span, CASE edit WHEN 'sub' THEN 0 WHEN 'inv' THEN 0 WHEN 'del' THEN s - e - 1 WHEN 'dup' THEN e - s + 1 WHEN 'ins' THEN length(alt) WHEN 'delins' THEN length(alt) - (e - s + 1) END::BIGINT AS net FROM variants""", "variants")
def e3(spark, d):
    v = variants(spark, d)
    return v.select("vid", D.span(F.col("s"), F.col("e")).alias("span"), D.indel_length(F.col("edit"), F.col("s"), F.col("e"), F.col("alt")).alias("net"))


@query("e4_frameshift", """
SELECT vid, coalesce(CASE edit WHEN 'del' THEN (e - s + 1) % 3 WHEN 'dup' THEN (e - s + 1) % 3 WHEN 'ins' THEN length(alt) % 3 WHEN 'delins' THEN abs(length(alt) - (e - s + 1)) % 3 ELSE 0 END <> 0, false) AS frameshift FROM variants""", "variants")
def e4(spark, d):
    v = variants(spark, d)
    return v.select("vid", D.is_frameshift(F.col("edit"), F.col("s"), F.col("e"), F.col("alt")).alias("frameshift"))


@query("g_refusals", """
SELECT vid, CASE WHEN vid % 4 = 0 AND axis <> 'p' AND left(acc, 2) <> 'NP' AND (axis <> 'n' OR left(acc, 2) NOT IN ('NM')) THEN CASE WHEN axis = 'g' THEN 'axis_mismatch' WHEN axis = 'c' THEN 'axis_mismatch' ELSE 'axis_mismatch' END
  WHEN edit = 'ins' AND vid % 4 = 1 THEN 'insertion_flanks' WHEN edit = 'inv' AND vid % 4 = 2 THEN 'single_base_inversion' WHEN axis IN ('g', 'c', 'n') AND edit IN ('ins', 'delins') AND vid % 4 = 3 AND strpos(alt, 'T') > 0 THEN 'uracil_in_dna' END AS refusal
FROM variants""", "variants")
def g(spark, d):
    """Each refusal is provoked in a quarter of the rows: a protein accession, a wide insertion, one base inverted, U for T."""
    v = variants(spark, d)
    acc = F.when((F.col("vid") % 4 == 0) & (F.col("axis") != "p"), F.concat(F.lit("NP_"), F.substring("acc", 4, 100))).otherwise(F.col("acc"))
    e = F.when((F.col("edit") == "ins") & (F.col("vid") % 4 == 1), F.col("e") + 1).when((F.col("edit") == "inv") & (F.col("vid") % 4 == 2), F.col("s")).otherwise(F.col("e"))
    alt = F.when(F.col("edit").isin("ins", "delins") & (F.col("vid") % 4 == 3), F.translate("alt", "T", "U")).otherwise(F.col("alt"))
    return v.select("vid", D.refusal(F.col("axis"), acc, F.col("edit"), F.col("s"), e, alt).alias("refusal"))


def _repaired(name: str, code: str, where: str, damaged: str, wanted: str = "description"):
    """A query that repairs a damaged text; its oracle is the text before."""

    @query(name, f"SELECT vid, {wanted} AS repaired, ['{code}'] AS codes FROM variants WHERE {where}", "variants")
    def run(spark, d):
        v = variants(spark, d).where(where).select("vid", F.expr(damaged).alias("repaired"))
        return D.repair(v, "repaired", (code,))


_repaired("f2_dashes", "W2001", "axis = 'c'", "concat(acc, ':c.-', s, '–', s + 1, 'del')", "concat(acc, ':c.-', s, '-', s + 1, 'del')")
_repaired("f3_quotes", "W2002", "axis = 'c'", "concat('“', description, '”')", "concat(chr(34), description, chr(34))")
_repaired("f4_white_space", "W2003", "edit = 'del'", "concat(' ', acc, ': ', substr(description, length(acc) + 2), ' ')")
_repaired("f5_accession_case", "W1003", "axis = 'g'", "concat('nc', substr(description, 3))")
_repaired("f7_protein_arrow", "W3002", "edit = 'missense'", "concat(acc, ':p.', ref, s, '>', alt)")
_repaired("f8_amino_acid_case", "W1001", "edit = 'missense'", "concat(acc, ':p.', lower(ref), s, upper(alt))")
_repaired("f10_edit_case", "W1004", "edit IN ('del', 'dup', 'inv')", "concat(substr(description, 1, length(description) - 3), upper(edit))")
_repaired("f13_trailing_annotation", "W3005", "axis = 'c' AND edit = 'sub'", "concat(description, '(p.Ala12Gly)')")
_repaired("f15_one_position_range", "W4003", "edit = 'del' AND e = s", "concat(acc, ':', axis, '.', s, '_', s, 'del')")
_repaired("f16_empty_delins", "W3012", "edit = 'del'", "concat(description, 'ins')")
_repaired("f18_deletion_size", "W3011", "edit = 'del'", "concat(description, e - s + 1)")
_repaired("f20_duplication_size", "W3023", "edit = 'dup'", "concat(description, e - s + 1)")
_repaired("f20_duplication_bases", "W3024", "edit = 'dup'", "concat(description, 'ACG')")
_repaired("f20_deletion_bases", "W3025", "edit = 'del'", "concat(description, 'ACG')")
_repaired("f21_several_bases_substituted", "W3003", "edit = 'delins' AND e > s", "concat(acc, ':', axis, '.', s, '_', e, repeat('A', CAST(e - s + 1 AS INT)), '>', alt)")
_repaired("f22_con", "W3015", "edit = 'delins'", "replace(description, 'delins', 'con')")
_repaired("f24_rna_thymine", "W3020", "edit = 'ins' AND axis = 'n'", "concat(acc, ':r.', s, '_', e, 'ins', lower(alt))", "concat(acc, ':r.', s, '_', e, 'ins', replace(lower(alt), 't', 'u'))")
ORACLE["f24_rna_thymine"] = ORACLE["f24_rna_thymine"].replace("['W3020'] AS codes", "CASE WHEN strpos(alt, 'T') > 0 THEN ['W3020'] ELSE [] END AS codes")


@query("f_chain", "SELECT vid, description AS repaired, ['W2003', 'W1003', 'W1004'] AS codes FROM variants WHERE edit IN ('del', 'dup') AND axis = 'g'", "variants")
def f_chain(spark, d):
    v = variants(spark, d).where("edit IN ('del', 'dup') AND axis = 'g'")
    return D.repair(v.select("vid", F.expr("concat('nc', substr(description, 3, length(description) - 5), upper(edit), '  ')").alias("repaired")), "repaired")


@query("f1_position_zero", "SELECT vid, vid % 3 = 0 AS zero FROM variants WHERE edit = 'sub'", "variants")
def f1(spark, d):
    v = variants(spark, d).where("edit = 'sub'")
    text = F.when(F.col("vid") % 3 == 0, F.concat("acc", F.lit(":"), "axis", F.lit(".0"), "ref", F.lit(">"), "alt")).otherwise(F.col("description"))
    return v.select("vid", D.position_zero(text).alias("zero"))


@query("f6_missing_version", "SELECT vid, vid % 2 = 0 AS missing FROM variants", "variants")
def f6(spark, d):
    text = F.when(F.col("vid") % 2 == 0, F.regexp_replace("description", r"\.\d+:", ":")).otherwise(F.col("description"))
    return variants(spark, d).select("vid", D.missing_version(text).alias("missing"))


@query("f23_swapped_positions", "SELECT vid, description AS repaired FROM variants WHERE e > s AND edit IN ('del', 'dup')", "variants")
def f23(spark, d):
    v = variants(spark, d).where("e > s AND edit IN ('del', 'dup')")
    return v.select("vid", D.swapped(F.expr("concat(acc, ':', axis, '.', e, '_', s, edit)")).alias("repaired"))


@query("f25_intron_spelling", "SELECT vid, (1 + vid % 9)::INT AS intron, CASE WHEN vid % 2 = 0 THEN s ELSE -s END AS off FROM variants WHERE axis = 'c'", "variants")
def f25(spark, d):
    v = variants(spark, d).where("axis = 'c'")
    intron, off = D.intron_spelling(F.expr("concat(acc, ':c.IVS', 1 + vid % 9, CASE WHEN vid % 2 = 0 THEN '+' ELSE '-' END, s, 'G>A')"))
    return v.select("vid", intron.alias("intron"), off.alias("off"))


@query("f29_nearest_spelling", "SELECT vid, CASE WHEN edit = 'missense' THEN NULL ELSE edit END AS nearest FROM variants WHERE edit IN ('delins', 'inv', 'dup', 'missense')", "variants")
def f29(spark, d):
    v = variants(spark, d).where("edit IN ('delins', 'inv', 'dup', 'missense')")
    typo = F.when(F.col("edit") == "missense", "missense").otherwise(F.concat(F.col("edit"), F.lit("x")))
    return v.select("vid", D.nearest(typo, ["del", "dup", "inv", "ins", "delins", "con"]).alias("nearest"))


@query("i1_complete_short_form", "SELECT vid, CASE WHEN edit = 'missense' THEN description ELSE CASE axis WHEN 'c' THEN 'NM_000001.1' WHEN 'g' THEN 'NC_000001.11' END || ':' || axis || '.' || substr(description, length(acc) + 4) END AS description FROM variants", "variants")
def i1(spark, d):
    """Short forms take the accession that the context gives their axis, and are null where it gives none; whole ones stay."""
    short = D.complete(F.expr("CASE WHEN edit <> 'missense' THEN substr(description, length(acc) + 2) ELSE description END"), {"c": "NM_000001.1", "g": "NC_000001.11"})
    return variants(spark, d).select("vid", short.alias("description"))


@query("c16_rs_numbers", "SELECT rs, concat('rs', rs) AS name, rs AS parsed, rs AS parsed_bare FROM rsids", "rsids")
def c16(spark, d):
    r = corpus.table(spark, d, "rsids").select("rs", D.rs_id(F.col("rs")).alias("name"))
    return r.select("rs", "name", D.rs_number(F.upper("name")).alias("parsed"), D.rs_number(F.col("rs").cast("string")).alias("parsed_bare"))


@query("c17_parse_distinct_and_join", "SELECT vid, edit FROM variants", "variants")
def c17(spark, d):
    """Each distinct text is parsed once."""
    v = variants(spark, d).select("vid", "description")
    once = v.select("description").distinct().select("description", D.parse(F.col("description"))["edit"].alias("edit"))
    return v.join(once, "description").select("vid", "edit")
