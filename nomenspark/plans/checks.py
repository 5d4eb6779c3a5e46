"""Queries over what is wrong with descriptions, legacy spellings and modes of parsing, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenspark.functions import checks as K
from nomenspark.functions import effects as E

from .registry import Registry
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c = F.col


def _repaired(name: str, code: str, where: str, damaged: str, wanted: str = "description"):
    @query(name, f"SELECT vid, {wanted} AS repaired, ['{code}'] AS codes FROM variants WHERE {where}", "variants")
    def run(spark, d):
        return K.repair_all(variants(spark, d).where(where).select("vid", F.expr(damaged).alias("repaired")), "repaired", (code,))


_ONE = "substr('ARNDCQEGHILKMFPSTWYV', CAST((strpos('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', {0}) + 2) / 3 AS INT), 1)"
_INSTR = "substr('ARNDCQEGHILKMFPSTWYV', CAST((instr('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', {0}) + 2) / 3 AS INT), 1)"
_repaired("f9_frameshift_x", "W3010", "edit = 'missense'", "concat(acc, ':p.', ref, s, alt, 'fsX', 2 + s % 9)", "concat(acc, ':p.', ref, s, alt, 'fsTer', 2 + s % 9)")
_repaired("f9_stop_x", "W3008", "edit = 'missense'", "concat(acc, ':p.', ref, s, 'X')", "concat(acc, ':p.', ref, s, 'Ter')")
_repaired("f11_one_letter", "W1002", "edit = 'missense'", f"concat(acc, ':p.', {_INSTR.format('ref')}, s, {_INSTR.format('alt')})")
_repaired("f12_coordinate_type", "W3006", "axis = 'g'", "concat(acc, ':', substr(description, length(acc) + 4))")
_repaired("f14_old_alleles", "W3004", "edit = 'del' AND axis IN ('g', 'c')", "concat(acc, ':[', substr(description, length(acc) + 2), ';', axis, '.', e + 9, 'del]')", "concat(acc, ':', axis, '.[', substr(description, length(acc) + 4), ';', e + 9, 'del]')")
_repaired(
    "f17_repeat_label", "W3013", "edit = 'del' AND axis = 'c'", "concat(acc, ':r.', s, '_', s + 2, CASE WHEN vid % 2 = 0 THEN 'cug' ELSE 'g' END, '[4]')",
    "CASE WHEN vid % 2 = 0 THEN concat(acc, ':r.', s, '_', s + 2, '[4]') ELSE concat(acc, ':r.', s, 'g[4]') END",
)


@query("f19_length_mismatch", "SELECT vid, vid % 3 = 0 AS mismatch FROM variants WHERE edit IN ('del', 'dup', 'inv') AND e > s", "variants")
def f19(spark, d):
    """Bases stated after a range, in a third of the rows one too many."""
    n = F.when(c("vid") % 3 == 0, c("e") - c("s") + 2).otherwise(c("e") - c("s") + 1)
    v = variants(spark, d).where("edit IN ('del', 'dup', 'inv') AND e > s")
    return v.select("vid", K.length_mismatch(F.concat("description", F.repeat(F.lit("A"), n.cast("int")))).alias("mismatch"))


_FOUND = (
    ("f26_bracketed_residues", "W3021", "edit = 'missense'", "concat(acc, ':p.', ref, s, '_', alt, s + 1, 'ins[Ala;Pro]')"), ("f27_bare_insertion", "W3027", "edit = 'ins'", "concat(acc, ':', axis, '.', s, '_', e, 'ins')"),
    ("f28_one_member_in_brackets", "W3026", "edit = 'del' AND axis = 'g'", "concat(acc, ':', axis, '.[', s, 'del]')"), ("f28_alignment_symbol", "W3028", "edit = 'ins' AND axis = 'g'", "concat(description, '-A')"),
    ("f28_inserted_size", "W3029", "edit = 'ins' AND axis = 'g'", "concat(acc, ':g.', s, '_', e, 'ins', 10 + s % 9)"), ("f28_noncoding_zone", "W4008", "edit = 'sub' AND axis = 'n'", "concat(acc, ':n.-', s, ref, '>', alt)"),
    ("f28_genomic_offset", "W4009", "edit = 'sub' AND axis = 'g'", "concat(acc, ':g.', s, '+5', ref, '>', alt)"), ("f28_bare_intron", "W4007", "edit = 'sub' AND axis = 'c'", "concat(acc, ':c.', s, '+5', ref, '>', alt)"),
)
for _name, _code, _where, _text in _FOUND:

    def _found(spark, d, where=_where, text=_text):
        """The damaged descriptions, and every second one sound."""
        given = F.when(c("vid") % 2 == 0, F.expr(text)).otherwise(c("description"))
        return variants(spark, d).where(where).select("vid", F.array_join(K.detections(given), ",").alias("codes"))

    query(_name, f"SELECT vid, CASE WHEN vid % 2 = 0 THEN '{_code}' ELSE '' END AS codes FROM variants WHERE {_where}", "variants")(_found)


@query("f30_explain", "SELECT code, code IN ('W1001', 'W1003', 'W2001', 'W3015', 'W4001') AS repaired, CASE code WHEN 'REFSEQ_MISMATCH' THEN 'bases differ from the reference' WHEN 'W1001' THEN 'amino acid in lower or upper case' WHEN 'W1003' THEN 'accession prefix in lower case' WHEN 'W2001' THEN 'another dash' WHEN 'W3015' THEN 'con for a conversion' WHEN 'W4001' THEN 'positions swapped' WHEN 'W3027' THEN 'insertion without bases' END AS meaning FROM (VALUES ('W1001'), ('W1003'), ('W2001'), ('W3015'), ('W4001'), ('W3027'), ('REFSEQ_MISMATCH'), ('W9999')) x(code)")
def f30(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("W1001", "W1003", "W2001", "W3015", "W4001", "W3027", "REFSEQ_MISMATCH", "W9999")], "code string")
    return K.explained(rows, "code").select("code", F.coalesce("repaired", F.lit(False)).alias("repaired"), "meaning")


_REFUSED = (
    ("g2_noncoding_downstream", "noncoding_downstream", "edit = 'sub' AND axis = 'n'", "concat(acc, ':n.*', s, ref, '>', alt)"), ("g6_point_size", "point_size", "edit = 'del'", "concat(acc, ':', axis, '.', s, 'del', 2 + s % 7)"),
    ("g13_self_cancelling", "self_cancelling", "edit = 'del' AND axis IN ('g', 'c')", "concat(acc, ':', axis, '.[', s, '_', e + 3, 'del;', s, '_', e + 3, 'dup]')"),
    ("g14_ring_without_junction", "ring_without_junction", "edit = 'del' AND axis = 'g'", "concat(acc, ':g.', s, '_', e, 'del::', e + 9, 'dup')"), ("g14_ring_order", "ring_order", "edit = 'del' AND axis = 'g'", "concat(acc, ':g.', e + 9, 'del::', s, 'del')"),
)
for _name, _why, _where, _text in _REFUSED:

    def _refused(spark, d, where=_where, text=_text):
        given = F.when(c("vid") % 2 == 0, F.expr(text)).otherwise(c("description"))
        return variants(spark, d).where(where).select("vid", K.member_refusal(given).alias("refusal"))

    query(_name, f"SELECT vid, CASE WHEN vid % 2 = 0 THEN '{_why}' END AS refusal FROM variants WHERE {_where}", "variants")(_refused)


@query("e2_kinds", """SELECT vid, CASE vid % 4 WHEN 0 THEN 'allele' ELSE CASE axis WHEN 'g' THEN 'genome' WHEN 'c' THEN 'coding' WHEN 'n' THEN 'noncoding' ELSE 'protein' END END AS kind, axis, CASE WHEN vid % 4 = 1 THEN 'GENE1' END AS gene, acc AS accession FROM variants
UNION ALL SELECT 0, 'null_allele', NULL, NULL, NULL UNION ALL SELECT 0, 'unknown_allele', NULL, NULL, NULL""", "variants")
def e2(spark, d):
    own = F.expr("substr(description, length(acc) + 4)")
    head = F.concat(F.lit(":"), "axis", F.lit("."))
    text = F.when(c("vid") % 4 == 0, F.concat("acc", head, F.lit("["), own, F.lit(";"), own, F.lit("]"))).when(c("vid") % 4 == 1, F.concat("acc", F.lit("(GENE1)"), head, own)).otherwise(c("description"))
    rows = variants(spark, d).select("vid", text.alias("text")).union(spark.createDataFrame([(0, "[0]"), (0, "[?]")], "vid long, text string"))
    return rows.select("vid", K.kind_of(c("text")).alias("k")).select("vid", "k.*")


@query("e6_intron_depth", "SELECT vid, abs(off) > 50 AS deep, abs(off) IN (1, 2) AS canonical FROM (SELECT vid, CASE WHEN vid % 5 = 0 THEN NULL ELSE (s % 120) - 60 END AS off FROM variants)", "variants")
def e6(spark, d):
    off = F.when(c("vid") % 5 != 0, c("s") % 120 - 60)
    return variants(spark, d).select("vid", K.deep_intronic(off).alias("deep"), K.canonical_splice_site(off).alias("canonical"))


@query("e10_features", "SELECT f AS feature, v AS version, CASE f WHEN 'rna_fusion' THEN v IN ('19.1', '20.5', '21') WHEN 'supernumerary' THEN v IN ('20.5', '21') WHEN 'alleles' THEN true END AS supported FROM (SELECT unnest(['rna_fusion', 'supernumerary', 'alleles', 'nothing']) AS f) CROSS JOIN (SELECT unnest(['15.11', '19.0', '19.1', '20.5', '21']) AS v)")
def e10(spark, d):
    names, versions = ("rna_fusion", "supernumerary", "alleles", "nothing"), ("15.11", "19.0", "19.1", "20.5", "21")
    rows = spark.createDataFrame([(a, b) for a in names for b in versions], "feature string, version string")
    return rows.select("feature", "version", K.supported(c("feature"), c("version")).alias("supported"))


@query("e11_detectors", "SELECT edit, axis, count(*) AS n, count(*) FILTER (vid % 2 = 0 AND axis = 'g') AS offsets, count(*) FILTER (vid % 2 = 0 AND axis = 'c') AS introns FROM variants WHERE edit = 'sub' GROUP BY edit, axis", "variants")
def e11(spark, d):
    """Offsets on genomic positions and introns of bare transcripts."""
    text = F.when(c("vid") % 2 == 0, F.concat("acc", F.lit(":"), "axis", F.lit("."), c("s").cast("string"), F.lit("-12"), "ref", F.lit(">"), "alt")).otherwise(c("description"))
    x = variants(spark, d).where("edit = 'sub'").select("edit", "axis", K.detections(text).alias("x"))
    return x.groupBy("edit", "axis").agg(F.count("*").alias("n"), F.count_if(F.array_contains("x", "W4009")).alias("offsets"), F.count_if(F.array_contains("x", "W4007") & (c("axis") == "c")).alias("introns"))


@query("e12_rules", """SELECT vid, array_to_string(list_filter([CASE WHEN s > e2 THEN 'position_order' END, CASE WHEN edit = 'ins' AND e2 <> s + 1 THEN 'insertion_flanks' END, CASE WHEN edit = 'sub' AND ref = alt2 THEN 'same_base' END, CASE WHEN edit = 'sub' AND s <> e2 THEN 'substitution_range' END,
  CASE WHEN edit = 'inv' AND s = e2 THEN 'inversion_of_one' END, CASE WHEN edit IN ('ins', 'delins') AND alt2 = '' THEN 'empty_payload' END], lambda x: x IS NOT NULL), ',') AS broken
FROM (SELECT *, CASE vid % 5 WHEN 0 THEN s - 1 WHEN 1 THEN s ELSE e END AS e2, CASE WHEN vid % 3 = 0 THEN CASE edit WHEN 'sub' THEN ref ELSE '' END ELSE alt END AS alt2 FROM variants WHERE edit <> 'missense')""", "variants")
def e12(spark, d):
    v = variants(spark, d).where("edit <> 'missense'")
    e = F.when(c("vid") % 5 == 0, c("s") - 1).when(c("vid") % 5 == 1, c("s")).otherwise(c("e"))
    alt = F.when(c("vid") % 3 == 0, F.when(c("edit") == "sub", c("ref")).otherwise("")).otherwise(c("alt"))
    return v.select("vid", F.array_join(K.order_problems(c("s"), e, c("edit"), c("ref"), alt), ",").alias("broken"))


@query("h1_legacy", """SELECT vid, CASE edit WHEN 'ins' THEN description WHEN 'delins' THEN CASE WHEN e > s THEN description ELSE concat(acc, ':', axis, '.', s, 'A') END WHEN 'missense' THEN concat(acc, ':p.', ref, s, 'Ter') ELSE description END AS text,
  CASE edit WHEN 'ins' THEN 'insertion' WHEN 'delins' THEN CASE WHEN e > s THEN 'substitution' END WHEN 'missense' THEN 'protein' END AS form FROM variants""", "variants")
def h1(spark, d):
    """Older spellings of insertions, replacements and stops, among descriptions that are none."""
    old = F.expr("""CASE edit WHEN 'ins' THEN concat(acc, ':', axis, '.', s, 'ins', alt) WHEN 'delins' THEN CASE WHEN e > s THEN concat(acc, ':', axis, '.', s, '_', e, repeat('A', CAST(e - s + 1 AS INT)), '>', alt) ELSE concat(acc, ':', axis, '.', s, 'A') END
      WHEN 'missense' THEN concat(acc, ':p.', ref, s, 'stop') ELSE description END""")
    return variants(spark, d).select("vid", K.legacy(old).alias("x")).select("vid", "x.*")


@query("h4_legacy_protein", f"SELECT vid, CASE vid % 3 WHEN 0 THEN description WHEN 1 THEN concat(acc, ':p.', ref, s, 'Ter') ELSE concat(acc, ':p.', ref, s, alt, 'fsTer', 7) END AS text FROM variants WHERE edit = 'missense'", "variants")
def h4(spark, d):
    old = F.expr(f"CASE vid % 3 WHEN 0 THEN concat(acc, ':p.', {_INSTR.format('ref')}, s, {_INSTR.format('alt')}) WHEN 1 THEN concat(acc, ':p.', {_INSTR.format('ref')}, s, 'X') ELSE concat(acc, ':p.', ref, s, alt, 'fs*', 7) END")
    return variants(spark, d).where("edit = 'missense'").select("vid", K.legacy_protein(old).alias("text"))


@query("h5_gene_selectors", "SELECT vid, CASE WHEN vid % 2 = 0 THEN concat('NG_', substr(acc, 4)) END AS accession, CASE WHEN vid % 2 = 0 THEN 'GENE' END AS gene, CASE WHEN vid % 2 = 0 THEN 1 + vid % 9 END::INT AS number FROM variants WHERE axis = 'c'", "variants")
def h5(spark, d):
    old = F.when(c("vid") % 2 == 0, F.expr("concat('NG_', substr(acc, 4), '(GENE_v00', 1 + vid % 9, '):', substr(description, length(acc) + 2))")).otherwise(c("description"))
    return variants(spark, d).where("axis = 'c'").select("vid", K.gene_selector(old).alias("g")).select("vid", "g.*")


_MODES = """, x AS (SELECT *, CASE vid % 4 WHEN 0 THEN 'sound' WHEN 1 THEN 'case' WHEN 2 THEN 'zero' ELSE 'odd' END AS what FROM variants WHERE edit IN ('del', 'dup') AND axis = 'g')
"""


def _mode(name: str, mode: str, case_status: str, case_warned: bool):
    sql = _MODES + f"""SELECT vid, CASE what WHEN 'sound' THEN 'ok' WHEN 'case' THEN '{case_status}' WHEN 'zero' THEN 'preprocess_error' ELSE 'parse_error' END AS status,
      CASE what WHEN 'case' THEN {"'W1003'" if case_status != "ok" else "NULL"} WHEN 'zero' THEN 'E1003' WHEN 'odd' THEN 'no accession' END AS error, CASE WHEN what = 'case' THEN '{"W1003" if case_warned else ""}' ELSE '' END AS warnings,
      CASE WHEN what = 'sound' OR (what = 'case' AND '{case_status}' = 'ok') THEN description END AS canonical FROM x"""

    @query(name, sql, "variants")
    def run(spark, d):
        """A quarter of the descriptions is sound, one has its accession in lower case, one a position 0, one no accession."""
        text = F.expr("CASE vid % 4 WHEN 0 THEN description WHEN 1 THEN concat('nc', substr(description, 3)) WHEN 2 THEN concat(acc, ':g.0', edit) ELSE concat('?', description) END")
        x = variants(spark, d).where("edit IN ('del', 'dup') AND axis = 'g'").select("vid", text.alias("text"))
        return K.parse_in_mode(x, "vid", "text", mode).select("vid", "status", "error", F.array_join("warnings", ",").alias("warnings"), "canonical")


_mode("c5_lenient", "lenient", "ok", True)
_mode("c5_strict", "strict", "preprocess_error", False)
_mode("c5_silent", "silent", "ok", False)


@query("q11_consequences", """SELECT vid, CASE WHEN kind = 0 THEN 'non_coding_transcript_variant' WHEN kind = 1 THEN CASE WHEN abs(off) <= 2 THEN 'splice_region_variant' ELSE 'intron_variant' END WHEN kind = 2 THEN '5_prime_UTR_variant' WHEN kind = 3 THEN '3_prime_UTR_variant'
  ELSE CASE WHEN edit = 'sub' THEN 'sequence_variant' WHEN net % 3 <> 0 THEN 'frameshift_variant' WHEN edit IN ('ins', 'dup') THEN 'inframe_insertion' WHEN edit IN ('del', 'delins') THEN 'inframe_deletion' ELSE 'sequence_variant' END END AS term
FROM (SELECT vid, edit, vid % 5 AS kind, (s % 9) + 1 AS off, CASE edit WHEN 'del' THEN -(e - s + 1) WHEN 'dup' THEN e - s + 1 WHEN 'ins' THEN length(alt) WHEN 'delins' THEN length(alt) - (e - s + 1) ELSE 0 END AS net FROM variants WHERE edit <> 'missense')""", "variants")
def q11(spark, d):
    """What an annotation says, by zone first and then by edit."""
    from nomenspark.functions.descriptions import indel_length

    v = variants(spark, d).where("edit <> 'missense'")
    kind = c("vid") % 5
    term = E.annotated_consequence(kind != 0, F.when(kind == 1, c("s") % 9 + 1), kind == 2, kind == 3, c("edit"), indel_length(c("edit"), c("s"), c("e"), c("alt")))
    return v.select("vid", term.alias("term"))
