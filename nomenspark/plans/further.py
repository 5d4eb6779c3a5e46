"""Further queries over positions, effects, accessions and statistics, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import descriptions as D
from nomenspark.functions import effects as E
from nomenspark.functions import grammar
from nomenspark.functions import sequences as S
from nomenspark.operators import analytics as A
from nomenspark.operators import contigs as K
from nomenspark.operators import coordinates as C
from nomenspark.operators import lookups as L

from .effect import _CODE, CONTIGS, records
from .genomics import _LIFT, lift_points
from .registry import Registry
from .sequence import _CANONICAL, _KEY
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table


@query("j1_checked_bases", "SELECT vid, CASE WHEN p >= 1 THEN p - 1 END AS zero, CASE WHEN p >= 0 THEN p + 1 END AS one, CASE WHEN p >= 1 THEN p - 1 END AS lo, CASE WHEN p >= 1 THEN p + 4 END AS hi FROM (SELECT vid, CASE vid % 5 WHEN 0 THEN 0 WHEN 1 THEN -g ELSE g END AS p FROM points)", "points")
def j1(spark, d):
    """Positions of either base, some of which there are none of."""
    p = F.when(c("vid") % 5 == 0, 0).when(c("vid") % 5 == 1, -c("g")).otherwise(c("g"))
    x = t(spark, d, "points").select("vid", p.alias("p"))
    return x.select("vid", C.to_zero(c("p")).alias("zero"), C.to_one(c("p")).alias("one"), C.to_half_open(c("p"), c("p") + 4).alias("i")).select("vid", "zero", "one", "i.lo", "i.hi")


@query("j3_residue_to_bases", "SELECT vid, 3 * s - 2 AS lo, 3 * s AS hi FROM variants WHERE edit = 'missense'", "variants")
def j3(spark, d):
    return variants(spark, d).where("edit = 'missense'").select("vid", C.codon_bases(c("s")).alias("b")).select("vid", "b.lo", "b.hi")


@query("j11_positions_by_axis", "SELECT vid, axis, CASE axis WHEN 'c' THEN p <> 0 AND CASE WHEN p > 0 THEN 31 + p - 1 ELSE 31 + p END BETWEEN 1 AND 900 WHEN 'p' THEN p BETWEEN 1 AND 257 ELSE p BETWEEN 1 AND 900 END AS valid FROM (SELECT vid, axis, s - 60 AS p FROM variants)", "variants")
def j11(spark, d):
    """On a transcript of 900 bases that codes from 31 to 801."""
    v = C.valid_position(c("axis"), c("s") - 60, F.lit(900), F.lit(31), F.lit(801))
    return variants(spark, d).select("vid", "axis", v.alias("valid"))


@query("w6_structure", "SELECT tx, number, t0, t1 FROM exons", "exons")
def w6(spark, d):
    """Exons known on the contig alone, put one after another."""
    return C.structure(t(spark, d, "exons").select("tx", "strand", "x0", "x1")).select("tx", "number", "t0", "t1")


@query("r7_context_changes", "SELECT vid, CASE WHEN b < a THEN 'weakened' WHEN b > a THEN 'strengthened' ELSE 'kept' END AS change FROM (SELECT vid, CASE WHEN substr(w, 4, 1) IN ('A', 'G') THEN 1 ELSE 0 END + CASE WHEN substr(w, 10, 1) = 'G' THEN 1 ELSE 0 END AS a, CASE WHEN substr(w, 4, 1) IN ('C', 'T') THEN 1 ELSE 0 END + CASE WHEN substr(w, 10, 1) = 'G' THEN 1 ELSE 0 END AS b FROM (SELECT vid, substr(seq, s + 1, 10) AS w FROM edits))", "edits")
def r7(spark, d):
    """The third base before a start changed to its partner: A to C, G to T and back."""
    w = S.part(c("seq"), c("s"), F.lit(10))
    new = F.concat(F.substring(w, 1, 3), F.translate(F.substring(w, 4, 1), "ACGT", "CATG"), F.substring(w, 5, 6))
    return t(spark, d, "edits").select("vid", E.start_context_change(w, new).alias("change"))


@query("r6_frameshift_decay", "SELECT vid, CASE WHEN vid % 4 = 0 THEN NULL WHEN p >= 900 THEN 'not_premature' WHEN p >= 800 THEN 'last_exon' WHEN 800 - p > 55 THEN 'high' WHEN 800 - p >= 50 THEN 'medium' ELSE 'near_junction' END AS why FROM (SELECT vid, 31 + 3 * (s % 290 + 1 + 7 - 2) AS p FROM variants)", "variants")
def r6(spark, d):
    """Frameshifts whose new stop is seven codons on; a quarter finds none."""
    effect = F.struct(F.lit("frameshift").alias("kind"), (c("s") % 290 + 1).alias("number"), F.when(c("vid") % 4 != 0, 7).alias("distance"))
    return variants(spark, d).select("vid", E.frameshift_decay(F.lit(3), effect, F.lit(31), F.lit(900), F.lit(800))["why"].alias("why"))


@query("s4_stop_loss", "WITH " + _CODE.removeprefix(", ") + " SELECT b.aa, count(*)::INT AS n FROM codes a JOIN codes b ON a.aa = '*' AND b.aa <> '*' AND hamming(a.codon, b.codon) = 1 GROUP BY b.aa")
def s4(spark, d):
    """Changes of one base that turn a stop into each residue; those that none does go."""
    x = spark.createDataFrame([(a,) for a in "ACDEFGHIKLMNPQRSTVWY"], "aa string")
    return x.select("aa", F.size(E.back_translate(F.lit("*"), c("aa"))).alias("n")).where("n > 0")


@query("t4_descriptions", "SELECT k, concat('NP_1.1:p.(', CASE k % 4 WHEN 0 THEN 'Met1?' WHEN 1 THEN concat('Ala', k, '=') WHEN 2 THEN concat('Ter', k, 'Glnext*?') ELSE concat('Arg', k, 'Trp') END, ')') AS description FROM sequences WHERE k > 1", "sequences")
def t4(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (c("k") % 4 + 1).cast("int"))
    number = F.when(c("k") % 4 == 0, F.lit(1).cast("long")).otherwise(c("k"))
    return t(spark, d, "sequences").where("k > 1").select("k", E.protein_description(F.lit("NP_1.1"), number, pick("M", "A", "*", "R"), pick("V", "A", "Q", "W")).alias("description"))


@query("t5_in_frame", """SELECT k, CASE k % 5 WHEN 0 THEN '=' WHEN 1 THEN 'Gly4_Cys6del' WHEN 2 THEN 'Leu5dup' WHEN 3 THEN 'Gly4_Leu5insTrpPro' ELSE 'Gly4_Leu5delinsTrpTrpTrp' END AS edit FROM sequences
UNION ALL SELECT -1, 'Lys5del' UNION ALL SELECT -2, 'Arg2Trp'""", "sequences")
def t5(spark, d):
    """Proteins that differ by whole residues: none, three gone, one doubled, two put in, two replaced by three; one of a run
    gone, which is its last, and one replaced."""
    new = F.element_at(F.array(*map(F.lit, ("MARGLCDE", "MARDE", "MARGLLCDE", "MARGWPLCDE", "MARWWWCDE"))), (c("k") % 5 + 1).cast("int"))
    rows = t(spark, d, "sequences").select("k", F.lit("MARGLCDE").alias("a"), new.alias("b")).union(spark.createDataFrame([(-1, "MAKKKE", "MAKKE"), (-2, "MRL", "MWL")], "k long, a string, b string"))
    return rows.select("k", E.protein_edit(c("a"), c("b")).alias("edit"))


@query("c6_whole_accessions", """SELECT vid, CASE vid % 3 WHEN 0 THEN 'assembly' WHEN 1 THEN 'nested' ELSE 'refseq' END AS kind, CASE WHEN vid % 3 = 0 THEN 'GRCh38' END AS assembly, CASE WHEN vid % 3 = 0 THEN 'chr7' END AS chromosome,
  CASE WHEN vid % 3 = 1 THEN 'NC_000007.14' END AS context, CASE WHEN vid % 3 <> 0 THEN acc END AS inner_ FROM variants""", "variants")
def c6(spark, d):
    acc = F.when(c("vid") % 3 == 0, "GRCh38(chr7)").when(c("vid") % 3 == 1, F.concat(F.lit("NC_000007.14("), "acc", F.lit(")"))).otherwise(c("acc"))
    return variants(spark, d).select("vid", D.accession_whole(acc).alias("a")).select("vid", "a.kind", "a.assembly", "a.chromosome", "a.context", c("a.inner").alias("inner_"))


@query("e1_mitochondrion", "SELECT accession, accession = 'NC_012920.1' AS mitochondrial FROM (SELECT unnest(['NC_012920.1', 'NC_000001.11', 'NM_012920.1']) AS accession)")
def e1(spark, d):
    x = spark.createDataFrame([("NC_012920.1",), ("NC_000001.11",), ("NM_012920.1",)], "accession string")
    return x.select("accession", D.is_mitochondrial(c("accession")).alias("mitochondrial"))


@query("d1_whole_grammar", "SELECT vid, text, true AS same FROM (SELECT vid, unnest([concat(acc, ':g.[', s, 'del;', e + 9, 'A>G]'), concat(acc, ':g.[', s, 'del];[', e + 9, 'dup]'), concat(acc, ':g.', s, 'CAG[12]'), concat(acc, ':g.', s, '_', s + 9, 'inv'), concat(acc, ':g.', s, '_', s + 9, 'del::', s + 50, '_', s + 60, 'del')]) AS text FROM variants WHERE edit = 'del' AND axis = 'g')", "variants")
def d1(spark, d):
    """Canonical texts of alleles, repeats, inversions and rings are written as they were read."""
    forms = F.expr("explode(array(concat(acc, ':g.[', s, 'del;', e + 9, 'A>G]'), concat(acc, ':g.[', s, 'del];[', e + 9, 'dup]'), concat(acc, ':g.', s, 'CAG[12]'), concat(acc, ':g.', s, '_', s + 9, 'inv'), concat(acc, ':g.', s, '_', s + 9, 'del::', s + 50, '_', s + 60, 'del')))")
    x = variants(spark, d).where("edit = 'del' AND axis = 'g'").select("vid", forms.alias("text"))
    return grammar.parse_all(x, "vid", "text").select("vid", "text", (c("canonical") == c("text")).alias("same"))


@query("a3_lines_with_build", CONTIGS + "SELECT vid, accession, pos, CASE WHEN accession IS NULL THEN 'unknown_contig' END AS contig_error FROM vcf LEFT JOIN contigs USING (chrom)", "vcf")
def a3(spark, d):
    """Record lines read for a build."""
    from nomenspark.functions import vcf as V

    line = F.concat_ws("\t", "chrom", c("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."))
    x = records(spark, d).select("vid", V.parse_line(line).alias("r")).select("vid", "r.chrom", "r.pos")
    return K.with_accession(x, K.aliases(spark), "chrom", "hg38").select("vid", "accession", "pos", "contig_error")


@query("o3_with_reference", _CANONICAL + """SELECT vid, concat(acc, ':g.', CASE c.edit WHEN 'ins' THEN concat(c.s, '_', c.s + 1, 'ins', c.alt) WHEN 'sub' THEN concat(c.s + 1, substr(seq, (c.s + 1)::INT, 1), '>', c.alt)
  WHEN 'identity' THEN concat(CASE WHEN c.e > c.s + 1 THEN concat(c.s + 1, '_', c.e) ELSE concat(c.s + 1) END, '=') ELSE concat(CASE WHEN c.e > c.s + 1 THEN concat(c.s + 1, '_', c.e) ELSE concat(c.s + 1) END, c.edit, c.alt) END) AS description FROM f""", "edits")
def o3(spark, d):
    """SPDI read with its reference at hand: duplications are found again."""
    text = S.spdi(c("acc"), c("s"), S.part(c("seq"), c("s"), c("e") - c("s")), c("payload"))
    x = t(spark, d, "edits").select("vid", "seq", S.parse_spdi(text).alias("v"))
    at = c("v.position").cast("int")
    x = x.select("vid", "seq", "v.sequence", S.canonical(c("seq"), at, (at + F.length("v.deletion")).cast("int"), c("v.insertion")).alias("c"))
    return x.select("vid", S.described(c("sequence"), c("seq"), c("c")).alias("description"))


@query("o7_constructors", "SELECT vid, concat_ws(':', acc, CASE edit WHEN 'ins' THEN s ELSE s - 1 END, CASE edit WHEN 'sub' THEN ref WHEN 'del' THEN 'ACG' WHEN 'delins' THEN 'AC' ELSE '' END, CASE edit WHEN 'del' THEN '' ELSE alt END) AS spdi FROM variants WHERE edit IN ('sub', 'del', 'ins', 'delins')", "variants")
def o7(spark, d):
    made = (
        F.when(c("edit") == "sub", S.spdi_substitution(c("acc"), c("s"), c("ref"), c("alt"))).when(c("edit") == "del", S.spdi_deletion(c("acc"), c("s"), F.lit("ACG")))
        .when(c("edit") == "ins", S.spdi_insertion(c("acc"), c("s"), c("alt"))).when(c("edit") == "delins", S.spdi_delins(c("acc"), c("s"), F.lit("AC"), c("alt")))
    )
    return variants(spark, d).where("edit IN ('sub', 'del', 'ins', 'delins')").select("vid", made.alias("spdi"))


@query("p6_with_unkeyable", _KEY + "SELECT CASE WHEN vid % 8 = 0 THEN NULL ELSE key END AS key, count(*) AS n, vid % 8 = 0 AS unkeyable FROM w GROUP BY ALL", "edits")
def p6(spark, d):
    """Changes by key, and those without one together."""
    key = F.when(c("vid") % 8 != 0, S.canonical_spdi(c("acc"), c("seq"), c("s"), c("e"), c("payload")))
    return t(spark, d, "edits").select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("unkeyable", c("key").isNull())


@query("u3_best_chains", _LIFT.format(at="p1").replace("FROM lifts)", "FROM (SELECT vid, min((contig, p1, len)) AS m, m[1] AS contig, m[2] AS p1 FROM lifts GROUP BY vid))") + "SELECT p.vid, l.chain, l.chain IS NOT NULL AND q IS NULL AS gap FROM pts p LEFT JOIN lifted l ON p.vid = l.vid", "lifts", "chain_blocks")
def u3(spark, d):
    """The chain that each point goes through, and whether it falls in one of its gaps."""
    x = L.lift(lift_points(spark, d), t(spark, d, "chain_blocks"), "vid", "contig", "p1")
    return x.select("vid", "chain", (c("status") == "gap").alias("gap"))


@query("v3_lookups", "SELECT vcv, rs, gene FROM clinvar WHERE vcv % 3 = 0 UNION ALL SELECT vcv, rs, gene FROM clinvar JOIN (SELECT DISTINCT rs FROM rsids WHERE rs % 5 = 0) USING (rs)", "clinvar", "rsids")
def v3(spark, d):
    """Records by their own ids and by rs number: joins with what is asked for."""
    x = t(spark, d, "clinvar")
    ids = x.select("vcv").where("vcv % 3 = 0").distinct()
    numbers = t(spark, d, "rsids").where("rs % 5 = 0").select("rs").distinct()
    return x.join(ids, "vcv", "left_semi").select("vcv", "rs", "gene").union(x.join(numbers, "rs", "left_semi").select("vcv", "rs", "gene"))


@query("v4_sides", "SELECT CASE WHEN significance IN ('Pathogenic', 'Likely pathogenic') THEN 'pathogenic' WHEN significance IN ('Benign', 'Likely benign') THEN 'benign' ELSE 'uncertain' END AS side, gene, count(*) AS n FROM clinvar GROUP BY ALL", "clinvar")
def v4(spark, d):
    return t(spark, d, "clinvar").groupBy(D.significance_side(c("significance")).alias("side"), "gene").agg(F.count("*").alias("n"))


@query("y4_speedups", "SELECT shard, tool, count(*) AS total, count(*) FILTER (ok) AS ok, round(count(*) / sum(seconds), 6) AS rate, round((count(*) / sum(seconds)) / max(b.rate), 6) AS speedup FROM tool_runs LEFT JOIN (SELECT shard, count(*) / sum(seconds) AS rate FROM tool_runs WHERE tool = 'left' GROUP BY shard) b USING (shard) GROUP BY shard, tool", "tool_runs")
def y4(spark, d):
    return A.throughput(t(spark, d, "tool_runs"), ["shard", "tool"], {"tool": "left"})


@query("y6_categories", "SELECT category, CASE WHEN input % 10 = 0 THEN 'override' ELSE 'none' END AS verdict, count(*) AS n FROM tool_runs GROUP BY ALL", "tool_runs")
def y6(spark, d):
    x = t(spark, d, "tool_runs")
    overrides = x.select("input").distinct().where("input % 10 = 0").withColumn("verdict", F.lit("override"))
    return A.arbitrate(x, overrides, "input").groupBy("category", "verdict").agg(F.count("*").alias("n"))


@query("y9_missing", "SELECT acc AS tx, count(*) AS n FROM variants WHERE acc NOT IN (SELECT tx FROM transcripts) GROUP BY acc", "variants", "transcripts")
def y9(spark, d):
    return A.missing(variants(spark, d).select(c("acc").alias("tx")), t(spark, d, "transcripts"), "tx")
