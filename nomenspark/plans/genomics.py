"""Queries over transcripts, exons, contigs, chains and identifiers, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import descriptions as D
from nomenspark.functions import sequences as S
from nomenspark.operators import analytics as A
from nomenspark.operators import contigs as K
from nomenspark.operators import coordinates as C
from nomenspark.operators import lookups as L
from nomenspark.operators.intervals import stab

from .effect import CONTIGS
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table

_N = """, cn AS (SELECT vid, tx, base, off, utr3, CASE WHEN n >= 1 THEN n END AS n FROM (SELECT p.*, CASE WHEN utr3 THEN cds_end + base WHEN base < 0 THEN cds_start + base ELSE cds_start + base - 1 END AS n FROM cpos p JOIN transcripts USING (tx)))
"""


@query("j1_bases", "SELECT vid, g - 1 AS zero, g AS one, g - 1 AS lo, g + 4 AS hi FROM points", "points")
def j1(spark, d):
    """1-based to 0-based and back; a 1-based inclusive interval as a half-open one."""
    zero = c("g") - 1
    return t(spark, d, "points").select("vid", zero.alias("zero"), (zero + 1).alias("one"), zero.alias("lo"), (c("g") + 4).alias("hi"))


@query("j2_c_to_n", _N + "SELECT vid, tx, base, n FROM cn", "cpos", "transcripts")
def j2(spark, d):
    return C.cds_to_tx(t(spark, d, "cpos"), t(spark, d, "transcripts")).select("vid", "tx", "base", "n")


@query("j2_n_to_c", _N + "SELECT vid, tx, n, CASE WHEN n > cds_end THEN n - cds_end WHEN n < cds_start THEN n - cds_start ELSE n - cds_start + 1 END AS base, n > cds_end AS utr3 FROM cn JOIN transcripts USING (tx) WHERE n IS NOT NULL", "cpos", "transcripts")
def j2b(spark, d):
    n = j2(spark, d).where("n IS NOT NULL").select("vid", "tx", "n")
    return C.tx_to_cds(n, t(spark, d, "transcripts"))


@query("j3_codons", "SELECT vid, ((base - 1) // 3 + 1)::BIGINT AS number, ((base - 1) % 3)::INT AS frame, 3 * ((base - 1) // 3) + 1 AS first FROM cpos WHERE base >= 1 AND NOT utr3", "cpos")
def j3(spark, d):
    x = t(spark, d, "cpos").where("base >= 1 AND NOT utr3").select("vid", C.codon(c("base")).alias("k"))
    return x.select("vid", "k.number", "k.frame", (3 * (c("k.number") - 1) + 1).alias("first"))


@query("j5_c_to_g", _N + """SELECT vid, tx, n, contig, CASE WHEN strand = 1 THEN x0 + n - t0 + coalesce(off, 0) ELSE x1 - (n - 1 - t0) - coalesce(off, 0) END AS g
FROM cn JOIN exons USING (tx) WHERE n > t0 AND n <= t1""", "cpos", "transcripts", "exons")
def j5(spark, d):
    n = C.cds_to_tx(t(spark, d, "cpos"), t(spark, d, "transcripts"))
    return C.tx_to_genome(n, t(spark, d, "exons")).select("vid", "tx", "n", "contig", "g")


@query("j4_g_to_n", "SELECT vid, tx, t0 + 1 + CASE WHEN strand = 1 THEN g - 1 - x0 ELSE x1 - g END AS n FROM points p JOIN exons e ON p.contig = e.contig AND g - 1 >= x0 AND g - 1 < x1", "points", "exons")
def j4(spark, d):
    return C.genome_to_tx(t(spark, d, "points"), t(spark, d, "exons")).select("vid", "tx", "n")


@query("j4_g_to_c", """SELECT vid, tx, CASE WHEN n > cds_end THEN n - cds_end WHEN n < cds_start THEN n - cds_start ELSE n - cds_start + 1 END AS base, n > cds_end AS utr3
FROM (SELECT vid, tx, t0 + 1 + CASE WHEN strand = 1 THEN g - 1 - x0 ELSE x1 - g END AS n FROM points p JOIN exons e ON p.contig = e.contig AND g - 1 >= x0 AND g - 1 < x1) JOIN transcripts USING (tx)""", "points", "exons", "transcripts")
def j4c(spark, d):
    return C.tx_to_cds(j4(spark, d), t(spark, d, "transcripts")).select("vid", "tx", "base", "utr3")


_INTRONS = """, introns AS (SELECT a.tx, a.contig, a.strand, a.number, a.t1 AS l, CASE WHEN a.strand = 1 THEN a.x1 ELSE b.x1 END AS x0, CASE WHEN a.strand = 1 THEN b.x0 ELSE a.x0 END AS x1
FROM exons a JOIN exons b ON a.tx = b.tx AND b.number = a.number + 1)
"""


@query("j6_introns", _INTRONS + "SELECT tx, number, l AS left, x0, x1 FROM introns", "exons")
def j6(spark, d):
    return C.introns(t(spark, d, "exons")).select("tx", "number", "left", "x0", "x1")


@query("j6_intron_positions", _INTRONS + """SELECT vid, tx, number, CASE WHEN a <= x1 - x0 - a + 1 THEN l ELSE l + 1 END AS n, CASE WHEN a <= x1 - x0 - a + 1 THEN a ELSE -(x1 - x0 - a + 1) END AS off
FROM (SELECT p.vid, i.*, CASE WHEN strand = 1 THEN g - x0 ELSE x1 - g + 1 END AS a FROM points p JOIN introns i ON p.contig = i.contig AND g - 1 >= x0 AND g - 1 < x1)""", "points", "exons")
def j6p(spark, d):
    return C.intron_position(t(spark, d, "points"), t(spark, d, "exons")).select("vid", "tx", "number", "n", "off")


@query("j12_exon_of_position", _N + "SELECT vid, number, least(n - t0 - 1, t1 - n) AS distance FROM cn JOIN exons USING (tx) WHERE n > t0 AND n <= t1", "cpos", "transcripts", "exons")
def j12(spark, d):
    x = j2(spark, d).join(t(spark, d, "exons").select("tx", "number", "t0", "t1"), "tx").where("n > t0 AND n <= t1")
    return x.select("vid", "number", F.least(c("n") - c("t0") - 1, c("t1") - c("n")).alias("distance"))


@query("j11_valid_positions", _N + "SELECT vid, tx, coalesce(n BETWEEN 1 AND len1 + len2 + len3, false) AS valid FROM cn JOIN transcripts USING (tx)", "cpos", "transcripts")
def j11(spark, d):
    x = j2(spark, d).join(t(spark, d, "transcripts").select("tx", (c("len1") + c("len2") + c("len3")).alias("len")), "tx")
    return x.select("vid", "tx", F.coalesce(c("n").between(1, c("len")), F.lit(False)).alias("valid"))


_HITS = ", hits AS (SELECT p.vid, x.tx, x.mane, x.cds_start FROM points p JOIN transcripts x ON p.contig = x.contig AND g > g0 AND g <= g0 + len1 + len2 + len3 + 400)\n"


def hits(spark, d):
    x = t(spark, d, "transcripts").withColumn("g1", c("g0") + c("len1") + c("len2") + c("len3") + 400)
    return stab(t(spark, d, "points").withColumn("at", c("g") - 1), x, "contig", "at", "g0", "g1")


@query("k4_transcripts_at_position", _HITS + "SELECT vid, tx FROM hits", "points", "transcripts")
def k4(spark, d):
    return hits(spark, d).select("vid", "tx")


@query("j10_ranked_transcripts", _HITS + """, v AS (SELECT *, row_number() OVER (PARTITION BY vid, regexp_replace(tx, '\\.\\d+$', '') ORDER BY regexp_extract(tx, '\\.(\\d+)$', 1)::INT DESC) AS r FROM hits),
u AS (SELECT *, bool_or(tx[1] = 'N') OVER (PARTITION BY vid) AS curated FROM v WHERE r = 1)
SELECT vid, tx, row_number() OVER (PARTITION BY vid ORDER BY CASE mane WHEN 'select' THEN 0 WHEN 'plus_clinical' THEN 1 ELSE CASE WHEN cds_start IS NULL THEN 3 ELSE 2 END END, tx)::INT AS rank
FROM u WHERE tx[1] = 'N' OR NOT curated""", "points", "transcripts")
def j10(spark, d):
    one = hits(spark, d).groupBy("vid", "tx").agg(F.first("mane").alias("mane"), F.first("cds_start").alias("cds_start"))
    return L.ranked(one, "vid").select("vid", "tx", "rank")


ORACLE["j10_ranked_transcripts"] = ORACLE["j10_ranked_transcripts"].replace("FROM hits)", "FROM (SELECT DISTINCT * FROM hits))")


@query("k2_newest_version", "SELECT regexp_replace(tx, '\\.\\d+$', '') AS base, max_by(tx, regexp_extract(tx, '\\.(\\d+)$', 1)::INT) AS tx FROM transcripts GROUP BY 1", "transcripts")
def k2(spark, d):
    return L.newest(t(spark, d, "transcripts"))


@query("k1_resolve", """, w AS (SELECT k, CASE WHEN k % 3 = 0 THEN regexp_replace(tx, '\\.\\d+$', '.9') WHEN k % 3 = 1 THEN tx ELSE 'NM_999999.1' END AS acc FROM transcripts)
SELECT k, acc, CASE WHEN acc IN (SELECT tx FROM transcripts) THEN acc ELSE (SELECT max(tx) FROM transcripts x WHERE regexp_replace(x.tx, '\\.\\d+$', '') = regexp_replace(acc, '\\.\\d+$', '')) END AS found FROM w""", "transcripts")
def k1(spark, d):
    x = t(spark, d, "transcripts")
    acc = F.when(c("k") % 3 == 0, F.regexp_replace("tx", r"\.\d+$", ".9")).when(c("k") % 3 == 1, c("tx")).otherwise("NM_999999.1")
    return L.resolve(x.select("k", acc.alias("acc")), x)


@query("k3_windows", "SELECT vid, acc, s, e, substr(seq, s + 1, e - s) AS bases FROM (SELECT DISTINCT vid, acc, seq, s, s + 70 + vid % 40 AS e FROM (SELECT vid, acc, seq, s::BIGINT AS s FROM edits))", "edits")
def k3(spark, d):
    """An accession has six digits of a part's number and may name several sequences; they are told apart by their digest too."""
    digest, by = F.unhex(F.md5("seq")).alias("digest"), ("acc", "digest")
    need = t(spark, d, "edits").select("vid", "acc", digest, c("s").cast("long").alias("s")).withColumn("e", c("s") + 70 + c("vid") % 40).distinct()
    held = t(spark, d, "sequences").select("acc", digest, "seq").dropDuplicates(list(by))
    return L.window(need, L.chunks(held, by=by), "vid", by=by).drop("digest")


@query("k5_preferred", """SELECT gene, arg_min(tx, (rank, tx)) AS tx, min(rank)::INT AS rank FROM (SELECT gene, tx, CASE mane WHEN 'select' THEN 0 WHEN 'plus_clinical' THEN 1 ELSE CASE WHEN cds_start IS NULL THEN 3 ELSE 2 END END AS rank FROM transcripts) GROUP BY gene""", "transcripts")
def k5(spark, d):
    return L.preferred(t(spark, d, "transcripts"))


@query("k6_mane_statistics", "SELECT count(*) AS transcripts, count(DISTINCT gene) AS genes, count(*) FILTER (mane = 'select') AS n_select, count(*) FILTER (mane = 'plus_clinical') AS n_plus, count(DISTINCT CASE WHEN mane <> 'none' THEN gene END) AS genes_mane FROM transcripts", "transcripts")
def k6(spark, d):
    return t(spark, d, "transcripts").agg(
        F.count("*").alias("transcripts"), F.count_distinct("gene").alias("genes"), F.count_if(c("mane") == "select").alias("n_select"),
        F.count_if(c("mane") == "plus_clinical").alias("n_plus"), F.count_distinct(F.when(c("mane") != "none", c("gene"))).alias("genes_mane"))


@query("k7_contig_names", CONTIGS + """SELECT DISTINCT contig, chrom AS name, 'GRCh38' AS build FROM points JOIN contigs ON accession = contig""", "points")
def k7(spark, d):
    """Contig accessions as names and builds, by the table of aliases."""
    return K.named(t(spark, d, "points").select("contig").distinct(), K.aliases(spark), "contig").select("contig", "name", "build")


_LIFT = """, spans AS (SELECT DISTINCT chain, score, t_name, q_name, q_strand, q_size, t_lo, t_hi FROM chain_blocks), pts AS (SELECT DISTINCT vid, contig, {at} AS p1 FROM lifts),
best AS (SELECT vid, p1, arg_max(chain, (score, chain)) AS chain, count(*) > 1 AS several FROM pts JOIN spans ON contig = t_name AND p1 - 1 >= t_lo AND p1 - 1 < t_hi GROUP BY vid, p1),
lifted AS (SELECT b.vid, b.p1, b.chain, several, max(q_name) AS q_name, max(CASE WHEN p1 - 1 >= t0 AND p1 - 1 < t1 THEN CASE q_strand WHEN '-' THEN q_size - (q0 + p1 - 1 - t0) ELSE q0 + p1 - t0 END END) AS q
  FROM best b JOIN chain_blocks c ON b.chain = c.chain GROUP BY ALL)
"""


def lift_points(spark, d):
    return t(spark, d, "lifts").groupBy("vid").agg(F.min(F.struct("contig", "p1", "len")).alias("m")).select("vid", "m.*")


@query("u1_lift", _LIFT.format(at="p1").replace("FROM lifts)", "FROM (SELECT vid, min((contig, p1, len)) AS m, m[1] AS contig, m[2] AS p1 FROM lifts GROUP BY vid))") + """SELECT p.vid, CASE WHEN l.chain IS NULL THEN 'no_chain' WHEN q IS NULL THEN 'gap' ELSE 'lifted' END AS status, CASE WHEN q IS NOT NULL THEN q_name END AS contig, q, l.chain, coalesce(several, false) AS several
FROM pts p LEFT JOIN lifted l ON p.vid = l.vid""", "lifts", "chain_blocks")
def u1(spark, d):
    return L.lift(lift_points(spark, d), t(spark, d, "chain_blocks"), "vid", "contig", "p1")


@query("u2_lift_intervals", """, spans AS (SELECT DISTINCT chain, score, t_name, q_name, q_strand, q_size, t_lo, t_hi FROM chain_blocks),
pts AS (SELECT vid, m[1] AS contig, m[2] AS p1, m[3] AS len FROM (SELECT vid, min((contig, p1, len)) AS m FROM lifts GROUP BY vid)),
ends AS (SELECT vid, 'a' AS w, contig, p1 AS p FROM pts UNION ALL SELECT vid, 'b', contig, p1 + len FROM pts),
best AS (SELECT vid, w, p, arg_max(chain, (score, chain)) AS chain FROM ends JOIN spans ON contig = t_name AND p - 1 >= t_lo AND p - 1 < t_hi GROUP BY vid, w, p),
lifted AS (SELECT b.vid, b.w, b.chain, max(q_name) AS q_name, max(CASE WHEN p - 1 >= t0 AND p - 1 < t1 THEN CASE q_strand WHEN '-' THEN q_size - (q0 + p - 1 - t0) ELSE q0 + p - t0 END END) AS q FROM best b JOIN chain_blocks c ON b.chain = c.chain GROUP BY b.vid, b.w, b.chain),
j AS (SELECT p.vid, a.chain AS ac, b.chain AS bc, a.q AS aq, b.q AS bq, a.q_name AS name FROM pts p LEFT JOIN lifted a ON a.vid = p.vid AND a.w = 'a' LEFT JOIN lifted b ON b.vid = p.vid AND b.w = 'b'),
k AS (SELECT *, CASE WHEN ac IS NULL AND bc IS NULL THEN 'no_chain' WHEN ac IS DISTINCT FROM bc THEN 'split' WHEN aq IS NOT NULL AND bq IS NOT NULL THEN 'success' WHEN aq IS NOT NULL OR bq IS NOT NULL THEN 'partial' ELSE 'unmappable' END AS status FROM j)
SELECT vid, status, CASE WHEN status = 'success' THEN name END AS contig, CASE WHEN status = 'success' THEN least(aq, bq) END AS lo, CASE WHEN status = 'success' THEN greatest(aq, bq) END AS hi, CASE WHEN status = 'partial' THEN 0.5::DOUBLE END AS fraction FROM k""", "lifts", "chain_blocks")
def u2(spark, d):
    """Both ends: success if they lift by one chain (in ascending order), partial if one does, else unmappable; split across
    chains, or no chain at all."""
    x, blocks = lift_points(spark, d), t(spark, d, "chain_blocks")
    x = x.withColumn("p2", c("p1") + c("len"))
    both = L.lift(x, blocks, "vid", "contig", "p1", "a_").join(L.lift(x, blocks, "vid", "contig", "p2", "b_"), "vid")
    none = (c("a_status") == "no_chain") & (c("b_status") == "no_chain")
    lifted = lambda p: c(f"{p}_status") == "lifted"
    status = (
        F.when(none, "no_chain").when(~c("a_chain").eqNullSafe(c("b_chain")), "split").when(lifted("a") & lifted("b"), "success").when(lifted("a") | lifted("b"), "partial").otherwise("unmappable")
    )
    done = status == "success"
    return both.select("vid", status.alias("status"), F.when(done, c("a_contig")).alias("contig"), F.when(done, F.least("a_q", "b_q")).alias("lo"), F.when(done, F.greatest("a_q", "b_q")).alias("hi"), F.when(status == "partial", 0.5).alias("fraction"))


@query("u3_contigs", "SELECT DISTINCT t_name AS contig, count(DISTINCT chain) OVER (PARTITION BY t_name) AS chains FROM (SELECT DISTINCT t_name, chain FROM chain_blocks)", "chain_blocks")
def u3(spark, d):
    return t(spark, d, "chain_blocks").groupBy(c("t_name").alias("contig")).agg(F.count_distinct("chain").alias("chains"))


@query("v1_rs_lookup", "SELECT vcv, chrom, pos, ref, alt, significance FROM clinvar JOIN rsids USING (rs)", "clinvar", "rsids")
def v1(spark, d):
    return t(spark, d, "clinvar").join(t(spark, d, "rsids"), "rs").select("vcv", "chrom", "pos", "ref", "alt", "significance")


@query("v2_rs_to_description", CONTIGS + "SELECT rs, accession || CASE chrom WHEN 'chrM' THEN ':m.' ELSE ':g.' END || pos || ref || '>' || alt AS description, CASE WHEN accession IS NULL THEN 'unknown_contig' END AS error FROM rsids LEFT JOIN contigs USING (chrom)", "rsids")
def v2(spark, d):
    x = K.with_accession(t(spark, d, "rsids"), K.aliases(spark), "chrom", "GRCh38")
    v = F.struct(c("accession").alias("sequence"), (c("pos") - 1).alias("position"), c("ref").alias("deletion"), c("alt").alias("insertion"))
    return x.select("rs", S.from_spdi(v).alias("description"), c("contig_error").alias("error"))


@query("v3_pathogenic_in_gene", "SELECT gene, count(*) AS n, min(vcv) AS first FROM clinvar WHERE significance IN ('Pathogenic', 'Likely pathogenic') GROUP BY gene", "clinvar")
def v3(spark, d):
    return t(spark, d, "clinvar").where("significance IN ('Pathogenic', 'Likely pathogenic')").groupBy("gene").agg(F.count("*").alias("n"), F.min("vcv").alias("first"))


@query("v4_stars", "SELECT s AS stars, count(*) AS n, count(*) FILTER (significance = 'Pathogenic' AND s >= 2) AS sure FROM (SELECT *, CASE left(review, 12) WHEN 'practice gui' THEN 4 WHEN 'reviewed by ' THEN 3 WHEN 'criteria pro' THEN CASE WHEN strpos(review, 'multiple') > 0 THEN 2 ELSE 1 END ELSE 0 END AS s FROM clinvar) GROUP BY s", "clinvar")
def v4(spark, d):
    x = t(spark, d, "clinvar").withColumn("stars", L.stars(c("review")))
    return x.groupBy("stars").agg(F.count("*").alias("n"), F.count_if((c("significance") == "Pathogenic") & (c("stars") >= 2)).alias("sure"))


@query("w7_missing_accessions", "SELECT acc, count(*) AS n FROM variants WHERE axis = 'c' AND acc NOT IN (SELECT tx FROM transcripts) GROUP BY acc", "variants", "transcripts")
def w7(spark, d):
    v = t(spark, d, "variants").where("axis = 'c'")
    return v.join(t(spark, d, "transcripts").select(c("tx").alias("acc")), "acc", "left_anti").groupBy("acc").agg(F.count("*").alias("n"))


_OWN = """, own AS (SELECT v.vid, v.s, v.ref, v.alt, x.tx, x.cds_start FROM (SELECT *, concat('NM_', lpad((vid % 1500)::VARCHAR, 6, '0'), '.', 1 + vid % 3) AS wanted FROM variants WHERE edit = 'sub' AND axis = 'c') v
  LEFT JOIN (SELECT w.acc, coalesce(e.tx, n.tx) AS tx FROM (SELECT DISTINCT concat('NM_', lpad((vid % 1500)::VARCHAR, 6, '0'), '.', 1 + vid % 3) AS acc FROM variants) w LEFT JOIN transcripts e ON e.tx = w.acc
    LEFT JOIN (SELECT regexp_replace(tx, '\\.\\d+$', '') AS base, max(tx) AS tx FROM transcripts GROUP BY 1) n ON n.base = regexp_replace(w.acc, '\\.\\d+$', '')) m ON m.acc = v.wanted LEFT JOIN transcripts x ON x.tx = m.tx)
"""


@query("t2_c_to_n_description", _OWN + "SELECT vid, CASE WHEN cds_start IS NOT NULL THEN concat(tx, ':n.', cds_start + s - 1, ref, '>', alt) END AS description, CASE WHEN tx IS NULL THEN 'no_transcript' WHEN cds_start IS NULL THEN 'noncoding' END AS error FROM own", "variants", "transcripts")
def t2(spark, d):
    """Each coding substitution on the transcript that it names, or on the highest version of it; without one, an error."""
    wanted = F.concat(F.lit("NM_"), F.lpad((c("vid") % 1500).cast("string"), 6, "0"), F.lit("."), (1 + c("vid") % 3).cast("string"))
    v = t(spark, d, "variants").where("edit = 'sub' AND axis = 'c'").withColumn("acc", wanted)
    x = t(spark, d, "transcripts")
    own = L.resolve(v, x).join(x.select(c("tx").alias("found"), "cds_start"), "found", "left")
    n = c("cds_start") + c("s") - 1
    return own.select("vid", D.write(c("found"), F.lit("n"), n, n, c("edit"), c("ref"), c("alt")).alias("description"), F.when(c("found").isNull(), "no_transcript").when(c("cds_start").isNull(), "noncoding").alias("error"))


@query("e5_zones", "SELECT CASE WHEN off IS NOT NULL THEN 'intron' WHEN utr3 THEN '3_utr' WHEN base < 0 THEN '5_utr' ELSE 'coding' END AS zone, count(*) AS n FROM cpos GROUP BY 1", "cpos", "transcripts")
def e5(spark, d):
    zone = F.when(c("off").isNotNull(), "intron").when(c("utr3"), "3_utr").when(c("base") < 0, "5_utr").otherwise("coding")
    return t(spark, d, "cpos").groupBy(zone.alias("zone")).agg(F.count("*").alias("n"))


@query("e7_cancelling_pairs", "SELECT vid // 10 AS allele, axis, s, e, count(*) FILTER (edit = 'del') AS deletions, count(*) FILTER (edit = 'dup') AS duplications, min(vid) AS first FROM variants WHERE edit IN ('del', 'dup') GROUP BY ALL HAVING deletions > 0 AND duplications > 0", "variants")
def e7(spark, d):
    """A deletion and a duplication of the same bases of one allele cancel one another: an allele's members are the items of
    one order here."""
    return A.cancelling(t(spark, d, "variants").withColumn("allele", F.floor(c("vid") / 10)), ["allele", "axis"])


@query("h2_intron_spelling_to_position", """, x AS (SELECT tx, cds_start, 1 + k % 2 AS intron, CASE WHEN k % 3 = 0 THEN 5 ELSE -4 END AS off FROM transcripts WHERE cds_start IS NOT NULL)
SELECT x.tx, intron::INT AS intron, off::BIGINT AS off, CASE WHEN off > 0 THEN t1 ELSE t1 + 1 END - cds_start + 1 AS base FROM x JOIN exons e ON e.tx = x.tx AND e.number = intron""", "transcripts", "exons")
def h2(spark, d):
    """c.IVS1+5G>A as the exon's last base and an offset, c.IVS1-4G>A as the next one's first."""
    text = F.expr("concat('c.IVS', 1 + k % 2, CASE WHEN k % 3 = 0 THEN '+5' ELSE '-4' END, 'G>A')")
    intron, off = D.intron_spelling(text)
    x = t(spark, d, "transcripts").where("cds_start IS NOT NULL").select("tx", "cds_start", intron.alias("intron"), off.alias("off"))
    e = t(spark, d, "exons").select("tx", c("number").alias("intron"), "t1")
    base = F.when(c("off") > 0, c("t1")).otherwise(c("t1") + 1) - c("cds_start") + 1
    return x.join(e, ["tx", "intron"]).select("tx", "intron", "off", base.alias("base"))


_HOSTED = """, hosted AS (SELECT concat('NG_', lpad((k % 400)::VARCHAR, 6, '0'), '.1') AS ng, concat('LRG_', k % 400) AS lrg, concat('t', 1 + row_number() OVER (PARTITION BY k % 400 ORDER BY tx) - 1) AS selector, tx FROM transcripts WHERE k % 3 > 0)
"""


def hosted(spark, d):
    """Genomic records with the transcripts that they host, as their tables list them."""
    w = Window.partitionBy(c("k") % 400).orderBy("tx")
    n = F.lpad((c("k") % 400).cast("string"), 6, "0")
    return t(spark, d, "transcripts").where("k % 3 > 0").select(
        F.concat(F.lit("NG_"), n, F.lit(".1")).alias("ng"), F.concat(F.lit("LRG_"), (c("k") % 400).cast("string")).alias("lrg"), F.concat(F.lit("t"), F.row_number().over(w).cast("string")).alias("selector"), "tx")


@query("k8_lrg_to_refseq", _HOSTED + "SELECT concat(lrg, selector) AS acc, tx FROM hosted UNION ALL SELECT DISTINCT lrg, ng FROM hosted", "transcripts")
def k8(spark, d):
    """LRG transcripts and sequences as the RefSeq records that they stand for."""
    return L.lrg_names(hosted(spark, d)).select("acc", "tx")


@query("k8_sole_hosted", _HOSTED + "SELECT ng, min(tx) AS tx FROM hosted GROUP BY ng HAVING count(*) = 1", "transcripts")
def k8s(spark, d):
    """The transcript of each genomic record that hosts exactly one."""
    return L.sole_hosted(hosted(spark, d))


_BUILT = """, built AS (SELECT tx, contig, g0, strand, 'GRCh38' AS build FROM transcripts UNION ALL SELECT tx, concat(split_part(contig, '.', 1), '.', split_part(contig, '.', 2)::INT - 1), g0 + 500, strand, 'GRCh37' FROM transcripts WHERE k % 4 <> 0)
"""


def built(spark, d):
    x = t(spark, d, "transcripts").select("k", "tx", "contig", "g0", "strand", F.lit("GRCh38").alias("build"))
    old = F.concat(F.split_part("contig", F.lit("."), F.lit(1)), F.lit("."), (F.split_part("contig", F.lit("."), F.lit(2)).cast("int") - 1).cast("string"))
    return x.union(x.where("k % 4 <> 0").select("k", "tx", old, c("g0") + 500, "strand", F.lit("GRCh37"))).drop("k")


@query("k9_on_build", _BUILT + "SELECT tx, contig, g0, strand FROM built WHERE build = 'GRCh37'", "transcripts")
def k9(spark, d):
    """Transcripts as one build places them, by any of its names."""
    return L.on_build(built(spark, d), "hg19").select("tx", "contig", "g0", "strand")


@query("k9_available_builds", _BUILT + "SELECT tx, array_to_string(list_sort(list_distinct(list(build))), ',') AS builds FROM built GROUP BY tx", "transcripts")
def k9b(spark, d):
    return L.available_builds(built(spark, d)).select("tx", F.array_join("builds", ",").alias("builds"))


@query("j13_placement", "SELECT vid, tx, CASE WHEN strand = 1 THEN g - g0 ELSE g0 + len1 + len2 + len3 + 400 - g + 1 END AS inner_pos, g AS back FROM points p JOIN transcripts x ON p.contig = x.contig AND g > g0 AND g <= g0 + len1 + len2 + len3 + 400", "points", "transcripts")
def j13(spark, d):
    """Contig positions in the frame of a placed region, on its strand, and back."""
    x = hits(spark, d)
    inner = F.when(c("strand") == 1, c("g") - c("g0")).otherwise(c("g1") - c("g") + 1)
    back = F.when(c("strand") == 1, c("inner_pos") + c("g0")).otherwise(c("g1") - c("inner_pos") + 1)
    return x.select("vid", "tx", "strand", "g0", "g1", inner.alias("inner_pos")).select("vid", "tx", "inner_pos", back.alias("back"))


@query("t1_edit_on_minus_strand", "SELECT vid, translate(reverse(alt), 'ACGT', 'TGCA') AS alt, 5000 - e + 1 AS s, 5000 - s + 1 AS e FROM variants WHERE edit IN ('ins', 'delins')", "variants")
def t1(spark, d):
    """An edit seen from the other strand of a region of 5,000 bases."""
    v = t(spark, d, "variants").where("edit IN ('ins', 'delins')")
    return v.select("vid", S.reverse_complement(c("alt")).alias("alt"), (5000 - c("e") + 1).alias("s"), (5000 - c("s") + 1).alias("e"))


@query("n2_trim_window", "SELECT vid, substr(seq, s - 9, 10) AS left_flank, substr(seq, e + 1, 10) AS right_flank, substr(seq, s + 1, e - s) AS ref FROM edits", "edits")
def n2(spark, d):
    """The bases of an edit and ten on either side."""
    x = t(spark, d, "edits")
    return x.select("vid", S.part(c("seq"), c("s") - 10, F.lit(10)).alias("left_flank"), S.part(c("seq"), c("e"), F.lit(10)).alias("right_flank"), S.part(c("seq"), c("s"), c("e") - c("s")).alias("ref"))
