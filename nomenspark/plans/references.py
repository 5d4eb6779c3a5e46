"""Queries over normalization, projection and records against transcripts and their sequences, with their oracles."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from nomenspark import corpus
from nomenspark.functions import descriptions as D
from nomenspark.functions import grammar
from nomenspark.functions import normalize as N
from nomenspark.functions import sequences as S
from nomenspark.operators import batch as B
from nomenspark.operators import coordinates as C
from nomenspark.operators import lookups as L
from nomenspark.operators import references as R

from .effect import _REC, CONTIGS, placed
from .genomics import _LIFT, _N, lift_points
from .registry import Registry
from .sequence import _CANONICAL, _PREFIX
from .text import variants

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
c, t = F.col, corpus.table

_B = """, b0 AS (SELECT *, CASE WHEN s < len1 THEN 0 WHEN s < len1 + len2 THEN len1 ELSE len1 + len2 END AS x0, CASE WHEN s < len1 THEN len1 WHEN s < len1 + len2 THEN len1 + len2 ELSE len END AS x1,
  CASE WHEN cds_start IS NULL THEN 'none' WHEN s + 1 < cds_start THEN '5utr' WHEN s + 1 > cds_end THEN '3utr' ELSE 'cds' END AS region FROM tx_edits),
b AS (SELECT *, greatest(x0, CASE region WHEN 'cds' THEN cds_start - 1 WHEN '3utr' THEN cds_end ELSE 0 END)::INT AS lo, least(x1, CASE region WHEN '5utr' THEN cds_start - 1 WHEN 'cds' THEN cds_end ELSE len END)::INT AS hi FROM b0)
"""
_AT = "CASE WHEN cds_start IS NULL THEN ({0})::VARCHAR WHEN {0} > cds_end THEN concat('*', {0} - cds_end) WHEN {0} < cds_start THEN ({0} - cds_start)::VARCHAR ELSE ({0} - cds_start + 1)::VARCHAR END"


def edits(spark, d):
    return t(spark, d, "tx_edits")


def bounded(spark, d):
    return R.with_bounds(edits(spark, d), t(spark, d, "exons"))


@query("m2_bounds", _B + "SELECT vid, lo, hi, region FROM b", "tx_edits")
def m2(spark, d):
    return bounded(spark, d).select("vid", "lo", "hi", "region")


@query("m2_genomic_window", "SELECT vid, greatest(s - 100, 0) AS lo, least(e + 100, 256) AS hi FROM edits", "edits")
def m2g(spark, d):
    return t(spark, d, "edits").select("vid", N.genomic_window(c("s"), c("e"), F.length("seq")).alias("w")).select("vid", "w.*")


_WITHIN = _B + """, inside AS (SELECT *, CASE WHEN s >= lo AND e <= hi THEN lo ELSE s END AS a0, CASE WHEN s >= lo AND e <= hi THEN hi ELSE e END AS b1 FROM b),
edits AS (SELECT vid, tx AS acc, substr(seq, a0 + 1, b1 - a0) AS seq, s - a0 AS s, e - a0 AS e, payload FROM inside)
""" + _CANONICAL + ", g AS (SELECT i.vid, tx, i.seq, cds_start, cds_end, f.c.edit AS edit, (f.c.s + a0)::INT AS s, (f.c.e + a0)::INT AS e, f.c.alt AS alt FROM f JOIN inside i USING (vid))\n"


@query("m0_on_transcripts", _WITHIN + f"""SELECT vid, tx || CASE WHEN cds_start IS NULL THEN ':n.' ELSE ':c.' END || CASE edit WHEN 'ins' THEN concat({_AT.format('s')}, '_', {_AT.format('(s + 1)')}, 'ins', alt) WHEN 'sub' THEN concat({_AT.format('(s + 1)')}, substr(seq, s + 1, 1), '>', alt)
  ELSE concat({_AT.format('(s + 1)')}, CASE WHEN e > s + 1 THEN concat('_', {_AT.format('e')}) ELSE '' END, CASE edit WHEN 'identity' THEN '=' ELSE concat(edit, alt) END) END AS description FROM g""", "tx_edits")
def m0(spark, d):
    """Edits on transcripts in canonical form: shifted no further than their exon and region, on the coding axis."""
    x = bounded(spark, d).withColumn("c", N.canonical_within(c("seq"), c("s"), c("e"), c("payload"), c("lo"), c("hi")))
    return x.select("vid", N.transcript_description(c("tx"), c("seq"), c("c"), c("cds_start"), c("cds_end")).alias("description"))


@query("m19_diagnostics", _B + f""", u AS (SELECT *, substr(seq, s + 1) AS one, CASE WHEN edit = 'del' THEN substr(seq, e + 1) ELSE repeat(payload, 600) END AS two FROM b WHERE edit IN ('del', 'ins')), k AS (SELECT *, {_PREFIX.format(a='one', b='two')} AS k FROM u),
h AS (SELECT *, CASE WHEN s >= lo AND e <= hi THEN least(k, greatest(hi - e, 0)) ELSE 0 END AS shift, CASE WHEN s >= x0 AND e <= x1 THEN least(k, greatest(x1 - e, 0)) ELSE 0 END AS free FROM k)
SELECT vid, shift::INT AS shift, array_to_string(list_filter([CASE WHEN vid % 5 = 0 THEN 'REFSEQ_MISMATCH' END, CASE WHEN shift > 0 THEN 'SHUFFLE_APPLIED' END, CASE WHEN hi < x1 AND free > shift THEN 'AXIS_CLAMP_APPLIED' END], lambda x: x IS NOT NULL), ',') AS codes FROM h""", "tx_edits")
def m19(spark, d):
    """Shifts of deletions and insertions and what is reported of them; a fifth states bases that are not there."""
    x = bounded(spark, d).where("edit IN ('del', 'ins')")
    x = x.withColumns({"shift": N.shift_within(c("seq"), c("s"), c("e"), c("payload"), c("lo"), c("hi")), "free": N.shift_within(c("seq"), c("s"), c("e"), c("payload"), c("exon_lo"), c("exon_hi"))})
    warning = F.when(c("vid") % 5 == 0, "W5001")
    return x.select("vid", "shift", F.array_join(N.diagnostics(c("shift"), c("free"), c("hi") < c("exon_hi"), warning), ",").alias("codes"))


@query("m3_minimal", "SELECT vid, CASE WHEN edit = 'sub' AND vid % 3 = 0 THEN 'identity' ELSE edit END AS edit, CASE WHEN edit = 'sub' AND vid % 3 <> 0 THEN ref ELSE '' END AS ref, CASE WHEN edit IN ('ins', 'delins') OR (edit = 'sub' AND vid % 3 <> 0) THEN alt ELSE '' END AS alt, edit IN ('del', 'dup', 'inv') OR (edit = 'sub' AND vid % 3 = 0) AS changed FROM variants WHERE axis <> 'p'", "variants")
def m3(spark, d):
    """Without a reference: bases stated after del, dup and inv go, a base replaced by itself is an identity."""
    ref = F.when(c("edit").isin("del", "dup", "inv"), "ACG").otherwise(c("ref"))
    alt = F.when((c("edit") == "sub") & (c("vid") % 3 == 0), c("ref")).otherwise(c("alt"))
    x = variants(spark, d).where("axis <> 'p'").select("vid", N.minimal(c("edit"), ref, alt).alias("m"), N.needs_minimal(c("edit"), ref, alt).alias("changed"))
    return x.select("vid", "m.*", "changed")


def _rebuilt(ref, pieces):
    """The sequence that the pieces make of ref."""
    def new(x):
        old = S.part(ref, x["s"], x["e"] - x["s"])
        alt = F.when(x["edit"] == "inv", S.reverse_complement(old)).when(x["edit"] == "dup", F.concat(old, old)).when(x["edit"] == "identity", old).otherwise(x["alt"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), alt.alias("alt"))

    return N.apply_all(ref, F.transform(pieces, new))


@query("m9_decomposition", """, x AS (SELECT vid, substr(seq, s + 1, 10) AS r FROM edits), y AS (SELECT vid, r, CASE vid % 3 WHEN 0 THEN concat(translate(reverse(left(r, 4)), 'ACGT', 'TGCA'), substr(r, 5, 5), translate(substr(r, 10, 1), 'ACGT', 'CGTA'))
  WHEN 1 THEN concat(translate(left(r, 1), 'ACGT', 'CGTA'), substr(r, 2, 4), translate(substr(r, 6, 2), 'ACGT', 'CGTA'), substr(r, 8)) ELSE translate(r, 'ACGT', 'CGTA') END AS a FROM x),
z AS (SELECT vid, r, a, len(list_filter(range(1, 11), lambda i: substr(r, i, 1) <> substr(a, i, 1) AND (i = 1 OR substr(r, i - 1, 1) = substr(a, i - 1, 1)))) AS runs FROM y)
SELECT vid, CASE WHEN vid % 3 = 2 THEN CASE WHEN a = translate(reverse(r), 'ACGT', 'TGCA') THEN 1 END ELSE runs END::INT AS runs, CASE WHEN vid % 3 < 2 OR a = translate(reverse(r), 'ACGT', 'TGCA') THEN true END AS same FROM z""", "edits")
def m9(spark, d):
    """Ten bases replaced: the first four inverted and the last changed, two places changed, or all of them."""
    r = S.part(c("seq"), c("s"), F.lit(10))
    other = lambda x: F.translate(x, "ACGT", "CGTA")
    x = t(spark, d, "edits").select("vid", r.alias("r"))
    a = (
        F.when(c("vid") % 3 == 0, F.concat(S.reverse_complement(F.substring("r", 1, 4)), F.substring("r", 5, 5), other(F.substring("r", 10, 1))))
        .when(c("vid") % 3 == 1, F.concat(other(F.substring("r", 1, 1)), F.substring("r", 2, 4), other(F.substring("r", 6, 2)), F.substring("r", 8, 3))).otherwise(other(c("r")))
    )
    x = x.withColumn("a", a).withColumn("p", N.decompose(c("r"), c("a")))
    return x.select("vid", F.when(c("p").isNotNull(), F.size("p")).alias("runs"), (_rebuilt(c("r"), c("p")) == c("a")).alias("same"))


@query("m11_inverted_copies", """, x AS (SELECT vid, seq, s, (2 + vid % 9)::INT AS n FROM edits), y AS (SELECT vid, s, n, substr(seq, s - n + 1, n) AS before, translate(reverse(substr(seq, s - n + 1, n)), 'ACGT', 'TGCA') AS p, substr(seq, greatest(s - 50, 0) + 1, s + 50 - greatest(s - 50, 0)) AS w FROM x),
z AS (SELECT *, list_product(list_transform(string_split(p, ''), lambda b: (length(w) - length(replace(w, b, '')) + 1) / (length(w) + 4))) AS chance FROM y)
SELECT vid, CASE WHEN before <> p AND chance < 0.01 THEN s - n + 1 END::INT AS lo, CASE WHEN before <> p AND chance < 0.01 THEN s END::INT AS hi FROM z""", "edits")
def m11(spark, d):
    n = (2 + c("vid") % 9).cast("int")
    x = t(spark, d, "edits").withColumn("p", S.reverse_complement(S.part(c("seq"), c("s") - n, n)))
    return x.select("vid", N.inverted_copy(c("seq"), c("s"), c("p")).alias("span")).select("vid", "span.lo", "span.hi")


def stored(spark, d):
    return L.chunks(t(spark, d, "tx_seqs").select(c("tx").alias("acc"), "seq"))


@query("m13_inserted_ranges", "SELECT vid, CASE WHEN vid % 7 = 0 THEN NULL WHEN vid % 2 = 0 THEN translate(reverse(substr(seq, s + 1, 20 + vid % 50)), 'ACGT', 'TGCA') ELSE substr(seq, s + 1, 20 + vid % 50) END AS payload FROM tx_edits", "tx_edits")
def m13(spark, d):
    """Ranges of stored sequences, inserted as they are or inverted; a seventh names a sequence that is not stored."""
    x = edits(spark, d).select("vid", F.when(c("vid") % 7 == 0, "NM_999999.9").otherwise(c("tx")).alias("source"), (c("s") + 1).cast("long").alias("from_"), (c("s") + 20 + c("vid") % 50).cast("long").alias("to"), (c("vid") % 2 == 0).alias("inverted"))
    return R.expanded(x, stored(spark, d), "vid").select("vid", "payload")


_MEMBERS = ", m AS (SELECT vid // 10 AS allele, vid, edit, s + (vid % 3)::INT AS s, e + (vid % 3)::INT AS e FROM tx_edits)\n"


@query("m15_conflicts", _MEMBERS + """SELECT allele, s AS place, 'coincident' AS what FROM m WHERE s < e GROUP BY allele, s, e HAVING count(*) > 1
UNION ALL SELECT allele, s, 'insertions' FROM m WHERE s = e GROUP BY allele, s HAVING count(*) > 1
UNION ALL SELECT DISTINCT a.allele, a.s, 'interior' FROM m a JOIN m b ON a.allele = b.allele AND a.s = a.e AND b.edit <> 'del' AND b.s < a.s AND a.s < b.e""", "tx_edits")
def m15(spark, d):
    x = edits(spark, d).select(F.floor(c("vid") / 10).alias("allele"), "vid", "edit", *((c(p) + (c("vid") % 3).cast("int")).alias(p) for p in ("s", "e")))
    return R.conflicts(x, ["allele"]).select("allele", "place", "what")


_TRIPLE = """, x AS (SELECT vid, seq, s, cds_start, 1 + (vid % 3)::INT AS d FROM tx_edits WHERE edit = 'sub'), y AS (SELECT *, {joined} AS j, translate(substr(seq, s + 1, 1), 'ACGT', 'CGTA') AS a1, translate(substr(seq, s + d + 1, 1), 'ACGT', 'CGTA') AS a2, translate(substr(seq, s + d + 8, 1), 'ACGT', 'CGTA') AS a3 FROM x)
SELECT vid, s, CASE WHEN j THEN s + d + 1 ELSE s + 1 END AS e, CASE WHEN j THEN concat(a1, substr(seq, s + 2, d - 1), a2) ELSE a1 END AS alt, CASE WHEN j THEN 2 ELSE 1 END AS members FROM y
UNION ALL SELECT vid, s + d, s + d + 1, a2, 1 FROM y WHERE NOT j UNION ALL SELECT vid, s + d + 7, s + d + 8, a3, 1 FROM y
"""


def triples(spark, d):
    """Three substitutions an allele: the second one, two or three bases after the first, the third seven bases on."""
    step = (1 + c("vid") % 3).cast("int")
    x = edits(spark, d).where("edit = 'sub'").select("vid", "seq", (c("cds_start") - 1).alias("cds"), F.explode(F.array(c("s"), c("s") + step, c("s") + step + 7)).alias("s"))
    return x.select("vid", "seq", "cds", "s", (c("s") + 1).alias("e"), F.translate(S.part(c("seq"), c("s"), F.lit(1)), "ACGT", "CGTA").alias("alt"))


@query("m16_merged", _TRIPLE.format(joined="d = 1"), "tx_edits")
def m16(spark, d):
    return R.merged(triples(spark, d), ["vid"]).select("vid", "s", "e", "alt", "members")


@query("t9_one_codon", _TRIPLE.format(joined="d = 1 OR (d = 2 AND cds_start IS NOT NULL AND s >= cds_start - 1 AND (s - cds_start + 1) // 3 = (s + 3 - cds_start) // 3)"), "tx_edits")
def t9(spark, d):
    """Substitutions of one codon are one change, also with a base between them."""
    return R.merged(triples(spark, d), ["vid"], cds="cds").select("vid", "s", "e", "alt", "members")


@query("m18_on_own_reference", """, x AS (SELECT DISTINCT vid, acc, s, e, payload, seq FROM edits) SELECT vid, count(*) AS n, true AS same FROM x GROUP BY vid""", "edits")
def m18(spark, d):
    """The canonical edit read on a reference of its own, the window around it, is the same change."""
    x = t(spark, d, "edits").select("vid", "acc", "s", "e", "payload", "seq").distinct().withColumn("w", N.to_sequences(c("seq"), c("s"), c("e"), c("payload"), 32))
    new = N.from_sequences(F.lit(0), c("w.ref"), c("w.alt"))
    x = x.withColumn("m", new)
    again = _rebuilt(c("w.ref"), F.array(F.struct(c("m.edit").alias("edit"), c("m.s").alias("s"), c("m.e").alias("e"), c("m.alt").alias("alt"))))
    return x.select("vid", (again == c("w.alt")).alias("ok")).groupBy("vid").agg(F.count("*").alias("n"), F.every("ok").alias("same"))


@query("o2_transcript_spdi", "SELECT vid, CASE edit WHEN 'ins' THEN concat(tx, ':', s, '::', payload) WHEN 'dup' THEN concat(tx, ':', e, '::', substr(seq, s + 1, e - s)) ELSE concat(tx, ':', s, ':', substr(seq, s + 1, e - s), ':', payload) END AS spdi FROM tx_edits", "tx_edits")
def o2(spark, d):
    x = edits(spark, d).select("vid", c("tx").alias("acc"), "edit", "s", "e", c("payload").alias("alt"))
    return R.to_spdi(x, stored(spark, d), "vid")


@query("n1_from_windows", """, win AS (SELECT DISTINCT vid, acc, seq, s, e, payload, s - 10 AS lo, least(e + 10, 256) AS hi FROM edits),
edits2 AS (SELECT row_number() OVER (ORDER BY vid, acc, s, e, payload) AS vid, acc, substr(seq, lo + 1, hi - lo) AS seq, 0 AS s, hi - lo AS e, substr(seq, lo + 1, s - lo) || payload || substr(seq, e + 1, hi - e) AS payload, lo, vid AS own FROM win)
""" + _CANONICAL.replace("FROM edits)", "FROM edits2)") + "SELECT x.own AS vid, c.edit AS edit, (c.s + lo)::INT AS s, (c.e + lo)::INT AS e, c.alt AS alt, c.s = 0 AND c.edit <> 'identity' AS touches_start, c.e = length(x.seq) AND c.edit <> 'identity' AS touches_end FROM f JOIN edits2 x USING (vid)", "edits")
def n1(spark, d):
    x = t(spark, d, "edits").select("vid", "acc", "seq", "s", "e", "payload").distinct()
    lo, hi = c("s") - 10, F.least(c("e") + 10, F.lit(256))
    new = F.concat(S.part(c("seq"), lo, F.lit(10)), c("payload"), S.part(c("seq"), c("e"), hi - c("e")))
    return x.select("vid", N.from_sequences(lo, S.part(c("seq"), lo, hi - lo), new).alias("m")).select("vid", "m.*")


@query("n3_windows_and_back", "SELECT vid, count(*) AS n, true AS same FROM (SELECT DISTINCT vid, acc, s, e, payload FROM edits) GROUP BY vid", "edits")
def n3(spark, d):
    """A window of 128 bases on either side says the same edit as the whole sequence, where it is final."""
    x = t(spark, d, "edits").select("vid", "acc", "seq", "s", "e", "payload").distinct().withColumn("w", N.to_sequences(c("seq"), c("s"), c("e"), c("payload")))
    m = N.from_sequences(c("w.position"), c("w.ref"), c("w.alt"))
    key = lambda s, e, p: S.canonical_spdi(c("acc"), c("seq"), s, e, p)
    x = x.withColumn("m", m)
    old = S.part(c("seq"), c("m.s"), c("m.e") - c("m.s"))
    new = F.when(c("m.edit") == "dup", F.concat(old, old)).when(c("m.edit") == "inv", S.reverse_complement(old)).when(c("m.edit") == "identity", old).otherwise(c("m.alt"))
    x = x.withColumn("new", new)
    none = S.part(c("seq"), c("s"), c("e") - c("s")) == c("payload")
    same = none | ~c("w.window_is_final") | (key(c("s"), c("e"), c("payload")) == key(c("m.s"), c("m.e"), c("new")))
    return x.select("vid", same.alias("ok")).groupBy("vid").agg(F.count("*").alias("n"), F.every("ok").alias("same"))


@query("n4_extracted", "SELECT vid, CASE vid % 2 WHEN 0 THEN 2 ELSE 1 END AS edits, true AS same FROM edits", "edits")
def n4(spark, d):
    """Two places changed, or one base gone."""
    x = t(spark, d, "edits").select("vid", S.part(c("seq"), c("s"), F.lit(12)).alias("r"))
    other = lambda at: F.translate(F.substring("r", at, 1), "ACGT", "CGTA")
    a = F.when(c("vid") % 2 == 0, F.concat(F.substring("r", 1, 2), other(3), F.substring("r", 4, 4), other(8), F.substring("r", 9, 4))).otherwise(F.concat(F.substring("r", 1, 5), F.substring("r", 7, 6)))
    x = x.withColumn("a", a).withColumn("p", N.extracted(c("r"), c("a")))
    return x.select("vid", F.size("p").alias("edits"), (_rebuilt(c("r"), c("p")) == c("a")).alias("same"))


_ON = CONTIGS + _REC.replace(", r0 AS (SELECT *,", ", r0 AS (SELECT vid, chrom, 1000 + pos % 92000 AS pos, ref, alt,") + """, p AS (SELECT DISTINCT vid, accession AS contig, pos, ref, alt FROM r JOIN contigs USING (chrom)),
x AS (SELECT p.vid, p.ref, p.alt, e.tx, e.strand, e.t0, e.t1, t0 + 1 + CASE WHEN strand = 1 THEN pos - 1 - x0 ELSE x1 - pos END AS n, greatest(length(p.ref), 1) - 1 AS w, p.ref = '' AS gap FROM p JOIN exons e ON p.contig = e.contig AND pos - 1 >= x0 AND pos - 1 < x1),
y AS (SELECT *, CASE WHEN strand = 1 THEN n - 1 WHEN gap THEN n ELSE n - 1 - w END AS s FROM x), z AS (SELECT *, CASE WHEN gap THEN s ELSE s + w + 1 END AS e FROM y),
v AS (SELECT z.vid, z.tx, z.strand, s, e, s >= t0 AND e <= t1 AND (NOT gap OR (s > t0 AND s < t1)) AS inside, CASE WHEN z.strand = 1 THEN ref ELSE translate(reverse(ref), 'ACGT', 'TGCA') END AS ref, CASE WHEN z.strand = 1 THEN alt ELSE translate(reverse(alt), 'ACGT', 'TGCA') END AS alt, cds_start, cds_end FROM z JOIN transcripts USING (tx))
"""


@query("q2_records_on_transcripts", _ON + f"""SELECT vid, tx, strand, CASE WHEN inside AND (ref <> '' OR alt <> '') THEN tx || CASE WHEN cds_start IS NULL THEN ':n.' ELSE ':c.' END || CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN concat({_AT.format('(s + 1)')}, ref, '>', alt)
  WHEN ref = '' THEN concat({_AT.format('s')}, '_', {_AT.format('(s + 1)')}, 'ins', alt) ELSE concat({_AT.format('(s + 1)')}, CASE WHEN length(ref) > 1 THEN concat('_', {_AT.format('e')}) ELSE '' END, CASE WHEN alt = '' THEN 'del' ELSE concat('delins', alt) END) END END AS description,
  CASE WHEN NOT inside THEN 'crosses_exon' WHEN ref = '' AND alt = '' THEN 'no_change' END AS error FROM v""", "vcf", "exons", "transcripts")
def q2(spark, d):
    from nomenspark.functions import vcf as V

    x = placed(spark, t(spark, d, "vcf")).where("accession IS NOT NULL")
    x = x.select("vid", c("accession").alias("contig"), V.trim(1000 + c("pos") % 92000, c("ref"), c("alt")).alias("r")).select("vid", "contig", "r.*").distinct()
    return R.records_on_transcripts(x, t(spark, d, "exons"), t(spark, d, "transcripts"))


_ONE = ", cp AS (SELECT vid, m[1] AS tx, m[2] AS base, m[3] AS off, m[4] AS utr3 FROM (SELECT vid, min((tx, base, off, utr3)) AS m FROM cpos GROUP BY vid))\n"


@query("q4_transcript_substitutions", _ONE + _N.replace("FROM cpos p", "FROM cp p") + """, g AS (SELECT vid, contig, strand, CASE WHEN strand = 1 THEN x0 + n - t0 + coalesce(off, 0) ELSE x1 - (n - 1 - t0) - coalesce(off, 0) END AS pos FROM cn JOIN exons USING (tx) WHERE n > t0 AND n <= t1)
SELECT vid, contig, pos, CASE strand WHEN 1 THEN substr('ACGT', 1 + (vid % 4)::INT, 1) WHEN -1 THEN substr('TGCA', 1 + (vid % 4)::INT, 1) END AS ref, CASE strand WHEN 1 THEN substr('CGTA', 1 + (vid % 4)::INT, 1) WHEN -1 THEN substr('GCAT', 1 + (vid % 4)::INT, 1) END AS alt, CASE WHEN pos IS NULL THEN 'no_such_position' END AS error
FROM cn LEFT JOIN g USING (vid)""", "cpos", "transcripts", "exons")
def q4(spark, d):
    own = t(spark, d, "cpos").groupBy("vid").agg(F.min(F.struct("tx", "base", "off", "utr3")).alias("m")).select("vid", "m.*")
    base = lambda of: F.substring(F.lit(of), (1 + c("vid") % 4).cast("int"), F.lit(1))
    n = C.cds_to_tx(own, t(spark, d, "transcripts")).select("vid", "tx", "n", "off", base("ACGT").alias("ref"), base("CGTA").alias("alt"))
    return R.substitutions_to_records(n, t(spark, d, "exons"))


@query("q6_members_to_records", "SELECT vid, x.n AS member, CASE WHEN x.n = 1 AND edit = 'sub' THEN s END AS pos, CASE WHEN x.n = 1 AND edit = 'sub' THEN ref END AS ref, CASE WHEN x.n = 1 AND edit = 'sub' THEN alt END AS alt, CASE WHEN x.n = 2 OR edit <> 'sub' THEN 'needs_reference' END AS error FROM variants, (SELECT unnest([1, 2]) AS n) x WHERE axis = 'g' AND edit IN ('sub', 'del')", "variants")
def q6(spark, d):
    """Alleles of two members, a record each."""
    text = F.expr("concat(acc, ':g.[', substr(description, length(acc) + 4), ';', e + 9, 'del]')")
    x = variants(spark, d).where("axis = 'g' AND edit IN ('sub', 'del')").select("vid", text.alias("text"))
    p = grammar.parse_all(x, "vid", "text").select("vid", F.posexplode("members").alias("member", "m"))
    one = F.struct(c("m.accession").alias("accession"), c("m.axis").alias("axis"), c("m.start").try_cast("long").alias("s"), c("m.edit").alias("edit"), c("m.ref").alias("ref"), c("m.alt").alias("alt"))
    return p.select("vid", (c("member") + 1).alias("member"), R.genomic_to_record(one).alias("r")).select("vid", "member", "r.pos", "r.ref", "r.alt", "r.error")


@query("q7_records_without_reference", "SELECT vid, CASE WHEN axis = 'g' AND edit = 'sub' THEN acc END AS accession, CASE WHEN axis = 'g' AND edit = 'sub' THEN s END AS pos, CASE WHEN axis <> 'g' THEN concat('axis_', axis) WHEN edit <> 'sub' THEN 'needs_reference' END AS error FROM variants", "variants")
def q7(spark, d):
    return variants(spark, d).select("vid", R.genomic_to_record(D.parse(c("description"))).alias("r")).select("vid", "r.accession", "r.pos", "r.error")


@query("p1_levels", "SELECT vid, CASE vid % 7 WHEN 0 THEN 'identical' WHEN 1 THEN 'accession_version_difference' WHEN 2 THEN 'normalized_match' WHEN 3 THEN 'indeterminate' WHEN 4 THEN 'sequence_match' WHEN 5 THEN 'cross_axis_match' ELSE 'not_equivalent' END AS level FROM variants", "variants")
def p1(spark, d):
    """Pairs of each kind."""
    k = c("vid") % 7
    side = lambda text, acc, norm, key, axis: F.struct(text.alias("text"), acc.alias("accession"), norm.alias("normalized"), key.alias("key"), axis.alias("axis"))
    a = side(c("description"), c("acc"), c("description"), F.lit("key"), c("axis"))
    acc = F.when(k == 1, F.concat(F.regexp_replace("acc", r"\.\d+$", ""), F.lit(".77"))).otherwise(c("acc"))
    text = F.when(k == 0, c("description")).when(k == 1, F.concat(acc, F.expr("substr(description, length(acc) + 1)"))).otherwise(F.concat("description", F.lit("?")))
    norm = F.when(k == 2, c("description")).otherwise(text)
    key = F.when(k == 3, F.lit(None)).when(k.isin(4, 5), "key").otherwise("other")
    return variants(spark, d).select("vid", N.pair_level(a, side(text, acc, norm, key, F.when(k == 5, "other").otherwise(c("axis")))).alias("level"))


@query("p2_denotations", "SELECT vid, CASE WHEN vid % 9 = 0 THEN 'indeterminate' WHEN substr(seq, s + 1, 1) = substr(seq, e + 1, 1) THEN 'same' ELSE 'different' END AS verdict FROM edits WHERE e > s", "edits")
def p2(spark, d):
    """A deletion and the one a base further on."""
    key = lambda by: S.canonical_spdi(c("acc"), c("seq"), c("s") + by, c("e") + by, F.lit(""))
    return t(spark, d, "edits").where("e > s").select("vid", N.denotation(key(0), F.when(c("vid") % 9 != 0, key(1))).alias("verdict"))


_RANKS = "(VALUES ('identical', 5), ('normalized_match', 4), ('sequence_match', 3), ('cross_axis_match', 2), ('accession_version_difference', 1), ('not_equivalent', NULL), ('indeterminate', NULL))"


@query("p3_level_order", f"SELECT a.n AS level, b.n AS floor, a.r IS NOT NULL AS equivalent, a.n <> 'indeterminate' AS decided, coalesce(a.r >= b.r, false) AS at_least FROM {_RANKS} a(n, r), {_RANKS} b(n, r)")
def p3(spark, d):
    names = [*N.LEVELS, "not_equivalent", "indeterminate"]
    x = spark.createDataFrame([(a, b) for a in names for b in names], "level string, floor string")
    return x.select("level", "floor", N.is_equivalent(c("level")).alias("equivalent"), N.is_decided(c("level")).alias("decided"), N.is_at_least(c("level"), c("floor")).alias("at_least"))


@query("j7_past_the_end", "SELECT x.tx, n, CASE WHEN e.strand = 1 THEN x0 + n - t0 ELSE x1 - (n - 1 - t0) END AS g FROM (SELECT tx, len1 + len2 + len3 - 5 + k % 30 AS n FROM transcripts) x JOIN exons e ON e.tx = x.tx AND e.number = 3", "transcripts", "exons")
def j7(spark, d):
    """Positions about the ends of transcripts, in the tail beyond them too."""
    x = t(spark, d, "transcripts").select("tx", (c("len1") + c("len2") + c("len3") - 5 + c("k") % 30).alias("n"))
    return R.extended_to_genome(x, t(spark, d, "exons")).select("tx", "n", "g")


@query("j8_intervals", """, x AS (SELECT vid, tx, s + 1 AS n1, least(s + 1 + vid % 60, len) AS n2 FROM tx_edits), g AS (SELECT vid, x.tx, contig, CASE WHEN strand = 1 THEN x0 + n - t0 ELSE x1 - (n - 1 - t0) END AS g FROM (SELECT vid, tx, unnest([n1, n2]) AS n FROM x) x JOIN exons e ON e.tx = x.tx AND n > t0 AND n <= t1)
SELECT vid, tx, contig, min(g) AS lo, max(g) AS hi FROM g GROUP BY ALL""", "tx_edits", "exons")
def j8(spark, d):
    x = edits(spark, d).select("vid", "tx", (c("s") + 1).cast("long").alias("n1"), F.least(c("s") + 1 + c("vid") % 60, c("len")).alias("n2"))
    return R.interval_to_genome(x, t(spark, d, "exons"))


@query("j9_gapped_offsets", "SELECT vid, CASE WHEN o < 10 THEN o WHEN o < 30 THEN o + 2 WHEN o < 33 THEN NULL ELSE o - 1 END AS at FROM (SELECT vid, s % 60 AS o FROM variants)", "variants")
def j9(spark, d):
    """Exons that lack two bases of the contig at 10 and have three more at 30."""
    gaps = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(at).cast("long").alias("at"), F.lit(n).cast("long").alias("len")) for op, at, n in (("D", 10, 2), ("I", 30, 3))])
    return variants(spark, d).select("vid", N.cigar_offset(c("s") % 60, gaps).alias("at"))


@query("u4_lift_37_to_38", _LIFT.format(at="p1").replace("FROM lifts)", "FROM (SELECT vid, min((contig, p1, len)) AS m, m[1] AS contig, m[2] AS p1 FROM lifts GROUP BY vid))").replace("FROM chain_blocks)", "FROM chain_blocks WHERE chain % 2 = 0)") + "SELECT p.vid, CASE WHEN l.chain IS NULL THEN 'no_chain' WHEN q IS NULL THEN 'gap' ELSE 'lifted' END AS status, q FROM pts p LEFT JOIN lifted l ON p.vid = l.vid", "lifts", "chain_blocks")
def u4(spark, d):
    """Chain files of both directions side by side: only that of the wanted one is read."""
    forth = c("chain") % 2 == 0
    chains = t(spark, d, "chain_blocks").withColumns({"source": F.when(forth, "hg19").otherwise("hg38"), "target": F.when(forth, "hg38").otherwise("hg19")})
    return L.lift_37_to_38(lift_points(spark, d), chains, "vid", "contig", "p1").select("vid", "status", "q")


@query("t3_rna", "SELECT vid, CASE WHEN vid % 4 <> 0 THEN concat(acc, ':r.(', translate(substr(description, length(acc) + 4), 'ACGT', 'acgu'), ')') END AS description FROM variants WHERE axis = 'c'", "variants")
def t3(spark, d):
    """A quarter lies in introns, of which no RNA speaks."""
    text = F.when(c("vid") % 4 == 0, F.concat("acc", F.lit(":c."), c("s").cast("string"), F.lit("+5A>G"))).otherwise(c("description"))
    return variants(spark, d).where("axis = 'c'").select("vid", N.rna_description(text).alias("description"))


@query("t6_extensions", """, x AS (SELECT tx, substr(seq, cds_end + 1) AS utr, CASE k % 3 WHEN 0 THEN 'TAG' WHEN 1 THEN 'CAA' ELSE 'TGG' END AS stop FROM tx_seqs WHERE cds_end IS NOT NULL),
y AS (SELECT tx, stop, list_min(list_filter(range(0, length(utr) // 3), lambda i: substr(utr, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) AS i FROM x)
SELECT tx, CASE stop WHEN 'CAA' THEN 'Q' WHEN 'TGG' THEN 'W' END AS residue, CASE WHEN stop <> 'TAG' THEN i + 1 END::INT AS count FROM y""", "tx_seqs")
def t6(spark, d):
    x = t(spark, d, "tx_seqs").where("cds_end IS NOT NULL")
    stop = F.when(c("k") % 3 == 0, "TAG").when(c("k") % 3 == 1, "CAA").otherwise("TGG")
    utr = F.substr(c("seq"), (c("cds_end") + 1).cast("int"))
    return x.select("tx", N.extension(c("seq"), utr, stop).alias("x")).select("tx", "x.residue", "x.count")


@query("t7_combined_protein", """, x AS (SELECT vid, 3 * (s // 3) AS s, (vid % 3)::INT AS p, 3 * (s // 3) + 3 * (vid % 2)::INT AS s2, ((vid // 3) % 3)::INT AS p2 FROM tx_edits), y AS (SELECT vid, s + p AS a, s2 + p2 AS b FROM x WHERE s + p <> s2 + p2)
SELECT vid, len(list_distinct(list_filter([CASE WHEN a % 3 < 2 THEN a // 3 + 1 END, CASE WHEN b % 3 < 2 THEN b // 3 + 1 END], lambda x: x IS NOT NULL)))::INT AS changes FROM y""", "tx_edits")
def t7(spark, d):
    """Two changes of one allele, in one codon or in neighbours, read together: in a sequence of C and T, where only the
    first two bases of a codon count."""
    cds = F.translate("seq", "AG", "CT")
    first = (F.floor(c("s") / 3) * 3).cast("int")
    a, b = first + (c("vid") % 3).cast("int"), first + (3 * (c("vid") % 2)).cast("int") + (F.floor(c("vid") / 3) % 3).cast("int")
    x = edits(spark, d).select("vid", cds.alias("cds"), a.alias("a"), b.alias("b")).where("a <> b")
    one = lambda p: F.struct(c(p).alias("s"), (c(p) + 1).alias("e"), F.translate(S.part(c("cds"), c(p), F.lit(1)), "CT", "TC").alias("alt"))
    new = N.apply_all(c("cds"), F.array(one("a"), one("b")))
    return x.select("vid", F.size(N.protein_changes(S.translate(c("cds")), S.translate(new))).alias("changes"))


@query("t10_axis", "SELECT vid, acc AS tx, CASE WHEN axis = 'c' THEN description END AS output, CASE WHEN axis = 'n' THEN 'non-coding transcript' WHEN axis <> 'c' THEN 'no coding description on this transcript' END AS reason FROM variants", "variants")
def t10(spark, d):
    own = lambda a: F.when(c("axis") == a, c("description"))
    declined = F.when(c("axis") == "n", F.create_map(F.lit("coding"), F.lit("non-coding transcript"))).otherwise(F.create_map(F.lit("rna"), F.lit("not asked")))
    x = variants(spark, d).select("vid", c("acc").alias("tx"), own("g").alias("genomic"), own("c").alias("coding"), own("n").alias("noncoding"), own("r").alias("rna"), own("p").alias("protein"), declined.alias("declined"))
    return R.axis_of(x, "coding")


@query("w3_coding_problems", """, x AS (SELECT tx, substr(seq, cds_start::INT, (cds_end - cds_start + 1)::INT) AS cds, cds_end, len FROM tx_seqs WHERE cds_start IS NOT NULL), y AS (SELECT *, list_filter(range(0, length(cds) // 3), lambda i: substr(cds, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')) AS stops FROM x)
SELECT tx, array_to_string(list_filter([CASE WHEN left(cds, 3) <> 'ATG' THEN 'no_start' END, CASE WHEN NOT list_contains(stops, length(cds) // 3 - 1) THEN 'no_stop' END, CASE WHEN list_min(stops) < length(cds) // 3 - 1 THEN 'inner_stop' END], lambda x: x IS NOT NULL), ',') AS problems FROM y""", "tx_seqs")
def w3(spark, d):
    return R.coding_problems(t(spark, d, "tx_seqs")).select("tx", F.array_join("problems", ",").alias("problems"))


@query("w5_placements", "SELECT k % 50 AS ng, 'NC_000001.11' AS contig, CASE WHEN (k % 50) % 3 = 0 THEN -1 ELSE 1 END AS strand, min(5000 + 100 * (k % 50) + CASE WHEN k % 50 % 2 = 0 AND k % 7 = 0 THEN 3 ELSE 0 END) AS offset_ FROM transcripts GROUP BY k % 50 HAVING count(*) FILTER (k % 50 % 2 = 0 AND k % 7 = 0) = 0 OR count(*) FILTER (NOT (k % 50 % 2 = 0 AND k % 7 = 0)) = 0", "transcripts")
def w5(spark, d):
    """Anchors of regions on a contig; some of every other region's lie three bases off."""
    ng = c("k") % 50
    strand = F.when(ng % 3 == 0, -1).otherwise(1)
    g = 5000 + 100 * ng + strand * c("k") + F.when((ng % 2 == 0) & (c("k") % 7 == 0), 3).otherwise(0)
    x = t(spark, d, "transcripts").select(ng.alias("ng"), c("k").alias("inner"), F.lit("NC_000001.11").alias("contig"), g.alias("g"), strand.alias("strand"))
    return R.affine_placements(x).withColumnRenamed("offset", "offset_")


_LINES = ", x AS (SELECT vid AS line, description AS input, vid % 6 <> 0 AS ok FROM variants)\n"


def lines(spark, d):
    return variants(spark, d).select(c("vid").alias("line"), F.when(c("vid") % 6 == 0, F.concat(F.lit("!"), "description")).otherwise(c("description")).alias("text"))


@query("x2_lines_in_order", _LINES + "SELECT line, CASE WHEN ok THEN input ELSE '!' || input END AS input, CASE WHEN ok THEN input END AS canonical, ok, CASE WHEN NOT ok THEN 'no accession' END AS error FROM x", "variants")
def x2(spark, d):
    return B.parsed_lines(lines(spark, d)).orderBy("line")


@query("x1_progress", _LINES + "SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM x", "variants")
def x1(spark, d):
    """What an observation has counted by the end of a pass that writes the results elsewhere."""
    seen = Observation("lines")
    B.parsed_lines(lines(spark, d), seen=seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["total"], got["ok"], got["failed"])], "total long, ok long, failed long")


@query("x3_without_errors", _LINES + "SELECT line, input, input AS canonical FROM x WHERE ok", "variants")
def x3(spark, d):
    return B.only_parsed(B.parsed_lines(lines(spark, d)))


@query("y11_table", "SELECT category, median(CASE WHEN tool = 'left' THEN seconds END) AS \"left\", median(CASE WHEN tool = 'right' THEN seconds END) AS \"right\", NULL::DOUBLE AS other FROM tool_runs GROUP BY category", "tool_runs")
def y11(spark, d):
    return B.table(t(spark, d, "tool_runs"), "category", "tool", ["left", "right", "other"], "seconds")
