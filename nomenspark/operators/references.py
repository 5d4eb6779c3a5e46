"""Descriptions carried between axes, records and sequences by joins with transcripts, exons and stored sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenspark.functions import normalize as N
from nomenspark.functions.sequences import part, reverse_complement, spdi

from .coordinates import tx_to_genome
from .intervals import stab
from .lookups import window


def with_bounds(edits: DataFrame, exons: DataFrame, cross: bool = False) -> DataFrame:
    """edits (tx, s, e, cds_start, cds_end, len) with lo and hi, where a shift may go: the exon and the region that the edit's
    first base lies in, with exon_lo, exon_hi and region. cross: over exon bounds."""
    own = exons.select("tx", F.col("t0").alias("_t0"), F.col("t1").alias("_t1"))
    hit = edits.join(own, "tx").where((F.col("s") >= F.col("_t0")) & (F.col("s") < F.col("_t1")))
    lo, hi = (F.lit(0), F.col("len")) if cross else (F.col("_t0"), F.col("_t1"))
    rows = hit.withColumns({"exon_lo": lo.cast("int"), "exon_hi": hi.cast("int"), "region": N.region(F.col("s"), F.col("cds_start"), F.col("cds_end")), "_a": N.axis_bounds(F.col("s"), F.col("cds_start"), F.col("cds_end"), F.col("len"))})
    bound = N.bounded(F.col("_a.lo"), F.col("_a.hi"), F.col("exon_lo"), F.col("exon_hi"))
    return rows.withColumn("_b", bound).withColumns({"lo": F.col("_b.lo"), "hi": F.col("_b.hi")}).drop("_t0", "_t1", "_a", "_b")


def conflicts(members: DataFrame, by: list[str]) -> DataFrame:
    """by, place and what, of members (by, vid, edit, s, e; 0-based half-open, insertions with s = e) of cis alleles that can't
    both be: coincident (two edits of the same bases), interior (an insertion strictly inside bases that another keeps), and
    insertions (two at one place). Running maxima per allele; no pair of members is ever written down."""
    spans = members.where("s < e").groupBy(*by, "s", "e").agg(F.count("*").alias("_n"), F.min("vid").alias("vid")).where("_n > 1")
    one = spans.select(*by, F.col("s").alias("place"), F.lit("coincident").alias("what"))
    gaps = members.where("s = e").groupBy(*by, "s").agg(F.count("*").alias("_n")).where("_n > 1").select(*by, F.col("s").alias("place"), F.lit("insertions").alias("what"))
    kept = F.when((F.col("s") < F.col("e")) & (F.col("edit") != "del"), F.col("e"))
    w = Window.partitionBy(*by).orderBy("s").rangeBetween(Window.unboundedPreceding, -1)
    inside = members.withColumn("_reach", F.max(kept).over(w)).where((F.col("s") == F.col("e")) & (F.col("_reach") > F.col("s")))
    return one.union(gaps).union(inside.select(*by, F.col("s").alias("place"), F.lit("interior").alias("what")).distinct())


def merged(members: DataFrame, by: list[str], seq: str = "seq", cds: str | None = None) -> DataFrame:
    """by, s, e, alt and members of cis edits (by, s, e, alt; 0-based half-open, not overlapping): neighbours without an
    unchanged base between them become one, and on a coding axis (cds: 0-based start) substitutions of one codon too, with
    the base between them."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before, start = F.lag("e").over(w), F.lag("s").over(w)
    apart = F.col("s") > before
    if cds:
        codon = lambda x: F.floor((x - F.col(cds)) / 3)
        alone = (F.col("e") - F.col("s") == 1) & (F.length("alt") == 1)
        both = alone & F.lag(alone).over(w) & (codon(F.col("s")) == codon(start)) & (F.col("s") >= F.col(cds))
        apart = apart & ~F.coalesce(both, F.lit(False))
    rows = members.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    grouped = rows.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("s", "e", "alt"))).alias("_m"), F.first(seq).alias("_seq"))
    start = F.struct(F.col("s").cast("int").alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(x["e"].cast("int").alias("at"), F.concat(a["out"], part(F.col("_seq"), a["at"], x["s"] - a["at"]), x["alt"]).alias("out"))
    return grouped.select(*by, "s", "e", F.aggregate("_m", start, step, lambda a: a["out"]).alias("alt"), F.size("_m").alias("members"))


def expanded(rows: DataFrame, stored: DataFrame, key: str, size: int = 64) -> DataFrame:
    """rows (key, source, from_, to, inverted; 1-based inclusive ranges of stored sequences that are inserted) with payload,
    their bases; null where the sequence is not stored."""
    need = rows.select(key, F.col("source").alias("acc"), (F.col("from_") - 1).alias("s"), F.col("to").alias("e"))
    got = window(need, stored, key, size).select(key, "bases")
    return rows.join(got, key, "left").withColumn("payload", F.when(F.col("inverted"), reverse_complement(F.col("bases"))).otherwise(F.col("bases"))).drop("bases")


def to_spdi(rows: DataFrame, stored: DataFrame, key: str, size: int = 64) -> DataFrame:
    """key and spdi of edits (key, acc, edit, s, e, alt; 0-based half-open) on any axis, with the bases that the stored
    sequences hold: a substitution, deletion, delins, inversion or identity names them, a duplication inserts them after
    itself, an insertion needs none."""
    need = rows.where("edit <> 'ins'").select(key, "acc", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    got = window(need, stored, key, size).select(key, F.col("bases").alias("_held"))
    x = rows.join(got, key, "left")
    held, edit = F.col("_held"), F.col("edit")
    says = (
        F.when(edit == "ins", spdi(F.col("acc"), F.col("s"), F.lit(""), F.col("alt"))).when(held.isNull(), F.lit(None)).when(edit.isin("sub", "delins"), spdi(F.col("acc"), F.col("s"), held, F.col("alt")))
        .when(edit == "del", spdi(F.col("acc"), F.col("s"), held, F.lit(""))).when(edit == "dup", spdi(F.col("acc"), F.col("e"), F.lit(""), held))
        .when(edit == "inv", spdi(F.col("acc"), F.col("s"), held, reverse_complement(held))).when(edit == "identity", spdi(F.col("acc"), F.col("s"), held, held))
    )
    return x.select(key, says.alias("spdi"))


def records_on_transcripts(records: DataFrame, exons: DataFrame, transcripts: DataFrame, key: str = "vid") -> DataFrame:
    """key, tx, strand, description and error of records (key, contig, pos, ref, alt; trimmed, 1-based) on each transcript that
    has an exon at their first base: on the transcript's strand, c. where it codes, else n. A change that leaves the exon
    is an error: crosses_exon."""
    last = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    # an insertion lies between pos - 1 and pos
    rows = records.withColumns({"_g0": F.col("pos") - 1, "_last": last, "_gap": F.length("ref") == 0})
    own = exons.select("tx", "contig", F.col("t0").alias("_t0"), F.col("t1").alias("_t1"), F.col("strand").alias("_strand"), "x0", "x1")
    plus = F.col("_strand") == 1
    on = stab(rows, own, "contig", "_g0", "x0", "x1")
    on = on.withColumn("n", F.col("_t0") + 1 + F.when(plus, F.col("_g0") - F.col("x0")).otherwise(F.col("x1") - 1 - F.col("_g0")))
    width = F.col("_last") - F.col("pos")
    # 0-based half-open on the transcript
    s = F.when(plus, F.col("n") - 1).when(F.col("_gap"), F.col("n")).otherwise(F.col("n") - 1 - width)
    e = F.when(F.col("_gap"), s).otherwise(s + width + 1)
    inside = (s >= F.col("_t0")) & (e <= F.col("_t1")) & (~F.col("_gap") | ((s > F.col("_t0")) & (s < F.col("_t1"))))
    on_strand = lambda x: F.when(plus, x).otherwise(reverse_complement(x))
    ref, alt = on_strand(F.col("ref")), on_strand(F.col("alt"))
    x = on.select(key, "tx", F.col("_strand").alias("strand"), s.alias("s"), e.alias("e"), inside.alias("_inside"), ref.alias("ref"), alt.alias("alt"))
    x = x.join(transcripts.select("tx", "cds_start", "cds_end"), "tx")
    r, a = F.length("ref"), F.length("alt")
    at = lambda n: N.coding_place(n, F.col("cds_start"), F.col("cds_end"))
    lo, hi = at(F.col("s") + 1), at(F.col("e"))
    place = F.when(r > 1, F.concat(lo, F.lit("_"), hi)).otherwise(lo)
    body = (
        F.when((r == 0) & (a == 0), F.lit(None)).when((r == 1) & (a == 1), F.concat(lo, "ref", F.lit(">"), "alt")).when(a == 0, F.concat(place, F.lit("del")))
        .when(r == 0, F.concat(at(F.col("s")), F.lit("_"), lo, F.lit("ins"), "alt")).otherwise(F.concat(place, F.lit("delins"), "alt"))
    )
    text = F.concat("tx", F.when(F.col("cds_start").isNull(), ":n.").otherwise(":c."), body)
    error = F.when(~F.col("_inside"), "crosses_exon").when(body.isNull(), "no_change")
    return x.select(key, "tx", "strand", F.when(error.isNull(), text).alias("description"), error.alias("error"))


def substitutions_to_records(rows: DataFrame, exons: DataFrame, key: str = "vid") -> DataFrame:
    """key, contig, pos, ref, alt and error of substitutions on transcripts (key, tx, n, off, ref, alt; n 1-based, off into an
    intron): on the contig's strand. A position outside the transcript is an error."""
    placed = tx_to_genome(rows, exons)
    strands = exons.select("tx", "strand").distinct()
    x = placed.join(strands, "tx")
    on = lambda c: F.when(F.col("strand") == 1, F.col(c)).otherwise(reverse_complement(F.col(c)))
    found = x.select(key, "contig", F.col("g").alias("pos"), on("ref").alias("_ref"), on("alt").alias("_alt"))
    out = rows.select(key).join(found, key, "left")
    return out.select(key, "contig", "pos", F.col("_ref").alias("ref"), F.col("_alt").alias("alt"), F.when(F.col("pos").isNull(), "no_such_position").alias("error"))


def genomic_to_record(parsed: Column) -> Column:
    """struct(accession, pos, ref, alt, error) of a parsed genomic description without any reference: substitutions and
    identities state all that a record needs, all others need bases that only a reference has; other axes are refused."""
    axis, edit = parsed["axis"], parsed["edit"]
    error = F.when(edit.isNull(), "not_parsed").when(~axis.isin("g", "m", "o"), F.concat(F.lit("axis_"), axis)).when(edit != "sub", "needs_reference")
    ok = error.isNull()
    return F.struct(F.when(ok, parsed["accession"]).alias("accession"), F.when(ok, parsed["s"]).alias("pos"), F.when(ok, parsed["ref"]).alias("ref"), F.when(ok, parsed["alt"]).alias("alt"), error.alias("error"))


def extended_to_genome(rows: DataFrame, exons: DataFrame) -> DataFrame:
    """rows (tx, n) with contig and g; positions past the transcript's end go on along the last exon, as a poly-A tail does."""
    w = Window.partitionBy("tx")
    own = exons.select("tx", "contig", "strand", "t0", "t1", "x0", "x1", (F.max("t1").over(w) == F.col("t1")).alias("_last"))
    hit = rows.join(own, "tx").where((F.col("n") > F.col("t0")) & ((F.col("n") <= F.col("t1")) | F.col("_last")))
    into = F.col("n") - 1 - F.col("t0")
    return hit.withColumn("g", F.when(F.col("strand") == 1, F.col("x0") + into + 1).otherwise(F.col("x1") - into)).drop("strand", "t0", "t1", "x0", "x1", "_last")


def interval_to_genome(rows: DataFrame, exons: DataFrame, key: str = "vid") -> DataFrame:
    """key, tx, contig, lo and hi (ascending, 1-based inclusive) of transcript intervals (key, tx, n1, n2); an interval with an
    end outside the exons goes."""
    ends = rows.select(key, "tx", F.explode(F.array("n1", "n2")).alias("n")).withColumn("off", F.lit(0))
    g = tx_to_genome(ends, exons).groupBy(key, "tx", "contig").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("_n"))
    return g.where("_n = 2").drop("_n")


def coding_problems(transcripts: DataFrame) -> DataFrame:
    """tx and problems of coding transcripts with their sequences (tx, seq, cds_start, cds_end): past_end, not_codons, no_start,
    no_stop, inner_stop."""
    from nomenspark.functions.sequences import translate

    cds = part(F.col("seq"), F.col("cds_start") - 1, F.col("cds_end") - F.col("cds_start") + 1)
    protein = translate(cds)
    rows = transcripts.where("cds_start IS NOT NULL").select("tx", F.length("seq").alias("_len"), "cds_start", "cds_end", cds.alias("_cds"), protein.alias("_p"))
    inner = F.instr(F.expr("substr(_p, 1, length(_p) - 1)"), "*") > 0
    problems = F.array_compact(F.array(
        F.when(F.col("cds_end") > F.col("_len"), F.lit("past_end")), F.when((F.col("cds_end") - F.col("cds_start") + 1) % 3 != 0, F.lit("not_codons")),
        F.when(~F.col("_cds").startswith("ATG"), F.lit("no_start")), F.when(~F.col("_p").endswith("*"), F.lit("no_stop")), F.when(inner, F.lit("inner_stop")),
    ))
    return rows.select("tx", problems.alias("problems"))


def affine_placements(anchors: DataFrame, by: str = "ng") -> DataFrame:
    """by, contig, strand and offset of regions whose anchors (by, inner, contig, g, strand) all lie on one line: g = offset +
    strand * inner; those with several lines or contigs go."""
    offset = F.col("g") - F.col("strand") * F.col("inner")
    g = anchors.groupBy(by).agg(F.min("contig").alias("contig"), F.max("contig").alias("_c"), F.min("strand").alias("strand"), F.max("strand").alias("_s"), F.min(offset).alias("offset"), F.max(offset).alias("_o"))
    return g.where("contig = _c AND strand = _s AND offset = _o").drop("_c", "_s", "_o")


def axis_of(projection: DataFrame, axis: str, key: str = "vid") -> DataFrame:
    """key, output and reason of one axis of projections (key, tx, genomic, coding, noncoding, rna, protein and, a map,
    declined): why there is none, if there is none."""
    reason = F.coalesce(F.try_element_at("declined", F.lit(axis)), F.lit(f"no {axis} description on this transcript"))
    return projection.select(key, "tx", F.col(axis).alias("output"), F.when(F.col(axis).isNull(), reason).alias("reason"))
