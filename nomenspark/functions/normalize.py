"""Normalization against references as columns: bounds of shifts, minimal notation, decomposition, inverted copies, several
edits on one sequence, descriptions from sequence pairs, and what a normalization did as diagnostics.

Positions are 0-based half-open unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import canonical, chance, common_prefix, let, part, reverse_complement, shift_deletion, shift_insertion

#: An adjacent copy that random bases would spell this often is no evidence.
MOST_CHANCE = 0.01


def region(s: Column, cds_start: Column, cds_end: Column) -> Column:
    """5utr, cds, 3utr, or none on a non-coding transcript; cds_start and cds_end 1-based inclusive."""
    return F.when(cds_start.isNull() | (cds_end < cds_start), "none").when(s + 1 < cds_start, "5utr").when(s + 1 > cds_end, "3utr").otherwise("cds")


def axis_bounds(s: Column, cds_start: Column, cds_end: Column, length: Column) -> Column:
    """struct(lo, hi): the untranslated or coding region that a transcript position lies in."""
    where = region(s, cds_start, cds_end)
    lo = F.when(where == "cds", cds_start - 1).when(where == "3utr", cds_end).otherwise(0)
    hi = F.when(where == "5utr", cds_start - 1).when(where == "cds", cds_end).otherwise(length)
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def bounded(lo: Column, hi: Column, exon_lo: Column, exon_hi: Column) -> Column:
    """struct(lo, hi) where both the region and the exon allow a shift."""
    return F.struct(F.greatest(lo, exon_lo).cast("int").alias("lo"), F.least(hi, exon_hi).cast("int").alias("hi"))


def genomic_window(s: Column, e: Column, length: Column, flank: int = 100) -> Column:
    """struct(lo, hi): the bases that a shift on a genomic sequence looks at first."""
    return F.struct(F.greatest(s - flank, F.lit(0)).cast("int").alias("lo"), F.least(e + flank, length).cast("int").alias("hi"))


def canonical_within(seq: Column, s: Column, e: Column, payload: Column, lo: Column, hi: Column) -> Column:
    """sequences.canonical() that neither moves nor looks beyond [lo, hi); an edit that reaches over a bound stays pinned."""
    inside = (s >= lo) & (e <= hi)
    a, b = F.when(inside, lo).otherwise(s), F.when(inside, hi).otherwise(e)

    def back(x: Column, c: Column) -> Column:
        return F.struct(c["edit"].alias("edit"), (c["s"] + x["a"]).cast("int").alias("s"), (c["e"] + x["a"]).cast("int").alias("e"), c["alt"].alias("alt"))

    own = F.struct(part(seq, a, b - a).alias("seq"), a.cast("int").alias("a"), (s - a).cast("int").alias("s"), (e - a).cast("int").alias("e"), payload.alias("p"))
    return let(own, lambda x: let(canonical(x["seq"], x["s"], x["e"], x["p"]), lambda c: back(x, c)))


def shift_within(seq: Column, s: Column, e: Column, payload: Column, lo: Column, hi: Column) -> Column:
    """Places by which a deletion (payload empty) or an insertion (s = e) moves inside its bounds; 0 for all else."""
    inside = (s >= lo) & (e <= hi)
    room = F.greatest(hi - e, F.lit(0))
    free = F.when((payload == "") & (e > s), shift_deletion(seq, s, e)).when((s == e) & (payload != ""), shift_insertion(seq, s, payload)).otherwise(0)
    return F.when(inside, F.least(free, room)).otherwise(0).cast("int")


def diagnostics(shift: Column, free: Column, clamped: Column, warning: Column) -> Column:
    """Codes of what happened: SHUFFLE_APPLIED with a shift, AXIS_CLAMP_APPLIED if the region's bound held it up, before
    which the exon would have let it go on, REFSEQ_MISMATCH for a W5001."""
    return F.array_compact(F.array(
        F.when(warning == "W5001", F.lit("REFSEQ_MISMATCH")), F.when(shift > 0, F.lit("SHUFFLE_APPLIED")), F.when(clamped & (free > shift), F.lit("AXIS_CLAMP_APPLIED")),
    ))


def coding_place(n: Column, cds_start: Column, cds_end: Column) -> Column:
    """The 1-based transcript position n as a coding position: -3, 12, *5; as it is on a non-coding transcript."""
    return (
        F.when(cds_start.isNull(), n.cast("string")).when(n > cds_end, F.concat(F.lit("*"), (n - cds_end).cast("string"))).when(n < cds_start, (n - cds_start).cast("string"))
        .otherwise((n - cds_start + 1).cast("string"))
    )


def transcript_description(tx: Column, seq: Column, c: Column, cds_start: Column, cds_end: Column) -> Column:
    """The c. description (n. without a coding region) of canonical()'s struct on a transcript."""
    at = lambda n: coding_place(n, cds_start, cds_end)
    lo, hi = at(c["s"] + 1), at(c["e"])
    place = F.when(c["e"] > c["s"] + 1, F.concat(lo, F.lit("_"), hi)).otherwise(lo)
    body = (
        F.when(c["edit"] == "ins", F.concat(at(c["s"]), F.lit("_"), lo, F.lit("ins"), c["alt"])).when(c["edit"] == "identity", F.concat(place, F.lit("=")))
        .when(c["edit"] == "sub", F.concat(lo, part(seq, c["s"], F.lit(1)), F.lit(">"), c["alt"])).otherwise(F.concat(place, c["edit"], c["alt"]))
    )
    return F.concat(tx, F.when(cds_start.isNull(), ":n.").otherwise(":c."), body)


def rna_description(description: Column) -> Column:
    """The predicted r. description of a c. one, in lower case with u for t; null for positions in introns and p. texts."""
    own = F.regexp_extract(description, r":[cn]\.(.*)$", 1)
    intron = own.rlike(r"\d[+-](?:\d|\?)")
    said = F.regexp_replace(F.translate(own, "ACGTN", "acgun"), "([acgun])>([acgun])", "$1>$2")
    return F.when((own != "") & ~intron, F.concat(F.regexp_extract(description, r"^([^:]*):", 1), F.lit(":r.("), said, F.lit(")")))


def minimal(edit: Column, ref: Column, alt: Column) -> Column:
    """struct(edit, ref, alt) without what a reference says already: bases or a size after del, dup and inv go, and a
    substitution or delins by the same bases is an identity."""
    same = edit.isin("sub", "delins") & (ref == alt) & (ref != "")
    kept = F.when(same, "identity").otherwise(edit)
    return F.struct(kept.alias("edit"), F.when(kept == "sub", ref).otherwise("").alias("ref"), F.when(kept.isin("sub", "ins", "delins"), alt).otherwise("").alias("alt"))


def needs_minimal(edit: Column, ref: Column, alt: Column) -> Column:
    m = minimal(edit, ref, alt)
    return (m["edit"] != edit) | (m["ref"] != ref) | (m["alt"] != alt)


def decompose(ref: Column, alt: Column) -> Column:
    """array of struct(edit, s, e, alt) of an equal-length replacement, relative to its start: each run of changed bases is an
    inversion if all of it is the reverse complement, else a substitution or a delins. Null if the lengths differ, under two
    bases, or if one run is the whole and no inversion, where nothing is gained."""
    n = F.length(ref)
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(ref, i + 1, F.lit(1)) != F.substring(alt, i + 1, F.lit(1)))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(runs: Column, i: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        one = F.struct(i.cast("int").alias("s"), (i + 1).cast("int").alias("e"))
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["s"].alias("s"), (i + 1).cast("int").alias("e"))))
        return F.when(last["e"] == i, grown).otherwise(F.concat(runs, F.array(one)))

    def typed(r: Column) -> Column:
        a, b = part(ref, r["s"], r["e"] - r["s"]), part(alt, r["s"], r["e"] - r["s"])
        edit = F.when((F.length(a) > 1) & (b == reverse_complement(a)), "inv").when(F.length(a) == 1, "sub").otherwise("delins")
        return F.struct(edit.alias("edit"), r["s"].alias("s"), r["e"].alias("e"), F.when(edit != "inv", b).otherwise("").alias("alt"))

    def decide(pieces: Column) -> Column:
        whole = (F.size(pieces) == 1) & (pieces[0]["edit"] != "inv") & (pieces[0]["e"] - pieces[0]["s"] == n)
        return F.when(~whole, pieces)

    some = let(F.aggregate(differ, empty, step), lambda runs: let(F.transform(runs, typed), decide))
    return F.when((n == F.length(alt)) & (n >= 2) & (ref != alt), some)


def inverted_copy(seq: Column, at: Column, payload: Column, flank: int = 50) -> Column:
    """struct(lo, hi), 1-based inclusive: the bases before 0-based at whose reverse complement is inserted there; null for
    one base, for a plain duplication, and where random bases of the neighbourhood would spell it too often."""
    n = F.length(payload)
    before = part(seq, at - n, n)
    left = F.greatest(at - flank, F.lit(0))
    unlikely = chance(part(seq, left, at + flank - left), payload) < MOST_CHANCE
    fits = (n > 1) & (at >= n) & (reverse_complement(before) == payload) & (before != payload) & unlikely
    return F.when(fits, F.struct((at - n + 1).cast("int").alias("lo"), at.cast("int").alias("hi")))


def apply_all(seq: Column, edits: Column) -> Column:
    """The sequence with all edits (array of struct s, e, alt) made; null if two of them overlap or share an insertion place."""
    ordered = F.array_sort(F.transform(edits, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["alt"].alias("alt"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"), F.lit(-1).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        fine = acc["ok"] & (x["s"] >= acc["at"]) & ~((x["s"] == x["e"]) & (acc["gap"] == x["s"]))
        return F.struct(x["e"].cast("int").alias("at"), F.concat(acc["out"], part(seq, acc["at"], x["s"] - acc["at"]), x["alt"]).alias("out"), fine.alias("ok"), F.when(x["s"] == x["e"], x["s"]).otherwise(-1).cast("int").alias("gap"))

    return F.aggregate(ordered, start, step, lambda acc: F.when(acc["ok"], F.concat(acc["out"], F.substr(seq, acc["at"] + 1))))


def from_sequences(position: Column, ref: Column, alt: Column) -> Column:
    """struct(edit, s, e, alt, touches_start, touches_end) of what turns the window ref, which starts at 0-based position, into
    alt: the canonical edit inside the window and whether it reaches an edge, beyond which it might go on."""

    def found(w: Column, c: Column) -> Column:
        return F.struct(
            c["edit"].alias("edit"), (c["s"] + w["at"]).cast("int").alias("s"), (c["e"] + w["at"]).cast("int").alias("e"), c["alt"].alias("alt"),
            ((c["s"] == 0) & (c["edit"] != "identity")).alias("touches_start"), ((c["e"] == F.length(w["ref"])) & (c["edit"] != "identity")).alias("touches_end"),
        )

    windows = F.struct(position.alias("at"), ref.alias("ref"), alt.alias("alt"))
    return let(windows, lambda w: let(canonical(w["ref"], F.lit(0), F.length(w["ref"]), w["alt"]), lambda c: found(w, c)))


def to_sequences(seq: Column, s: Column, e: Column, payload: Column, pad: int = 128) -> Column:
    """struct(position, ref, alt, window_is_final): the edit as a pair of windows, pad bases wider on both sides; position is
    0-based. The window is final if the edit can't move beyond its 3' edge, be it because the sequence ends there."""
    lo, hi = F.greatest(s - pad, F.lit(0)), F.least(e + pad, F.length(seq))
    old = part(seq, lo, hi - lo)
    new = F.concat(part(seq, lo, s - lo), payload, part(seq, e, hi - e))
    pair = F.struct(lo.cast("int").alias("position"), old.alias("ref"), new.alias("alt"))
    final = lambda w: (from_sequences(w["position"], w["ref"], w["alt"])["e"] < hi) | (hi == F.length(seq))
    return let(pair, lambda w: F.struct(w["position"].alias("position"), w["ref"].alias("ref"), w["alt"].alias("alt"), final(w).alias("window_is_final")))


def extracted(ref: Column, alt: Column) -> Column:
    """array of struct(edit, s, e, alt): the edits that turn ref into alt: the pieces of an equal-length change, else the one
    canonical edit."""
    trimmed = let(common_prefix(ref, alt), lambda p: let(common_prefix(F.reverse(F.substr(ref, p + 1)), F.reverse(F.substr(alt, p + 1))), lambda q: F.struct(
        p.alias("p"), part(ref, p, F.length(ref) - p - q).alias("r"), part(alt, p, F.length(alt) - p - q).alias("a"))))
    one = F.transform(F.array(canonical(ref, F.lit(0), F.length(ref), alt)), lambda c: F.struct(c["edit"].alias("edit"), c["s"].alias("s"), c["e"].alias("e"), c["alt"].alias("alt")))

    def either(t: Column) -> Column:
        pieces = F.transform(decompose(t["r"], t["a"]), lambda x: F.struct(x["edit"].alias("edit"), (x["s"] + t["p"]).cast("int").alias("s"), (x["e"] + t["p"]).cast("int").alias("e"), x["alt"].alias("alt")))
        return F.coalesce(F.when(F.size(pieces) > 1, pieces), one)

    return let(trimmed, either)


def cigar_offset(offset: Column, gaps: Column) -> Column:
    """A transcript offset into an exon as an offset on the contig: each deletion before it (bases of the contig that the
    transcript lacks) adds, each insertion subtracts; null inside an insertion. gaps: array of struct(op, at, len) by at,
    the transcript offset where they lie; op D or I."""
    inside = F.exists(gaps, lambda g: (g["op"] == "I") & (offset >= g["at"]) & (offset < g["at"] + g["len"]))
    delta = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + F.when((g["op"] == "D") & (g["at"] <= offset), g["len"]).when((g["op"] == "I") & (g["at"] + g["len"] <= offset), -g["len"]).otherwise(0))
    return F.when(~inside, offset + delta)


def extension(cds: Column, utr: Column, stop: Column) -> Column:
    """struct(residue, count): what the stop codon becomes when it is replaced by the codon stop, and how many residues follow
    until the next stop in the 3' UTR; count null if there is none. Null if stop is a stop."""
    from .sequences import amino_acid, translate

    residue = amino_acid(stop)
    at = F.instr(translate(utr), "*")
    return F.when(residue != "*", F.struct(residue.alias("residue"), F.when(at > 0, at).alias("count")))


def protein_changes(old: Column, new: Column) -> Column:
    """array of struct(number, ref, alt) of the residues that differ up to the first stop, of proteins of one length; null if
    the lengths differ."""
    stop = lambda x: F.concat(F.substring_index(x, "*", 1), F.lit("*"))

    def compared(x: Column) -> Column:
        letter = lambda name, i: F.substring(x[name], i, F.lit(1))
        each = F.filter(F.sequence(F.lit(1), F.length(x["a"])), lambda i: letter("a", i) != letter("b", i))
        found = F.transform(each, lambda i: F.struct(i.cast("long").alias("number"), letter("a", i).alias("ref"), letter("b", i).alias("alt")))
        return F.when(F.length(x["a"]) == F.length(x["b"]), found)

    return let(F.struct(stop(old).alias("a"), stop(new).alias("b")), compared)


# ---- pairs of descriptions

#: Levels of agreement, strongest first, and what each is worth; undecided and different ones have no rank.
LEVELS = {"identical": 5, "normalized_match": 4, "sequence_match": 3, "cross_axis_match": 2, "accession_version_difference": 1}


def pair_level(a: Column, b: Column) -> Column:
    """How two descriptions agree, each a struct(text, accession, normalized, key, axis): equal texts, equal but for the
    version, equal when normalized, equal but for the version then, undecided without a key, equal sequences on one axis or
    across, else not equivalent."""
    bare = lambda x, y: F.regexp_replace(F.regexp_replace(x, r"\.\d+:", ":"), r"\.\d+\(", "(") == F.regexp_replace(F.regexp_replace(y, r"\.\d+:", ":"), r"\.\d+\(", "(")
    return (
        F.when(a["text"] == b["text"], "identical").when((a["accession"] != b["accession"]) & bare(a["text"], b["text"]), "accession_version_difference")
        .when(a["normalized"] == b["normalized"], "normalized_match").when((a["accession"] != b["accession"]) & bare(a["normalized"], b["normalized"]), "accession_version_difference")
        .when(a["key"].isNull() | b["key"].isNull(), "indeterminate").when(a["key"] == b["key"], F.when(a["axis"] == b["axis"], "sequence_match").otherwise("cross_axis_match"))
        .otherwise("not_equivalent")
    )


def denotation(key_a: Column, key_b: Column) -> Column:
    """Whether two descriptions denote one sequence, by canonical keys alone: same, different or indeterminate."""
    return F.when(key_a.isNull() | key_b.isNull(), "indeterminate").when(key_a == key_b, "same").otherwise("different")


def is_equivalent(level: Column) -> Column:
    return ~level.isin("not_equivalent", "indeterminate")


def is_decided(level: Column) -> Column:
    return level != "indeterminate"


def is_at_least(level: Column, floor: Column) -> Column:
    """By rank; false where one of the two has none."""
    ranks = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, level) >= F.try_element_at(ranks, floor), F.lit(False))
