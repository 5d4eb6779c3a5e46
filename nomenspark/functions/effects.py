"""Effects as columns: consequence terms, splice classes, decay, start context, back-translation, protein change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import CODONS, amino_acid, common_prefix, let, translate

#: term, rank (most severe highest). Fixed values of the Sequence Ontology's terms and the usual order.
CONSEQUENCES = (
    ("transcript_ablation", 19), ("splice_acceptor_variant", 18), ("splice_donor_variant", 17), ("stop_gained", 16), ("frameshift_variant", 15), ("stop_lost", 14),
    ("start_lost", 13), ("inframe_insertion", 12), ("inframe_deletion", 11), ("missense_variant", 10), ("protein_altering_variant", 9), ("splice_region_variant", 8),
    ("start_retained_variant", 7), ("stop_retained_variant", 6), ("synonymous_variant", 5), ("coding_sequence_variant", 4), ("5_prime_UTR_variant", 3),
    ("3_prime_UTR_variant", 2), ("intron_variant", 1),
)


def severity(term: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in CONSEQUENCES for x in kv])
    return F.try_element_at(ranks, term)


def impact(term: Column) -> Column:
    r = severity(term)
    return F.when(r >= 13, "HIGH").when(r >= 9, "MODERATE").when(r >= 5, "LOW").when(r >= 1, "MODIFIER")


def amino_acid_change(number: Column, ref: Column, alt: Column) -> Column:
    """One-letter residues; * is a stop."""
    return (
        F.when((number == 1) & (ref == "M"), F.when(alt == "M", "start_retained_variant").otherwise("start_lost"))
        .when(ref == alt, F.when(ref == "*", "stop_retained_variant").otherwise("synonymous_variant"))
        .when(alt == "*", "stop_gained").when(ref == "*", "stop_lost").otherwise("missense_variant")
    )


def indel_change(net: Column) -> Column:
    return F.when(F.abs(net) % 3 != 0, "frameshift_variant").when(net > 0, "inframe_insertion").when(net < 0, "inframe_deletion").otherwise("coding_sequence_variant")


def splice_change(offset: Column) -> Column:
    """By distance from the exon; null for an unknown offset."""
    return (
        F.when(offset.isNull() | (offset == 0), F.lit(None)).when(F.abs(offset) <= 2, F.when(offset > 0, "splice_donor_variant").otherwise("splice_acceptor_variant"))
        .when(F.abs(offset) <= 8, "splice_region_variant").otherwise("intron_variant")
    )


def splice_site(offset: Column) -> Column:
    """The finer ladder: canonical, extended, region, near, deep; the second bound differs by side."""
    d = F.abs(offset)
    side = F.when(offset > 0, "donor").otherwise("acceptor")
    extended = F.when(offset > 0, 6).otherwise(12)
    return (
        F.when(offset.isNull() | (offset == 0), F.lit(None)).when(d <= 2, F.concat(side, F.lit("_canonical"))).when(d <= extended, F.concat(side, F.lit("_extended")))
        .when(d <= 20, F.concat(side, F.lit("_region"))).when(d <= 50, "near_splice").otherwise("deep_intronic")
    )


def utr_change(base: Column, utr3: Column) -> Column:
    return F.when(utr3, "3_prime_UTR_variant").when(base < 0, "5_prime_UTR_variant")


def decay(exons: Column, ptc: Column, stop: Column, last_exon: Column) -> Column:
    """struct(triggered, why) of a premature stop at ptc; last_exon is the last exon's first base."""
    d = last_exon - ptc
    why = (
        F.when(exons <= 1, "single_exon").when(ptc >= stop, "not_premature").when(ptc >= last_exon, "last_exon").when(d > 55, "high").when(d >= 50, "medium").otherwise("near_junction")
    )
    return F.struct(why.isin("high", "medium").alias("triggered"), why.alias("why"))


def kozak(around: Column) -> Column:
    """Strength of the start's context; around begins six bases before the start codon. Null if under ten bases."""
    purine, g = F.substring(around, 4, 1).isin("A", "G"), F.substring(around, 10, 1) == "G"
    return F.when(F.length(around) >= 10, F.when(purine & g, "strong").when(purine | g, "adequate").otherwise("weak"))


def codons_for(letter: Column) -> Column:
    """Codons of a one-letter amino acid, in TCAG order."""
    table: dict[str, list[str]] = {}
    for k, v in CODONS.items():
        table.setdefault(v, []).append(k)
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*pairs), letter)


def differences(a: Column, b: Column) -> Column:
    """Places where two codons differ."""
    return F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))


def back_translate(ref: Column, alt: Column) -> Column:
    """Changes of one base that turn a codon of ref into one of alt: array of struct(from, to, place)."""
    pairs = F.flatten(F.transform(codons_for(ref), lambda a: F.transform(codons_for(alt), lambda b: F.struct(a.alias("from"), b.alias("to"), differences(a, b).alias("d")))))
    single = F.filter(pairs, lambda x: F.size(x["d"]) == 1)
    return F.transform(single, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), F.element_at(x["d"], 1).alias("place")))


def codon_changes(codon: Column, alt: Column) -> Column:
    """Codons of alt by how many bases of the known codon change, fewest first, then in TCAG order."""
    each = F.transform(codons_for(alt), lambda b, i: F.struct(F.size(differences(codon, b)).alias("n"), i.alias("i"), b.alias("to")))
    return F.transform(F.array_sort(each), lambda x: F.struct(x["to"].alias("to"), x["n"].alias("n")))


def substitution_effect(cds: Column, base: Column, alt: Column) -> Column:
    """struct(number, ref, alt) of the residues that a base change in the coding sequence touches; base is 1-based."""
    first = (F.floor((base - 1) / 3) * 3 + 1).cast("int")
    old = F.substring(cds, first, F.lit(3))
    at = (base - first).cast("int")
    new = F.concat(F.substring(old, F.lit(1), at), alt, F.substr(old, at + 2))
    return F.struct(((first - 1) / 3 + 1).cast("long").alias("number"), amino_acid(old).alias("ref"), amino_acid(new).alias("alt"))


def protein_description(accession: Column, number: Column, ref: Column, alt: Column) -> Column:
    """The predicted change of one residue (one-letter) in three letters."""
    from .descriptions import three_letters

    lead, place = F.concat(accession, F.lit(":p.(")), number.cast("string")
    body = (
        F.when((number == 1) & (ref == "M"), F.lit("Met1?")).when(ref == alt, F.concat(three_letters(ref), place, F.lit("=")))
        .when(ref == "*", F.concat(F.lit("Ter"), place, three_letters(alt), F.lit("ext*?"))).otherwise(F.concat(three_letters(ref), place, three_letters(alt)))
    )
    return F.concat(lead, body, F.lit(")"))


def indel_effect(cds: Column, s: Column, e: Column, payload: Column) -> Column:
    """struct(kind, number, distance) of replacing [s, e) (0-based) of a coding sequence with what follows it: identity,
    frameshift with the first changed residue and the distance to the new stop (null if none), or in-frame. Codons before
    the edited one are read for a stop only, and the rest as far as a change and the stops ask for it."""
    first = (F.floor(s / 3) * 3).cast("int")  # of the edited codon, which is where the two proteins may part
    tail = F.concat(F.substring(cds, first + 1, (s - first).cast("int")), payload, F.substr(cds, (e + 1).cast("int")))
    given = F.struct(first.alias("first"), F.substr(cds, first + 1).alias("old"), tail.alias("new"), (F.length(payload) - (e - s)).alias("net"))

    def read(x: Column, bases: int | None) -> Column:
        take = lambda c: translate(c if bases is None else F.substring(c, 1, bases))

        def place(t: Column) -> Column:
            stop = F.instr(F.substr(t["new"], t["i"] + 1), "*")
            shifted = (F.abs(x["net"]) % 3) != 0
            # a stop before the edit ends both proteins alike
            same = stopped(F.substring(cds, F.lit(1), x["first"])) | (F.substring_index(t["old"], "*", 1) == F.substring_index(t["new"], "*", 1))
            kind = F.when(same, "identity").when(shifted & (stop == 1), "stop_gained").when(shifted, "frameshift").otherwise("in_frame")
            at = x["first"] / 3 + t["i"]
            out = F.struct(kind.alias("kind"), F.when(kind != "identity", at + 1).cast("long").alias("number"), F.when((kind == "frameshift") & (stop > 0), stop).cast("int").alias("distance"))
            if bases is None:
                return out
            # enough was read if the proteins part within it, and the stops that the answer needs lie in it
            whole = (F.length(x["old"]) <= bases) & (F.length(x["new"]) <= bases)
            known = (t["i"] < F.least(F.length(t["old"]), F.length(t["new"]))) & ((stop > 0) | ~shifted)
            return F.when(whole | (known & ~same) | (same & (F.instr(t["old"], "*") > 0)), out)

        def compared(t: Column) -> Column:
            return let(F.struct(t["old"].alias("old"), t["new"].alias("new"), common_prefix(t["old"], t["new"]).alias("i")), place)

        return let(F.struct(take(x["old"]).alias("old"), take(x["new"]).alias("new")), compared)

    return let(given, lambda x: F.coalesce(read(x, 96), read(x, None)))


def stopped(seq: Column) -> Column:
    """Whether one of the whole codons is a stop."""
    return F.concat(F.lit(""), F.upper(F.translate(seq, "Uu", "TT"))).rlike("^(?:...)*?(?:TAA|TAG|TGA)")


def annotated_consequence(coding: Column, offset: Column, utr5: Column, utr3: Column, edit: Column, net: Column) -> Column:
    """The term that a record's annotation gets: non-coding, then introns by their distance, then the untranslated regions,
    then the edit. offset is null in exons; net null if unknown."""
    frame = F.coalesce(F.abs(net) % 3 != 0, F.lit(False))
    return (
        F.when(~coding, "non_coding_transcript_variant").when(offset.isNotNull(), F.when(F.abs(offset) <= 2, "splice_region_variant").otherwise("intron_variant"))
        .when(utr5, "5_prime_UTR_variant").when(utr3, "3_prime_UTR_variant").when(edit == "sub", "sequence_variant").when(frame, "frameshift_variant")
        .when(edit.isin("ins", "dup", "dupins"), "inframe_insertion").when(edit.isin("del", "delins"), "inframe_deletion").otherwise("sequence_variant")
    )


def start_context_change(before: Column, after: Column) -> Column:
    """What a change does to the start's context: kept, weakened or strengthened; null if a context is too short."""
    rank = F.create_map(*[F.lit(x) for kv in (("weak", 0), ("adequate", 1), ("strong", 2)) for x in kv])
    a, b = F.try_element_at(rank, kozak(before)), F.try_element_at(rank, kozak(after))
    return F.when(a > b, "weakened").when(a < b, "strengthened").when(a == b, "kept")


def frameshift_decay(exons: Column, effect: Column, cds_start: Column, stop: Column, last_exon: Column) -> Column:
    """decay() at the new stop of indel_effect()'s struct; null unless it is a frameshift that finds a stop."""
    ptc = cds_start + 3 * (effect["number"] + effect["distance"] - 2)
    return F.when((effect["kind"] == "frameshift") & effect["distance"].isNotNull(), decay(exons, ptc, stop, last_exon))


def residues(letters: Column) -> Column:
    """One-letter residues in three letters."""
    from .descriptions import three_letters

    return F.array_join(F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: three_letters(x)), "")


def protein_edit(old: Column, new: Column) -> Column:
    """The p. edit between two proteins (one-letter, up to their stops), without accession: identity, substitution, deletion and
    insertion at their last place, duplication, delins."""
    from .sequences import common_suffix, part, rotate, shift_deletion, shift_insertion

    def read(x: Column) -> Column:
        a, b = x["a"], x["b"]
        letter = lambda i: F.concat(residues(part(a, i, F.lit(1))), (i + 1).cast("string"))
        span = lambda lo, hi: F.when(hi > lo + 1, F.concat(letter(lo), F.lit("_"), letter(hi - 1))).otherwise(letter(lo))

        def trimmed(p: Column) -> Column:
            q = common_suffix(F.substr(a, p + 1), F.substr(b, p + 1))
            return let(F.struct(p.alias("p"), part(a, p, F.length(a) - p - q).alias("r"), part(b, p, F.length(b) - p - q).alias("n")), say)

        def say(t: Column) -> Column:
            lo, hi = t["p"], t["p"] + F.length(t["r"])

            def inserted(k: Column) -> Column:
                at, rolled = lo + k, rotate(t["n"], k)
                n = F.length(rolled)
                dup = (at >= n) & (part(a, at - n, n) == rolled)
                return F.when(dup, F.concat(span(at - n, at), F.lit("dup"))).otherwise(F.concat(letter(at - 1), F.lit("_"), letter(at), F.lit("ins"), residues(rolled)))

            return (
                F.when(a == b, "=").when(t["n"] == "", let(shift_deletion(a, lo, hi), lambda k: F.concat(span(lo + k, hi + k), F.lit("del"))))
                .when(t["r"] == "", let(shift_insertion(a, lo, t["n"]), inserted))
                .when((F.length(t["r"]) == 1) & (F.length(t["n"]) == 1), F.concat(letter(lo), residues(t["n"]))).otherwise(F.concat(span(lo, hi), F.lit("delins"), residues(t["n"])))
            )

        return let(common_prefix(a, b), trimmed)

    return let(F.struct(old.alias("a"), new.alias("b")), read)
