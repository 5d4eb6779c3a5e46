"""Sequences as columns: complements, translation, affixes, repeat units, shifts; edits in canonical form; SPDI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements. Fixed values.
IUPAC, COMPLEMENT = "ACGTURYKMBDHVNacgturykmbdhvn", "TGCAAYRMKVHDBNtgcaayrmkvhdbn"
#: Amino acids of the standard code, codons in the order TCAG. Fixed values.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


#: The human mitochondrion's record, which is described on an axis of its own. A fixed value.
MITOCHONDRION = "NC_012920."


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def part(seq: Column, start: Column, length: Column) -> Column:
    """length bases from 0-based start."""
    return F.substring(seq, (start + 1).cast("int"), length.cast("int"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def amino_acid(codon: Column) -> Column:
    """One letter, * for a stop; X for what is no codon in upper-case DNA letters."""
    at = F.call_function("instr", F.lit(",".join(CODONS)), codon)
    return F.when((at > 0) & (F.length(codon) == 3), F.substring(F.lit(CODE), F.floor((at - 1) / 4).cast("int") + 1, F.lit(1))).otherwise("X")


def translate(seq: Column) -> Column:
    """All whole codons, through stops; U counts as T, and case doesn't count. A codon of other letters gives X.

    Codons are set apart by a blank, and each of the 64 is replaced with its letter: string operations on the whole
    sequence, no step per codon. A codon and its blank are four characters that nothing else can spell.
    """
    dna = F.translate(F.upper(seq), "U", "T")
    text = F.regexp_replace(F.regexp_replace(dna, "(.{3})", "$1 "), " .{1,2}$", " ")
    text = F.when(F.length(dna) < 3, "").otherwise(text)
    for codon, letter in CODONS.items():
        text = F.replace(text, F.lit(codon + " "), F.lit(letter))
    return F.regexp_replace(text, ".{3} ", "X")


def translate_to_stop(seq: Column) -> Column:
    """Up to the first stop, without it."""
    return F.substring_index(translate(seq), "*", 1)


#: Places that are compared one by one before a search, and bases of a window that is looked at before the rest of a sequence.
NEAR, WINDOW = 8, 64


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix: the first places are compared one by one; beyond them by halving steps, as many as the
    shorter string's length has binary digits."""

    def search(x: Column) -> Column:
        def step(n: Column, k: Column) -> Column:
            by = F.call_function("shiftleft", F.lit(1), k)
            longer = (n + by <= x["n"]) & (F.substring(x["a"], n + 1, by) == F.substring(x["b"], n + 1, by))
            return F.when(longer, n + by).otherwise(n)

        digits = F.length(F.bin(x["n"].cast("long")))
        steps = F.aggregate(F.sequence(digits - 1, F.lit(0), F.lit(-1)), F.lit(0), step)
        near = F.when(x["n"] == 0, 0)
        for i in range(NEAR):
            differ = F.substring(x["a"], i + 1, 1) != F.substring(x["b"], i + 1, 1)
            near = near.when(differ, i).when(x["n"] == i + 1, i + 1)
        return near.otherwise(steps)

    return let(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n")), search)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def trimmed(a: Column, b: Column, body) -> Column:
    """body(struct(a, b), p, q) with the lengths of the common prefix, and of the common suffix of the rest, each value computed
    once a row."""

    def suffix(x: Column, p: Column) -> Column:
        return let(common_suffix(F.substr(x["a"], p + 1), F.substr(x["b"], p + 1)), lambda q: body(x, p, q))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: let(common_prefix(x["a"], x["b"]), lambda p: suffix(x, p)))


def smallest_unit(seq: Column) -> Column:
    """The shortest string whose repetition gives the sequence."""
    n = F.length(seq)
    sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: (n % k == 0) & (F.rpad(F.substring(seq, F.lit(1), k), n, F.substring(seq, F.lit(1), k)) == seq))
    return F.coalesce(F.substring(seq, F.lit(1), F.try_element_at(fits, F.lit(1))), F.lit(""))


def homopolymer(seq: Column, at: Column) -> Column:
    """struct(start, end): the run of one base around 0-based at, half-open."""
    base = part(seq, at, F.lit(1))
    left = F.length(F.regexp_extract(F.reverse(part(seq, F.lit(0), at)), "^(.)\\1*", 0))
    same = part(seq, at - 1, F.lit(1)) == base
    after = F.substr(seq, (at + 1).cast("int"))
    return F.struct((at - F.when((at > 0) & same, left).otherwise(0)).cast("int").alias("start"), (at + F.length(F.regexp_extract(after, "^(.)\\1*", 0))).cast("int").alias("end"))


def tandem_copies(seq: Column, at: Column, unit: Column) -> Column:
    """Copies of the unit that follow one another from 0-based at on."""
    run = F.call_function("regexp_extract", F.substr(seq, (at + 1).cast("int")), F.concat(F.lit("^(?:"), unit, F.lit(")*")), F.lit(0))
    return F.floor(F.length(run) / F.length(unit)).cast("int")


def chance(seq: Column, found: Column) -> Column:
    """Probability that random bases of seq's composition, one added to each count, spell found."""
    total = F.length(seq) + 4
    share = lambda b: (F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) + 1) / total
    bases = F.filter(F.split(found, ""), lambda b: b != "")
    p = lambda b: F.when(b == "A", share("A")).when(b == "C", share("C")).when(b == "G", share("G")).otherwise(share("T"))
    return F.aggregate(bases, F.lit(1.0), lambda x, b: x * p(b))


# ---- shifts towards the 3' end; s and e are 0-based, half-open


def shift_deletion(seq: Column, s: Column, e: Column) -> Column:
    """Places by which the deletion of [s, e) moves right: the common prefix of what starts at s and at e. The rest of the
    sequence is read only if all of the next WINDOW bases allow the move."""
    near = common_prefix(part(seq, s, F.lit(WINDOW)), part(seq, e, F.lit(WINDOW)))
    rest = lambda x: F.substr(seq, (x + 1).cast("int"))
    return let(near, lambda k: F.when(k < WINDOW, k).otherwise(common_prefix(rest(s), rest(e))))


def shift_insertion(seq: Column, s: Column, payload: Column) -> Column:
    """Places by which an insertion before s moves right: the common prefix of what follows and the payload repeated."""
    rest = F.substr(seq, (s + 1).cast("int"))
    near = common_prefix(part(seq, s, F.lit(WINDOW)), F.rpad(payload, WINDOW, payload))
    far = common_prefix(rest, F.rpad(payload, F.length(rest), payload))
    return F.when(F.length(payload) == 0, F.lit(0)).otherwise(let(near, lambda k: F.when(k < WINDOW, k).otherwise(far)))


def rotate(payload: Column, by: Column) -> Column:
    k = F.when(F.length(payload) > 0, by % F.length(payload)).otherwise(0)
    return F.concat(F.substr(payload, (k + 1).cast("int")), F.substring(payload, F.lit(1), k.cast("int")))


def inverted_core(seq: Column) -> Column:
    """How many outer pairs of a block that is inverted are their own complement, and so drop out."""
    n = F.floor(F.length(seq) / 2).cast("int")
    pairs = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    stays = F.filter(pairs, lambda i: F.substring(seq, i, F.lit(1)) != F.translate(F.substring(seq, F.length(seq) - i + 1, F.lit(1)), IUPAC, COMPLEMENT))
    return F.coalesce(F.try_element_at(stays, F.lit(1)) - 1, n)


def canonical(seq: Column, s: Column, e: Column, payload: Column) -> Column:
    """struct(edit, s, e, alt) of the replacement of [s, e) by payload, 0-based half-open, as it is described: identity,
    duplication of the whole, then trimmed: insertion (a duplication if its flank repeats it) and deletion shifted to the
    3' end, substitution, inversion without its self-complementary ends, delins."""
    whole_dup = lambda x: (e > s) & (x["b"] == F.concat(x["a"], x["a"]))
    text = lambda edit, a, b, alt: F.struct(F.lit(edit).alias("edit"), a.cast("int").alias("s"), b.cast("int").alias("e"), alt.alias("alt"))
    none = F.lit("")

    def decide(t: Column) -> Column:
        def inserted(k: Column) -> Column:
            at, rolled = t["s"] + k, rotate(t["alt"], k)
            n = F.length(rolled)
            before = F.when(at >= n, part(seq, at - n, n) == rolled).otherwise(False)
            return F.when(before, text("dup", at - n, at, none)).otherwise(text("ins", at, at, rolled))

        def deleted_(k: Column) -> Column:
            return text("del", t["s"] + k, t["e"] + k, none)

        def inverted(k: Column) -> Column:
            left = F.length(t["ref"]) - 2 * k
            one = part(t["alt"], k, F.lit(1))
            return (
                F.when(left == 0, text("identity", t["s"], t["e"], none)).when(left == 1, text("sub", t["s"] + k, t["s"] + k + 1, one))
                .otherwise(text("inv", t["s"] + k, t["e"] - k, none))
            )

        same = F.length(t["ref"]) == F.length(t["alt"])
        shifted = lambda k: text("dup", s + k, e + k, none)
        return (
            F.when(t["whole"] == t["given"], text("identity", s, e, none))
            .when(t["whole_dup"], let(shift_deletion(seq, s, e), shifted))
            .when(F.length(t["ref"]) == 0, let(shift_insertion(seq, t["s"], t["alt"]), inserted))
            .when(F.length(t["alt"]) == 0, let(shift_deletion(seq, t["s"], t["e"]), deleted_))
            .when(same & (F.length(t["ref"]) == 1), text("sub", t["s"], t["e"], t["alt"]))
            .when(same & (t["alt"] == reverse_complement(t["ref"])), let(inverted_core(t["ref"]), inverted))
            .otherwise(text("delins", t["s"], t["e"], t["alt"]))
        )

    return trimmed(part(seq, s, e - s), payload, lambda x, p, q: let(F.struct(
        x["a"].alias("whole"), x["b"].alias("given"), whole_dup(x).alias("whole_dup"), (s + p).cast("int").alias("s"), (e - q).cast("int").alias("e"),
        part(x["a"], p, F.length(x["a"]) - p - q).alias("ref"), part(x["b"], p, F.length(x["b"]) - p - q).alias("alt"),
    ), decide))


def described(accession: Column, seq: Column, c: Column, axis: str = "g") -> Column:
    """The description of canonical()'s struct, 1-based."""
    lo, hi = (c["s"] + 1).cast("string"), c["e"].cast("string")
    place = F.when(c["e"] > c["s"] + 1, F.concat(lo, F.lit("_"), hi)).otherwise(lo)
    body = (
        F.when(c["edit"] == "ins", F.concat(c["s"].cast("string"), F.lit("_"), lo, F.lit("ins"), c["alt"])).when(c["edit"] == "identity", F.concat(place, F.lit("=")))
        .when(c["edit"] == "sub", F.concat(lo, part(seq, c["s"], F.lit(1)), F.lit(">"), c["alt"])).otherwise(F.concat(place, c["edit"], c["alt"]))
    )
    return F.concat(accession, F.lit(f":{axis}."), body)


def stated_mismatch(stated: Column, held: Column) -> Column:
    """W5001 if bases are stated that the reference doesn't hold there; N matches any base."""
    odd = (F.length(stated) != F.length(held)) | F.exists(F.sequence(F.lit(1), F.greatest(F.length(stated), F.lit(1))), lambda i: ~F.substring(stated, i, F.lit(1)).isin("N", "n") & (F.upper(F.substring(stated, i, F.lit(1))) != F.upper(F.substring(held, i, F.lit(1)))))
    return F.when((stated != "") & (stated != held) & odd, "W5001")


def verdict(warning: Column, policy: Column) -> Column:
    """What a policy makes of a warning: strict refuses it, lenient accepts with it, silent accepts."""
    return F.when(warning.isNotNull() & (policy == "strict"), "refused").otherwise("accepted")


def applied(seq: Column, s: Column, e: Column, payload: Column) -> Column:
    """The sequence with [s, e) replaced."""
    return F.concat(part(seq, F.lit(0), s), payload, F.substr(seq, (e + 1).cast("int")))


# ---- SPDI


def spdi(sequence: Column, position: Column, deletion: Column, insertion: Column) -> Column:
    return F.concat_ws(":", sequence, position.cast("string"), deletion, insertion)


def parse_spdi(text: Column) -> Column:
    """struct(sequence, position, deletion, insertion); null if it is none. A deletion may be a number of bases."""
    p = r"^([^:]+):(\d{1,18}):([ACGTUNacgtun]*|\d{1,9}):([ACGTUNacgtun]*)$"
    take = lambda i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(p), F.struct(take(1).alias("sequence"), take(2).try_cast("long").alias("position"), F.upper(take(3)).alias("deletion"), F.upper(take(4)).alias("insertion")))


def canonical_spdi(accession: Column, seq: Column, s: Column, e: Column, payload: Column) -> Column:
    """A key that all spellings of one change on one sequence share: trimmed, then moved to the 3' end."""
    def decide(t: Column) -> Column:
        gone = lambda k: spdi(accession, t["s"] + k, rotate(t["ref"], k), F.lit(""))
        new = lambda k: spdi(accession, t["s"] + k, F.lit(""), rotate(t["alt"], k))
        return (
            F.when((F.length(t["ref"]) == 0) & (F.length(t["alt"]) == 0), spdi(accession, s, t["whole"], t["whole"]))
            .when(F.length(t["alt"]) == 0, let(shift_deletion(seq, t["s"], t["e"]), gone)).when(F.length(t["ref"]) == 0, let(shift_insertion(seq, t["s"], t["alt"]), new))
            .otherwise(spdi(accession, t["s"], t["ref"], t["alt"]))
        )

    return trimmed(part(seq, s, e - s), payload, lambda x, p, q: let(F.struct(
        x["a"].alias("whole"), (s + p).alias("s"), (e - q).alias("e"), part(x["a"], p, F.length(x["a"]) - p - q).alias("ref"), part(x["b"], p, F.length(x["b"]) - p - q).alias("alt"),
    ), decide))


def spdi_type(deletion: Column, insertion: Column) -> Column:
    d, i = F.length(deletion), F.length(insertion)
    return (
        F.when(deletion == insertion, "identity").when((d == 1) & (i == 1), "substitution").when(i == 0, "deletion").when(d == 0, "insertion").otherwise("delins")
    )


def from_spdi(v: Column, axis: str | None = None) -> Column:
    """The description of parse_spdi()'s struct, from its own bases; null for an empty change and an insertion at 0. axis: g or
    m where it is known; by default m for the human mitochondrion's record, g for others."""
    d, i = v["deletion"], v["insertion"]
    lo, hi = (v["position"] + 1).cast("string"), (v["position"] + F.length(d)).cast("string")
    place = F.when(F.length(d) > 1, F.concat(lo, F.lit("_"), hi)).otherwise(lo)
    kind = spdi_type(d, i)
    inverted = (F.length(d) == F.length(i)) & (F.length(d) >= 2) & (i == reverse_complement(d))
    body = (
        F.when((kind == "identity") & (d != ""), F.concat(place, F.lit("="))).when(kind == "substitution", F.concat(lo, d, F.lit(">"), i))
        .when(kind == "deletion", F.concat(place, F.lit("del")))
        .when((kind == "insertion") & (v["position"] > 0), F.concat(v["position"].cast("string"), F.lit("_"), lo, F.lit("ins"), i))
        .when((kind == "delins") & inverted, F.concat(place, F.lit("inv"))).when(kind == "delins", F.concat(place, F.lit("delins"), i))
    )
    by_name = F.when(v["sequence"].startswith(MITOCHONDRION), ":m.").otherwise(":g.")
    return F.concat(v["sequence"], F.lit(f":{axis}.") if axis else by_name, body)


# ---- repeats


def tract(seq: Column, at: Column, unit: Column) -> Column:
    """struct(start, end): the longest run of whole copies of the unit that holds the copy at 0-based at, half-open; empty if
    no copy starts there."""
    after = F.call_function("regexp_extract", F.substr(seq, (at + 1).cast("int")), F.concat(F.lit("^(?:"), unit, F.lit(")*")), F.lit(0))
    before = F.call_function("regexp_extract", part(seq, F.lit(0), at), F.concat(F.lit("(?:"), unit, F.lit(")*$")), F.lit(0))
    held = F.length(after) > 0
    return F.struct((at - F.when(held, F.length(before)).otherwise(0)).cast("int").alias("start"), (at + F.length(after)).cast("int").alias("end"))


def repeat_edit(seq: Column, at: Column, unit: Column, copies: Column, coding: Column) -> Column:
    """struct(edit, s, e, alt, copies) of a stated number of copies of a unit at a tract: 0-based half-open.

    The tract is moved to its last phase first, so that the unit may be rotated. As many copies as the reference has are no
    change; one more is a duplication of the last unit; fewer delete the last units, and more insert after the tract, if
    that is on a coding axis and the unit is no whole codon, or if one copy differs or none is left; else the copies are stated.
    """
    n = F.length(unit)

    def aligned(x: Column) -> Column:
        # bases after the tract that go on with the unit move its phase
        more = shift_insertion(seq, x["end"], unit)
        return F.struct((x["start"] + more).cast("int").alias("start"), (x["end"] + more).cast("int").alias("end"), rotate(unit, more).alias("unit"))

    def decide(x: Column) -> Column:
        has = F.floor((x["end"] - x["start"]) / n).cast("int")
        gate = coding & (n % 3 != 0)
        out = lambda edit, a, b, alt, k: F.struct(F.lit(edit).alias("edit"), a.cast("int").alias("s"), b.cast("int").alias("e"), alt.alias("alt"), k.cast("int").alias("copies"))
        none, null = F.lit(""), F.lit(None)
        stated = out("repeat", x["start"], x["end"], x["unit"], copies)
        return (
            F.when(has == 0, out("unchanged", x["start"], x["end"], none, copies)).when(copies == has, out("unchanged", x["start"], x["end"], x["unit"], copies))
            .when(copies == has + 1, out("dup", x["end"] - n, x["end"], none, null))
            .when(copies < has, F.when((has - copies >= 2) & (copies >= 1) & ~gate, stated).otherwise(out("del", x["end"] - (has - copies) * n, x["end"], none, null)))
            .when(gate, out("ins", x["end"], x["end"], F.repeat(x["unit"], (copies - has).cast("int")), null)).otherwise(stated)
        )

    return let(let(tract(seq, at, unit), aligned), decide)


def insertion_to_repeat(seq: Column, s: Column, payload: Column, coding: Column) -> Column:
    """struct(edit, s, e, alt, copies) of an insertion before 0-based s: at its last place, and if it is two copies or more of
    a unit that the bases before it repeat, the new number of copies there; on a coding axis only for whole codons."""

    def shifted(k: Column) -> Column:
        return F.struct((s + k).cast("int").alias("at"), rotate(payload, k).alias("alt"))

    def united(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["alt"].alias("alt"), smallest_unit(x["alt"]).alias("unit"))

    def counted(x: Column) -> Column:
        run = F.call_function("regexp_extract", part(seq, F.lit(0), x["at"]), F.concat(F.lit("(?:"), x["unit"], F.lit(")*$")), F.lit(0))
        return F.struct(x["at"].alias("at"), x["alt"].alias("alt"), x["unit"].alias("unit"), F.length(run).alias("held"))

    def decide(x: Column) -> Column:
        n, added = F.length(x["unit"]), F.length(x["alt"])
        fits = (added >= 2 * n) & (x["held"] > 0) & ~(coding & (n % 3 != 0))
        out = lambda edit, a, alt, k: F.struct(F.lit(edit).alias("edit"), a.cast("int").alias("s"), x["at"].cast("int").alias("e"), alt.alias("alt"), k.cast("int").alias("copies"))
        return F.when(fits, out("repeat", x["at"] - x["held"], x["unit"], (x["held"] + added) / n)).otherwise(out("ins", x["at"], x["alt"], F.lit(None)))

    return let(let(let(let(shift_insertion(seq, s, payload), shifted), united), counted), decide)


# ---- SPDI from 1-based places


def spdi_substitution(accession: Column, at: Column, ref: Column, alt: Column) -> Column:
    return spdi(accession, at - 1, ref, alt)


def spdi_deletion(accession: Column, lo: Column, bases: Column) -> Column:
    return spdi(accession, lo - 1, bases, F.lit(""))


def spdi_insertion(accession: Column, after: Column, bases: Column) -> Column:
    """Bases inserted after the 1-based place."""
    return spdi(accession, after, F.lit(""), bases)


def spdi_delins(accession: Column, lo: Column, ref: Column, alt: Column) -> Column:
    return spdi(accession, lo - 1, ref, alt)
