"""Descriptions as columns: accessions, the common forms parsed and written without leaving the JVM, categories, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- accessions


def accession_parts(acc: Column) -> Column:
    """struct(prefix, number, version); numbers keep their leading zeros. All null if it is no standard accession."""
    p = r"^([A-Z]{2})_(\d+)(?:\.(\d+))?$"
    e = r"^(ENS[A-Z]{0,5}[GTPER])(\d+)(?:\.(\d+))?$"
    g = r"^(LRG)_(\d+)([tp]\d+)?$"
    take = lambda r, i: F.nullif(F.regexp_extract(acc, r, i), F.lit(""))
    version = F.coalesce(take(p, 3), take(e, 3)).cast("int")
    return F.struct(
        F.coalesce(take(p, 1), take(e, 1), take(g, 1)).alias("prefix"), F.coalesce(take(p, 2), take(e, 2), take(g, 2)).alias("number"), version.alias("version")
    )


def base_accession(acc: Column) -> Column:
    return F.regexp_replace(acc, r"\.\d+$", "")


def accession_class(acc: Column) -> Column:
    """refseq, ensembl, lrg, uniprot, assembly or other."""
    return (
        F.when(acc.rlike(r"^(GRCh\d+|hg\d+)\("), "assembly")
        .when(acc.rlike(r"^ENS[A-Z]{0,5}[GTPER]\d+(\.\d+)?$"), "ensembl")
        .when(acc.rlike(r"^LRG_\d+([tp]\d+)?$"), "lrg")
        .when(acc.rlike(r"^[A-Z]{2}_\d+(\.\d+)?$"), "refseq")
        .when(acc.rlike(r"^[A-Z][A-Z0-9]{5}$"), "uniprot")
        .otherwise("other")
    )


def inferred_axis(acc: Column) -> Column:
    """The axis that an accession implies; null if it implies none."""
    return (
        F.when(acc.rlike("^(NC|NG|NT|NW)_"), "g")
        .when(acc.rlike("^NM_"), "c").when(acc.rlike("^NR_"), "n").when(acc.rlike("^NP_"), "p")
        .when(acc.rlike(r"^LRG_\d+t\d+$"), "c").when(acc.rlike(r"^LRG_\d+p\d+$"), "p").when(acc.rlike(r"^LRG_\d+$"), "g")
        .when(acc.rlike(r"^ENS[A-Z]{0,5}T\d"), "c").when(acc.rlike(r"^ENS[A-Z]{0,5}G\d"), "g").when(acc.rlike(r"^ENS[A-Z]{0,5}P\d"), "p")
        .when(acc.rlike(r"^[A-Z][A-Z0-9]{5}$"), "p")
    )


def is_transcript(acc: Column) -> Column:
    return acc.rlike(r"^((NM|NR|XM|XR)_|ENS[A-Z]{0,5}T\d|LRG_\d+t)")


def is_noncoding(acc: Column) -> Column:
    return acc.rlike("^(NR|XR)_")


# ---- the common forms

#: Substitution, deletion, duplication, insertion, delins, inversion and identity at plain positions; missense.
_NA = r"^([A-Za-z]+_?\d+(?:[tp]\d+)?(?:\.\d+)?):([gcnmo])\.([1-9]\d{0,17})(?:_([1-9]\d{0,17}))?(?:([ACGT])>([ACGT])|(del|dup|inv|=)|(delins|ins)([ACGT]+))$"
_PROTEIN = r"^([A-Za-z]+_?\d+(?:p\d+)?(?:\.\d+)?):p\.\(?([A-Z][a-z]{2})([1-9]\d{0,17})([A-Z][a-z]{2})\)?$"


def parse(description: Column) -> Column:
    """struct(accession, axis, s, e, edit, ref, alt) of a common form; edit is null for all others.

    The two patterns cover what most descriptions look like; the full grammar is for the rest only. Each is matched once a
    row: its groups are read from one replaced text.
    """
    groups = lambda p, n: F.split(F.regexp_replace(description, p, "\t".join(f"${i}" for i in range(1, n + 1))), "\t")
    kind = lambda f: F.struct(*[x.alias(n) for x, n in zip(f, ("accession", "axis", "s", "e", "edit", "ref", "alt"), strict=True)])
    none = kind([F.lit(None).cast(t) for t in ("string", "string", "long", "long", "string", "string", "string")])

    def nucleic(g: Column) -> Column:
        at = lambda i: F.element_at(g, i)
        s, e = at(3).try_cast("long"), at(4).try_cast("long")
        sub = at(5) != ""
        edit = F.when(sub, "sub").when(at(7) == "=", "identity").otherwise(F.concat(at(7), at(8)))
        fine = F.when(sub, e.isNull()).otherwise(e.isNull() | (e >= s))
        return F.when(fine, kind([at(1), at(2), s, F.coalesce(e, s), edit, at(5), F.concat(at(6), at(9))])).otherwise(none)

    def protein(g: Column) -> Column:
        at = lambda i: F.element_at(g, i)
        n = at(3).try_cast("long")
        return kind([at(1), F.lit("p"), n, n, F.lit("missense"), at(2), at(4)])

    def read(x: Column) -> Column:
        return F.when(F.size(x["n"]) == 9, nucleic(x["n"])).when(F.size(x["p"]) == 4, protein(x["p"])).otherwise(none)

    return F.element_at(F.transform(F.array(F.struct(groups(_NA, 9).alias("n"), groups(_PROTEIN, 4).alias("p"))), read), 1)


def write(accession: Column, axis: Column, s: Column, e: Column, edit: Column, ref: Column, alt: Column) -> Column:
    """The description of parse()'s fields; null if a field is."""
    place = F.concat(s.cast("string"), F.when(e > s, F.concat(F.lit("_"), e.cast("string"))).otherwise(""))
    lead = F.concat(accession, F.lit(":"), axis, F.lit("."))
    return (
        F.when(edit == "missense", F.concat(lead, ref, s.cast("string"), alt)).when(edit == "sub", F.concat(lead, place, ref, F.lit(">"), alt))
        .when(edit == "identity", F.concat(lead, place, F.lit("="))).otherwise(F.concat(lead, place, edit, alt))
    )


def as_rna(description: Column) -> Column:
    """The r. spelling of a c. or n. description: lower case, U for T."""
    body = F.regexp_extract(description, r":[cn]\.(.*)$", 1)
    bases = F.translate(body, "ACGTN", "acgun")
    return F.when(description.rlike(r":[cn]\."), F.concat(F.regexp_extract(description, r"^([^:]*):", 1), F.lit(":r."), bases))


AMINO = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K",
    "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*", "Sec": "U", "Pyl": "O", "Xaa": "X",
}


def one_letter(three: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in AMINO.items() for x in kv])
    return F.try_element_at(names, three)


def three_letters(one: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in AMINO.items() for x in (v, k)])
    return F.try_element_at(names, one)


def protein_one_letter(accession: Column, s: Column, ref: Column, alt: Column) -> Column:
    return F.concat(accession, F.lit(":p."), one_letter(ref), s.cast("string"), one_letter(alt))


def spellings(accession: Column, s: Column, ref: Column, alt: Column) -> Column:
    """Accepted renderings of a missense change: with and without predicted parentheses, three letters and one."""
    three = F.concat(ref, s.cast("string"), alt)
    one = F.concat(one_letter(ref), s.cast("string"), one_letter(alt))
    lead = F.concat(accession, F.lit(":p."))
    return F.array(F.concat(lead, three), F.concat(lead, F.lit("("), three, F.lit(")")), F.concat(lead, one), F.concat(lead, F.lit("("), one, F.lit(")")))


def caret(message: Column, position: Column) -> Column:
    """A line that marks the position (0-based) below the message."""
    return F.concat(message, F.lit("\n"), F.repeat(F.lit(" "), position.cast("int")), F.lit("^"))


# ---- predicates over the fields


def span(s: Column, e: Column) -> Column:
    return e - s + 1


def indel_length(edit: Column, s: Column, e: Column, alt: Column) -> Column:
    """Net change in length; null if unknown."""
    n = F.length(alt).cast("long")
    return (
        F.when(edit.isin("sub", "inv", "identity"), F.lit(0).cast("long")).when(edit == "del", -span(s, e)).when(edit == "dup", span(s, e))
        .when(edit == "ins", n).when(edit == "delins", n - span(s, e))
    )


def is_frameshift(edit: Column, s: Column, e: Column, alt: Column) -> Column:
    n = indel_length(edit, s, e, alt)
    return F.coalesce((n != 0) & (F.abs(n) % 3 != 0), F.lit(False))


def refusal(axis: Column, accession: Column, edit: Column, s: Column, e: Column, alt: Column) -> Column:
    """Why the parsed fields are no valid description; null if they are. In order: axis against accession, an insertion
    whose flanks aren't neighbours, an inversion of one base, uracil in DNA."""
    implied = inferred_axis(accession)
    fits = implied.isNull() | (implied == axis) | (axis == "m") | ((implied == "c") & (axis == "n"))
    return (
        F.when(~fits, "axis_mismatch").when((edit == "ins") & (e != s + 1), "insertion_flanks")
        .when((edit == "inv") & (s == e), "single_base_inversion").when(axis.isin("g", "c", "n") & alt.rlike("[Uu]"), "uracil_in_dna")
    )


# ---- categories


def category(text: Column) -> Column:
    """One of 21 classes by text tests in a fixed order."""
    has = lambda s: text.contains(s)
    snv = text.endswith(">") | (F.length(text) - F.length(F.replace(text, F.lit(">"), F.lit(""))) == 1)
    genomic = (
        F.when(snv, "genomic_snv").when(has("del") & has("ins"), "genomic_delins").when(has("del"), "genomic_del").when(has("ins"), "genomic_ins")
        .when(has("dup"), "genomic_dup").when(has("inv"), "genomic_inv").otherwise("other")
    )
    after = F.split_part(text, F.lit(":c."), F.lit(2))
    coding = (
        F.when(after.rlike("[+-]"), "coding_intronic").when(snv, "coding_snv").when(has("del"), "coding_del").when(has("ins"), "coding_ins")
        .when(has("dup"), "coding_dup").otherwise("other")
    )
    return (
        F.when(has(":g."), genomic).when(has(":c."), coding)
        .when(has(":p."), F.when(has("fs"), "protein_fs").when(has("ext"), "protein_ext").otherwise("protein_sub"))
        .when(has(":n."), "noncoding").when(has(":m."), "mitochondrial").when(has(":r."), "rna").when(has(":o."), "circular")
        .when(has("[") & has("]"), "repeat").when(has("?"), "uncertain").otherwise("other")
    )


# ---- repairs: each a code, a test and a replacement, in the order in which they apply

DASHES, QUOTES_SINGLE, QUOTES_DOUBLE = "‐‑‒–—―−", "‘’‚‛", "“”„‟"
_AMINO_ANY = "|".join(k for k in AMINO)


def _aa_case(text: Column) -> Column:
    """Three-letter amino acids of a p. description in their usual case."""
    for name in AMINO:
        text = F.regexp_replace(text, f"(?<![A-Za-z])(?i:{name})(?=[0-9*(=]|\\d|$|_|\\))|(?<=\\d)(?i:{name})(?![a-z])", name)
    return text


#: code, what it repairs, pattern that shows the need, function of the text
REPAIRS = (
    ("W2001", "dash", f"[{DASHES}]", lambda t: F.translate(t, DASHES, "-" * len(DASHES))),
    ("W2002", "quote", f"[{QUOTES_SINGLE}{QUOTES_DOUBLE}]", lambda t: F.translate(t, QUOTES_SINGLE + QUOTES_DOUBLE, "'" * len(QUOTES_SINGLE) + '"' * len(QUOTES_DOUBLE))),
    ("W2003", "white space", r"\s", lambda t: F.regexp_replace(t, r"\s+", "")),
    ("W1003", "accession case", r"^(?!(?-i:[A-Z]{2}_))[A-Za-z]{2}_\d", lambda t: F.concat(F.upper(F.substring(t, 1, 2)), F.substr(t, F.lit(3)))),
    ("W3002", "protein arrow", r":p\..*\d[A-Za-z]{3}>[A-Za-z]{3}|:p\.\(?[A-Z][a-z]{2}\d+>[A-Z]", lambda t: F.regexp_replace(t, ">", "")),
    ("W1001", "amino acid case", r":p\.\(?(?:[a-z]{3}\d|[A-Z]{3}\d)", lambda t: F.concat(F.regexp_extract(t, r"^([^:]*:p\.)", 1), _aa_case(F.regexp_extract(t, r":p\.(.*)$", 1)))),
    ("W1004", "edit case", r"(?<=[\d)])(?!(?-i:delins|del|ins|dup|inv|con))(?i:delins|del|ins|dup|inv|con)", lambda t: F.concat(F.regexp_extract(t, r"^(.*?[\d)])(?i:delins|del|ins|dup|inv|con)", 1), F.lower(F.regexp_extract(t, r"(?<=[\d)])((?i:delins|del|ins|dup|inv|con))", 1)), F.regexp_extract(t, r"(?<=[\d)])(?i:delins|del|ins|dup|inv|con)(.*)$", 1))),
    ("W3005", "trailing annotation", r"(?<=[A-Za-z=\]])\(p\..*\)$", lambda t: F.regexp_replace(t, r"\(p\..*\)$", "")),
    ("W4003", "one-position range", r"\.(\d+)_\1(?!\d)", lambda t: F.regexp_replace(t, r"\.(\d+)_\1(?!\d)", r".$1")),
    ("W3012", "empty delins", r"delins$", lambda t: F.regexp_replace(t, r"delins$", "del")),
    ("W3011", "size after a deletion", r"del\d+$", lambda t: F.regexp_replace(t, r"del\d+$", "del")),
    ("W3023", "size after a duplication", r"dup\d+$", lambda t: F.regexp_replace(t, r"dup\d+$", "dup")),
    ("W3024", "bases after a duplication", r"dup[ACGT]+$", lambda t: F.regexp_replace(t, r"dup[ACGT]+$", "dup")),
    ("W3025", "bases after a deletion", r"del[ACGT]+$", lambda t: F.regexp_replace(t, r"del[ACGT]+$", "del")),
    ("W3003", "several bases substituted", r"\.\d+_\d+[ACGT]{2,}>[ACGT]+$", lambda t: F.regexp_replace(t, r"(\.\d+_\d+)[ACGT]{2,}>([ACGT]+)$", r"$1delins$2")),
    ("W3015", "con for delins", r"\dcon[A-Za-z0-9]", lambda t: F.regexp_replace(t, r"(\d)con(?=[A-Za-z0-9])", r"$1delins")),
    ("W3020", "thymine in RNA", r":r\..*[tT]", lambda t: F.concat(F.regexp_extract(t, r"^([^:]*:r\.)", 1), F.translate(F.regexp_extract(t, r":r\.(.*)$", 1), "tT", "uU"))),
)


def repair(df: DataFrame, column: str, codes: tuple[str, ...] | None = None) -> DataFrame:
    """df with the column repaired and codes, the repairs that applied, in order. codes: only these are tried."""
    df = df.withColumn("codes", F.array().cast("array<string>"))
    for code, _, needs, fix in REPAIRS:
        if codes is None or code in codes:
            text = F.col(column)
            need = text.rlike(needs)
            df = df.withColumns({column: F.when(need, fix(text)).otherwise(text), "codes": F.when(need, F.array_append("codes", F.lit(code))).otherwise(F.col("codes"))})
    return df


def swapped(text: Column) -> Column:
    """W4001: a range of plain positions put in ascending order."""
    p = r"^(.*\.)(\d+)_(\d+)(\D.*)$"
    a, b = F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3)
    back = text.rlike(p) & (a.try_cast("long") > b.try_cast("long"))
    return F.when(F.coalesce(back, F.lit(False)), F.concat(F.regexp_extract(text, p, 1), b, F.lit("_"), a, F.regexp_extract(text, p, 4))).otherwise(text)


def missing_version(text: Column) -> Column:
    """W3001."""
    return text.rlike(r"^[A-Z]{2}_\d+:")


def position_zero(text: Column) -> Column:
    """A position 0, which is always an error."""
    return F.regexp_extract(text, r":(.*)$", 1).rlike(r"(?:^[a-z]\.\(?|_|\()[*-]?0+(?=\D)")


def complete(text: Column, accessions: dict[str, str]) -> Column:
    """A short form such as c.4A>G with the accession that the context gives its axis."""
    axis = F.regexp_extract(text, r"^([gcnmrp])\.", 1)
    given = F.create_map(*[F.lit(x) for kv in accessions.items() for x in kv])
    return F.when(axis != "", F.concat(F.try_element_at(given, axis), F.lit(":"), text)).otherwise(text)


def intron_spelling(text: Column) -> tuple[Column, Column]:
    """(intron number, signed offset) of c.IVS3+5G>A."""
    return F.nullif(F.regexp_extract(text, r"IVS(\d+)[+-]", 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract(text, r"IVS\d+([+-]\d+)", 1), F.lit("")).cast("long")


def nearest(word: Column, known: list[str], most: int = 2) -> Column:
    """The known spelling of least edit distance, the first of equals; null if all are further than most."""
    each = F.array(*[F.struct(F.levenshtein(word, F.lit(k)).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(known)])
    best = F.array_min(each)
    return F.when(best["d"] <= most, best["k"])


def rs_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(?i:rs)?([0-9]{1,18})$", 1), F.lit("")).cast("long")


def rs_id(number: Column) -> Column:
    return F.concat(F.lit("rs"), number.cast("string"))


def accession_whole(acc: Column) -> Column:
    """struct(kind, assembly, chromosome, context, inner): GRCh38(chr1) by assembly and chromosome, NC_000001.11(NM_000088.3) by
    its genomic context and what lies in it, all others by themselves."""
    of = lambda p, i: F.nullif(F.regexp_extract(acc, p, i), F.lit(""))
    build, nested = r"^(GRCh\d+|hg\d+)\(([A-Za-z0-9_.]+)\)$", r"^([A-Z]{2}_\d+(?:\.\d+)?|LRG_\d+)\(([A-Z]{2}_\d+(?:\.\d+)?|LRG_\d+[tp]\d+)\)$"
    kind = F.when(acc.rlike(build), "assembly").when(acc.rlike(nested), "nested").otherwise(accession_class(acc))
    return F.struct(kind.alias("kind"), of(build, 1).alias("assembly"), of(build, 2).alias("chromosome"), of(nested, 1).alias("context"), F.coalesce(of(nested, 2), F.when(~acc.rlike(build), acc)).alias("inner"))


def is_mitochondrial(acc: Column) -> Column:
    return acc.rlike(r"^NC_012920(\.\d+)?$")


#: Words of clinical significance by what they say. Fixed values.
PATHOGENIC, BENIGN = ("Pathogenic", "Likely pathogenic", "Pathogenic/Likely pathogenic"), ("Benign", "Likely benign", "Benign/Likely benign")


def significance_side(text: Column) -> Column:
    """pathogenic, benign, uncertain or other."""
    return F.when(text.isin(*PATHOGENIC), "pathogenic").when(text.isin(*BENIGN), "benign").when(text == "Uncertain significance", "uncertain").otherwise("other")
