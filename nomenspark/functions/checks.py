"""What is wrong or doubtful about a description, as columns: codes with their severity, detections, refusals, predicates, and
parsing in strict, lenient and silent mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .descriptions import REPAIRS, position_zero, repair, swapped, three_letters

#: Codes and what they say. The codes are part of the results.
CODES = (
    ("W1001", "amino acid in lower or upper case"), ("W1002", "amino acid of one letter"), ("W1003", "accession prefix in lower case"), ("W1004", "edit type in another case"),
    ("W2001", "another dash"), ("W2002", "another quote"), ("W2003", "white space"), ("W2004", "character outside the alphabet"),
    ("W3001", "no version"), ("W3002", "arrow in a protein substitution"), ("W3003", "several bases substituted"), ("W3004", "coordinate type inside the brackets"),
    ("W3005", "trailing annotation"), ("W3006", "no coordinate type"), ("W3007", "star for a stop"), ("W3008", "X for a stop"), ("W3009", "star for the stop of a frameshift"),
    ("W3010", "X for the stop of a frameshift"), ("W3011", "size after a deletion"), ("W3012", "empty delins"), ("W3013", "unit of a repeat stated twice"), ("W3014", "IVS for an intron"),
    ("W3015", "con for a conversion"), ("W3016", "stated bases of another length than the range"), ("W3020", "thymine in RNA"), ("W3021", "bracketed amino acids inserted"),
    ("W3023", "size after a duplication"), ("W3024", "bases after a duplication"), ("W3025", "bases after a deletion"), ("W3026", "brackets around one member"),
    ("W3027", "insertion without bases"), ("W3028", "symbol of alignments"), ("W3029", "size for inserted bases"), ("W4001", "positions swapped"), ("W4003", "range of one position"),
    ("W4007", "intron offset without a genomic record"), ("W4008", "position outside a non-coding transcript"), ("W4009", "offset on a genomic position"),
    ("W5001", "bases differ from the reference"), ("W5002", "members conflict"), ("W5005", "members made one"), ("E1003", "no such position"),
)
#: Codes of the normalizer as the registry has them. Fixed values.
NORMALIZER = (("REFSEQ_MISMATCH", "W5001"), ("OVERLAP_CONFLICTING_EDITS", "W5002"), ("MEMBERS_COALESCED_FROM_REPORTED_FORM", "W5005"), ("UNRESOLVABLE_SPECIAL_POSITION", "W4005"), ("TRANSCRIPT_FLANK_NOT_DESCRIBABLE", "W4006"))


def registry(spark: SparkSession) -> DataFrame:
    """code, meaning and whether a repair exists."""
    fixed = {r[0] for r in REPAIRS} | {"W4001"}
    return spark.createDataFrame([(c, m, c in fixed) for c, m in CODES], "code string, meaning string, repaired boolean")


def explained(rows: DataFrame, code: str) -> DataFrame:
    """rows with meaning and repaired of a code, by its registry name or the normalizer's; null for unknown ones."""
    names = F.create_map(*[F.lit(x) for kv in NORMALIZER for x in kv])
    key = F.coalesce(F.try_element_at(names, F.upper(F.trim(code))), F.upper(F.trim(code)))
    return rows.withColumn("_key", key).join(registry(rows.sparkSession).withColumnRenamed("code", "_code"), F.col("_key") == F.col("_code"), "left").drop("_key", "_code")


# ---- detections: what has no repair


def body(text: Column) -> Column:
    """What follows the last coordinate type."""
    return F.regexp_extract(text, r":([gcnrpmo]\..*)$", 1)


def length_mismatch(text: Column) -> Column:
    """W3016: del, dup or inv of a plain range that states bases of another number."""
    p = r"[gcnrmo]\.(\d{1,18})_(\d{1,18})(?:del|dup|inv)([A-Za-z]+)$"
    take = lambda i: F.regexp_extract(text, p, i)
    return F.coalesce(text.rlike(p) & ~text.contains("ins") & (take(2).try_cast("long") - take(1).try_cast("long") + 1 != F.length(take(3))), F.lit(False))


#: code and the pattern of the body that shows it
DETECTED = (
    ("W3021", r"^p\..*ins\["), ("W3027", r"(?<=[\d)?])ins(?=[;\]),/]|$)"), ("W3026", r"^[gcnmro]\.\[[^;\[\]]+\]$"), ("W3028", r"(?<=del|ins|dup|>)[A-Za-z]*-"),
    ("W3029", r"^[gcnmro]\..*ins\(?\d+\)?$"), ("W4008", r"^n\.\[?\(?-\d"), ("W4009", r"^[gmo]\.\[?\(?\d+[+-]\d"), ("W3014", r"IVS\d"),
)


def detections(text: Column) -> Column:
    """Codes of what is found and has no repair, in order."""
    own = body(text)
    found = [F.when(own.rlike(p), F.lit(c)) for c, p in DETECTED] + [F.when(length_mismatch(text), F.lit("W3016"))]
    bare = own.rlike(r"^[cn]\.\[?\(?[*-]?\d+[+-]\d") & ~text.contains("(") & text.rlike(r"^(?:NM|NR|XM|XR)_")
    return F.array_compact(F.array(*found, F.when(bare, F.lit("W4007"))))


# ---- refusals of parsed members


def member_refusal(text: Column) -> Column:
    """Why a description is refused in every mode; null if it isn't: a position after the end of a non-coding transcript, a
    point with a size, an allele that deletes and duplicates the same bases, a ring whose segments make none."""
    own = body(text)
    segments = F.split(F.regexp_replace(own, r"^[gcnrpmo]\.", ""), "::")
    first = F.transform(segments, lambda x: F.regexp_extract(x, r"^(\d{1,18})", 1).try_cast("long"))
    joins = F.size(segments) > 1
    no_junction = F.exists(segments, lambda x: x.rlike(r"(?:dup|inv|=|>[ACGT])$"))
    steps = F.exists(F.sequence(F.lit(1), F.greatest(F.size(first) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(first, i) > F.try_element_at(first, i + 1), F.lit(False)))
    return (
        F.when(own.rlike(r"^n\.\[?\(?\*\d") | own.rlike(r"^n\..*_\*\d"), "noncoding_downstream").when(own.rlike(r"^[gcnmro]\.[*-]?\d+(?:del|dup)\d+$"), "point_size")
        .when(cancels(own), "self_cancelling").when(joins & no_junction, "ring_without_junction").when(joins & steps, "ring_order")
    )


def cancels(own: Column) -> Column:
    """Whether a cis allele both deletes and duplicates one place's bases."""
    inner = F.regexp_extract(own, r"^[gcnmro]\.\[([^\[\]]*)\]$", 1)
    members = F.filter(F.split(inner, ";"), lambda x: x.rlike(r"^[\d_*+-]+(?:del|dup)$"))
    place = lambda kind: F.transform(F.filter(members, lambda x: x.endswith(kind)), lambda x: F.regexp_replace(x, "(?:del|dup)$", ""))
    return F.arrays_overlap(place("del"), place("dup"))


def order_problems(s: Column, e: Column, edit: Column, ref: Column, alt: Column) -> Column:
    """The rules of a single edit that are broken: position order, flanks of an insertion, a substitution of a base by itself
    or over a range, an inversion of one base, an empty payload, characters that are no bases."""
    bases = r"^[ACGTUNRYKMSWBDHVacgtunrykmswbdhv]*$"
    rules = (
        ("position_order", s > e), ("insertion_flanks", (edit == "ins") & (e != s + 1)), ("same_base", (edit == "sub") & (ref == alt)), ("substitution_range", (edit == "sub") & (s != e)),
        ("inversion_of_one", (edit == "inv") & (s == e)), ("empty_payload", edit.isin("ins", "delins") & (alt == "")), ("no_bases", (edit != "missense") & ~(ref.rlike(bases) & alt.rlike(bases))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in rules]))


# ---- predicates


def kind_of(text: Column) -> Column:
    """struct(kind, axis, gene, accession) of a description; kind names what it is on its axis, or allele, null_allele,
    unknown_allele, ring, fusion. The axis of an allele is that of its members, if they agree."""
    own = body(text)
    axes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[:;\[])(?:[^:;\[\]]*:)?([gcnrpmo])\."), F.lit(1)))
    axis = F.when(F.size(axes) == 1, F.element_at(axes, 1))
    names = F.create_map(*[F.lit(x) for x in ("g", "genome", "c", "coding", "n", "noncoding", "r", "rna", "p", "protein", "m", "mitochondrial", "o", "circular")])
    kind = (
        F.when(F.trim(text) == "[0]", "null_allele").when(F.trim(text) == "[?]", "unknown_allele").when(own.contains("::"), F.when(own.startswith("r."), "fusion").otherwise("ring"))
        .when(text.startswith("[") | own.rlike(r"^[gcnrpmo]\.\[.*[;\]]") & ~own.rlike(r"\d[ACGTacgu]*\[\d+\]$") | own.contains("(;)"), "allele").otherwise(F.try_element_at(names, axis))
    )
    gene = F.nullif(F.regexp_extract(text, r"^[^:(]+\(([A-Za-z0-9_.-]+)\):", 1), F.lit(""))
    accession = F.nullif(F.regexp_extract(text, r"^\[?([A-Za-z]+_?[0-9]+(?:[tp][0-9]+)?(?:\.[0-9]+)?)", 1), F.lit(""))
    return F.struct(kind.alias("kind"), axis.alias("axis"), gene.alias("gene"), accession.alias("accession"))


def deep_intronic(offset: Column, more_than: int = 50) -> Column:
    """Null for an unknown offset."""
    return F.abs(offset) > more_than


def canonical_splice_site(offset: Column) -> Column:
    return F.abs(offset).isin(1, 2)


#: Features of the nomenclature and the first version that has them.
FEATURES = (("adjoined_transcripts", 21, 0), ("alleles", 15, 11), ("delins_of_con", 21, 0), ("extension", 15, 11), ("frameshift_ter", 15, 11), ("mosaic", 15, 11), ("repeat_brackets", 15, 11), ("rna_fusion", 19, 1), ("supernumerary", 20, 5))


def supported(feature: Column, version: Column) -> Column:
    """Whether a version (21.0) of the nomenclature has a feature; null for an unknown feature or version."""
    since = F.create_map(*[x for n, a, b in FEATURES for x in (F.lit(n), F.lit(1000 * a + b))])
    at = F.split(version, r"\.")
    own = 1000 * F.try_element_at(at, F.lit(1)).try_cast("int") + F.coalesce(F.try_element_at(at, F.lit(2)).try_cast("int"), F.lit(0))
    return F.try_element_at(since, feature) <= own


# ---- repairs that need more than one pattern


def one_letter_residues(text: Column) -> Column:
    """W1002: R97W or Arg97* of a p. description in three letters."""
    p = r"^([^:]*:p\.\(?)([ACDEFGHIKLMNPQRSTVWY])(\d+)([ACDEFGHIKLMNPQRSTVWY*]|=|del|dup|Ter)(\)?)$"
    take = lambda i: F.regexp_extract(text, p, i)
    last = F.coalesce(F.when(F.length(take(4)) == 1, three_letters(take(4))), take(4))
    return F.when(text.rlike(p), F.concat(take(1), three_letters(take(2)), take(3), last, take(5))).otherwise(text)


def repeat_label(text: Column) -> Column:
    """W3013: an RNA repeat with a range and its unit: the unit goes where it is as long as the range, else the range."""
    p = r"^(.*:r\.)([*-]?\d+)_([*-]?\d+)([acgu]+)(\[.*)$"
    take = lambda i: F.regexp_extract(text, p, i)
    span = take(3).try_cast("long") - take(2).try_cast("long") + 1
    short = F.concat(take(1), take(2), F.lit("_"), take(3), take(5))
    anchored = F.concat(take(1), take(2), take(4), take(5))
    return F.when(text.rlike(p), F.when(span == F.length(take(4)), short).otherwise(anchored)).otherwise(text)


#: As descriptions.REPAIRS; these come after them.
FURTHER = (
    ("W3010", "X for the stop of a frameshift", r":p\..*fsX(?=\d|\?)", lambda t: F.regexp_replace(t, r"fsX(?=\d|\?)", "fsTer")),
    ("W3008", "X for a stop", r":p\.\(?[A-Z][a-z]{2}\d+X\)?$", lambda t: F.regexp_replace(t, r"(\d)X(\)?)$", "$1Ter$2")),
    ("W1002", "amino acid of one letter", r":p\.\(?[ACDEFGHIKLMNPQRSTVWY]\d+(?:[ACDEFGHIKLMNPQRSTVWY*]|=|del|dup)\)?$", one_letter_residues),
    ("W3006", "no coordinate type", r"^N[CGTW]_\d+\.\d+:\(?[\d?]", lambda t: F.regexp_replace(t, r"^(N[CGTW]_\d+\.\d+:)(?=\(?[\d?])", "$1g.")),
    ("W3004", "coordinate type inside the brackets", r"^[^:\[]+:\[([gcnrm])\.[^;\]]+(?:;\1\.[^;\]]+)+\]$", lambda t: F.concat(F.regexp_extract(t, r"^([^:\[]+:)", 1), F.regexp_extract(t, r":\[([gcnrm]\.)", 1), F.lit("["), F.regexp_replace(F.regexp_extract(t, r":\[(.*)\]$", 1), r"(^|;)[gcnrm]\.", "$1"), F.lit("]"))),
    ("W3013", "unit of a repeat stated twice", r":r\.[*-]?\d+_[*-]?\d+[acgu]+\[", repeat_label),
    ("W4001", "positions swapped", r"\.\d+_\d+\D", swapped),
)


def repair_all(df: DataFrame, column: str, codes: tuple[str, ...] | None = None) -> DataFrame:
    """df with the column repaired by every repair and codes, those that changed it, in order."""
    df = repair(df, column, codes)
    for code, _, needs, fix in FURTHER:
        if codes is None or code in codes:
            text = F.col(column)
            new = F.when(text.rlike(needs), fix(text)).otherwise(text)
            df = df.withColumn("_new", new)
            df = df.withColumns({"codes": F.when(F.col("_new") != text, F.array_append("codes", F.lit(code))).otherwise(F.col("codes")), column: F.col("_new")}).drop("_new")
    return df


# ---- legacy spellings


def legacy_protein(text: Column) -> Column:
    """p.R97W, p.Arg97X, p.Arg97stop and p.Arg97fsX10 as they are written today; others as they are."""
    t = F.regexp_replace(text, r"(?i)(?<=\d)(?:stop|X)(?=\)?$)", "Ter")
    return one_letter_residues(F.regexp_replace(t, r"fs[X*](?=\d|\?)", "fsTer"))


def gene_selector(text: Column) -> Column:
    """struct(accession, gene, number) of NG_012345.1(GENE_v001):c. as older descriptions select a transcript."""
    p = r"^(N[CG]_\d+(?:\.\d+)?)\(([A-Za-z0-9-]+)_(?:v|i)(\d{3})\):"
    take = lambda i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(p), F.struct(take(1).alias("accession"), take(2).alias("gene"), take(3).cast("int").alias("number")))


def legacy(text: Column) -> Column:
    """struct(text, form): a legacy spelling as it is written today and which it was: intron (left for exons to resolve),
    substitution of several bases, insertion at one position, protein; form null for what is none."""
    point = r"^([^:]+:[gcn]\.)(\d{1,17})ins([ACGT]+)$"
    at = F.regexp_extract(text, point, 2).try_cast("long")
    ins = F.concat(F.regexp_extract(text, point, 1), at.cast("string"), F.lit("_"), (at + 1).cast("string"), F.lit("ins"), F.regexp_extract(text, point, 3))
    several = r"^([^:]+:[gcn]\.\d+_\d+)[ACGT]{2,}>([ACGT]+)$"
    protein = legacy_protein(text)
    out = lambda t, form: F.struct(t.alias("text"), F.lit(form).alias("form"))
    return (
        F.when(text.rlike(r":c\.IVS\d+[+-]\d+"), out(text, "intron")).when(text.rlike(several), out(F.regexp_replace(text, several, "$1delins$2"), "substitution"))
        .when(text.rlike(point), out(ins, "insertion")).when(text.contains(":p.") & (protein != text), out(protein, "protein"))
        .otherwise(F.struct(text.alias("text"), F.lit(None).cast("string").alias("form")))
    )


# ---- parsing in a mode


def parse_in_mode(df: DataFrame, key: str, text: str, mode: str = "lenient", overrides: dict[str, str] | None = None) -> DataFrame:
    """key, input, preprocessed, warnings and status (ok, preprocess_error, parse_error), with error, of every row, and the
    parsed phase, members and canonical text.

    strict refuses what any repair would change, lenient repairs it with a warning, silent without one. overrides: for
    single codes another mode. Position 0 is refused in every mode, and so is what no repair helps; detections of what
    stays as written are warnings, which strict refuses as well."""
    from .grammar import parse_all

    if mode not in ("strict", "lenient", "silent") or not set((overrides or {}).values()) <= {"strict", "lenient", "silent"}:
        raise ValueError("a mode is strict, lenient or silent")
    own = F.create_map(*[F.lit(x) for kv in (overrides or {"": mode}).items() for x in kv])
    of = lambda code: F.coalesce(F.try_element_at(own, code), F.lit(mode))
    rows = repair_all(df.select(F.col(key), F.col(text).alias("input"), F.coalesce(F.col(text), F.lit("")).alias("preprocessed")), "preprocessed")
    rows = rows.withColumn("codes", F.concat("codes", detections(F.col("preprocessed"))))
    refused = F.filter("codes", lambda x: of(x) == "strict")
    error = F.when(position_zero(F.col("preprocessed")), "E1003").when(F.size(refused) > 0, F.element_at(refused, 1)).otherwise(member_refusal(F.col("preprocessed")))
    rows = rows.withColumns({"_error": error, "warnings": F.filter("codes", lambda x: of(x) == "lenient")})
    parsed = parse_all(rows.select(F.struct(key, "input", "preprocessed", "_error", "warnings").alias("_row"), F.when(F.col("_error").isNull(), F.col("preprocessed")).otherwise("").alias("_text")), "_row", "_text")
    early = F.col("_row._error").isNotNull()
    status = F.when(early, "preprocess_error").when(F.col("error").isNotNull(), "parse_error").otherwise("ok")
    return parsed.select(
        F.col(f"_row.{key}").alias(key), "_row.input", "_row.preprocessed", "_row.warnings", status.alias("status"), F.coalesce("_row._error", "error").alias("error"), "phase", "members", "canonical",
    )


