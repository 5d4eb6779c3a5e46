"""VCF records as columns: reading a line, predicates, descriptions from records and records from descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import MITOCHONDRION, common_prefix, common_suffix, let, reverse_complement

FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def parse_line(line: Column) -> Column:
    """struct of a record line; null for headers and lines of fewer than eight fields or without a position."""
    f = F.split(line, "\t")
    get = lambda i: F.try_element_at(f, F.lit(i + 1))
    missing = lambda x: F.when(x != ".", x)
    flags = F.filter(F.split(F.coalesce(missing(get(7)), F.lit("")), ";"), lambda x: x != "")
    entries = F.transform(flags, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).otherwise("").alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda x: x["key"]))
    last = let(F.reverse(entries), lambda e: F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(e, lambda x: x["key"] == k), 1)["value"].alias("value"))))
    info = F.map_from_entries(last)  # a repeated key has its last value
    ok = ~line.startswith("#") & (F.size(f) >= 8) & get(1).try_cast("long").isNotNull()
    return F.when(ok, F.struct(
        get(0).alias("chrom"), get(1).try_cast("long").alias("pos"), missing(get(2)).alias("id"), F.upper(get(3)).alias("ref"),
        F.filter(F.split(F.upper(get(4)), ","), lambda x: x != ".").alias("alt"), missing(get(5)).try_cast("double").alias("qual"), missing(get(6)).alias("filter"), info.alias("info"),
        F.when(F.size(f) > 9, F.slice(f, 9, F.size(f))).alias("samples"),
    ))


def write_line(chrom: Column, pos: Column, id_: Column, ref: Column, alt: Column, qual: Column, filter_: Column, info: Column) -> Column:
    """The eight fields; alt an array, info a map, whose keys are sorted."""
    dot = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    keys = F.array_sort(F.map_keys(info))
    pairs = F.array_join(F.transform(keys, lambda k: F.when(F.try_element_at(info, k) != "", F.concat(k, F.lit("="), F.try_element_at(info, k))).otherwise(k)), ";")
    alts = F.when(F.size(alt) > 0, F.array_join(alt, ",")).otherwise(".")
    return F.concat_ws("\t", chrom, pos.cast("string"), dot(id_), ref, alts, dot(qual), dot(filter_), F.when(F.size(keys) > 0, pairs).otherwise("."))


def kind(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), "snv").when((r == 1) & (a > 1), "insertion").when((r > 1) & (a == 1), "deletion").when(r == a, "mnv").otherwise("complex")
    )


def end_position(pos: Column, ref: Column) -> Column:
    return pos + F.length(ref) - 1


def trim(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without the common prefix, then without the common suffix of the rest."""

    def cut(p: Column) -> Column:
        r, a = F.substr(ref, p + 1), F.substr(alt, p + 1)
        return let(common_suffix(r, a), lambda q: F.struct((pos + p).alias("pos"), F.substring(r, F.lit(1), F.length(r) - q).alias("ref"), F.substring(a, F.lit(1), F.length(a) - q).alias("alt")))

    return let(common_prefix(ref, alt), cut)


def description(accession: Column, pos: Column, ref: Column, alt: Column, most_stated: int = 10) -> Column:
    """The genomic description of a record: deleted bases stated up to most_stated of them; an insertion between its
    flanks; null if nothing changes."""

    def say(t: Column) -> Column:
        r, a = F.length(t["ref"]), F.length(t["alt"])
        lo, hi = t["pos"].cast("string"), (t["pos"] + r - 1).cast("string")
        place = F.when(r > 1, F.concat(lo, F.lit("_"), hi)).otherwise(lo)
        body = (
            F.when((r == 0) & (a == 0), F.lit(None)).when((r == 1) & (a == 1), F.concat(lo, t["ref"], F.lit(">"), t["alt"]))
            .when(a == 0, F.concat(place, F.lit("del"), F.when(r <= most_stated, t["ref"]).otherwise("")))
            .when(r == 0, F.concat((t["pos"] - 1).cast("string"), F.lit("_"), lo, F.lit("ins"), t["alt"])).otherwise(F.concat(place, F.lit("delins"), t["alt"]))
        )
        return F.concat(accession, F.when(accession.startswith(MITOCHONDRION), ":m.").otherwise(":g."), body)

    return let(trim(pos, ref, alt), say)


def record(edit: Column, s: Column, e: Column, alt: Column, given: Column, seq: Column) -> Column:
    """struct(pos, ref, alt) of an edit on 1-based [s, e] of seq: deletions, insertions and unequal replacements are anchored
    on the base before, duplications on their last base. given: the stated base of a substitution. Null at the start."""
    base = lambda a, n: F.substring(seq, a.cast("int"), n.cast("int"))
    old, anchor, last = base(s, e - s + 1), base(s - 1, F.lit(1)), base(e, F.lit(1))
    out = lambda pos, r, a: F.struct(pos.cast("long").alias("pos"), r.alias("ref"), a.alias("alt"))
    equal = F.length(old) == F.length(alt)
    return (
        F.when(edit == "sub", out(s, F.when(given != "", given).otherwise(old), alt)).when((edit == "del") & (s > 1), out(s - 1, F.concat(anchor, old), anchor))
        .when(edit == "ins", out(s, base(s, F.lit(1)), F.concat(base(s, F.lit(1)), alt))).when((edit == "delins") & equal, out(s, old, alt))
        .when((edit == "delins") & (s > 1), out(s - 1, F.concat(anchor, old), F.concat(anchor, alt))).when(edit == "dup", out(e, last, F.concat(last, old)))
        .when(edit == "inv", out(s, old, reverse_complement(old))).when(edit == "identity", out(s, old, old))
    )
