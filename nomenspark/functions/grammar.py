"""The full grammar of variant descriptions: a recursive-descent parser without Spark, and its Arrow-batched column form.

A description parses to a list of members, one a simple variant, with the phase of the allele that holds them. Most texts are
of a common form, which descriptions.parse() reads in the JVM; parse_all() sends only the others to Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .descriptions import AMINO
from .descriptions import parse as parse_common


class Refused(ValueError):
    """Why and where a text is no description."""

    def __init__(self, why: str, at: int):
        super().__init__(why)
        self.why, self.at = why, at


@dataclass
class Member:
    accession: str = ""
    gene: str = ""
    axis: str = ""
    start: str = ""  # as written, without the axis: 12, -3, *5, 88+1, (1_5), pter, ?
    end: str = ""
    edit: str = ""
    ref: str = ""
    alt: str = ""
    count: str = ""  # copies, as written: 5, 3_6, ?
    predicted: bool = False


#: Phases of alleles by what joins their members.
_BASES = re.compile(r"[ACGTUNRYKMSWBDHVacgtunrykmswbdhv]+")
_ACCESSION = re.compile(
    r"(?:(?:GRCh\d+|hg\d+)\([A-Za-z0-9_.]+\)|LRG_\d+(?:[tp]\d+)?|ENS[A-Z]{0,5}[GTPER]\d+(?:\.\d+)?|[A-Z]{2}_\d+(?:\.\d+)?|[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})"
)
_GENE = re.compile(r"\(([A-Za-z0-9_.\-]+)\)")
_POINT = re.compile(r"(?:[*-]?[1-9]\d*|\?)(?:[+-](?:\d+|\?))?|pter|qter|cen")
_AA = re.compile("|".join(AMINO) + r"|[ACDEFGHIKLMNPQRSTVWYUOX*]")
_COUNT = re.compile(r"\[(\(?(?:\d+|\?)(?:_(?:\d+|\?))?\)?)\]")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    # -- reading

    def fail(self, why: str):
        raise Refused(why, self.at)

    def look(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.look(s):
            self.at += len(s)
            return True
        return False

    def match(self, pattern: re.Pattern) -> str:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m[0] if m else ""

    # -- descriptions

    def whole(self) -> tuple[str, list[Member]]:
        """(phase, members)"""
        phase, members = self.description()
        if self.at < len(self.text):
            self.fail("trailing text")
        return phase, members

    def description(self) -> tuple[str, list[Member]]:
        if self.look("["):  # alleles of full descriptions: [A];[B]
            groups = [self.group(None)]
            while self.take(";"):
                groups.append(self.group(None))
            return ("trans" if len(groups) > 1 else "cis"), [m for g in groups for m in g]
        head = self.head()
        if self.look("[") and head.axis != "":
            return self.alleles(head)
        first = self.variant(head)
        if self.take("//"):
            return "chimeric", [first, self.variant(head)]
        if self.take("/"):
            return "mosaic", [first, self.variant(head)]
        if self.look("::"):
            members = [first]
            while self.take("::"):
                members.append(self.variant(self.head() if ":" in self.text[self.at :] else head))
            return "fusion" if head.axis == "r" else "ring", members
        if self.take("(;)"):
            members = [first, self.variant(head)]
            while self.take("(;)"):
                members.append(self.variant(head))
            return "unknown", members
        return "single", [first]

    def head(self) -> Member:
        accession = self.match(_ACCESSION)
        if not accession:
            self.fail("no accession")
        if self.take("("):  # a gene, or a transcript on a genomic sequence
            inner = self.match(_ACCESSION) if re.match(_ACCESSION, self.text[self.at :]) else self.match(re.compile(r"[A-Za-z0-9_.\-]+"))
            if not inner or not self.take(")"):
                self.fail("unclosed parenthesis")
            if _ACCESSION.fullmatch(inner):
                accession = f"{accession}({inner})"
                gene = ""
            else:
                gene = inner
        else:
            gene = ""
        if not self.take(":"):
            self.fail("no colon")
        axis = self.match(re.compile(r"[gcnrpmo](?=\.)"))
        if not axis or not self.take("."):
            self.fail("no axis")
        return Member(accession, gene, axis)

    def alleles(self, head: Member) -> tuple[str, list[Member]]:
        groups, joined = [self.group(head)], ""
        while self.look(";") or self.look("(;)"):
            joined = "unknown" if self.take("(;)") else (self.take(";") and "trans")
            groups.append(self.group(head))
        members = [m for g in groups for m in g]
        phase = joined or self.inner_phase
        return phase, members

    def group(self, head: Member | None) -> list[Member]:
        if not self.take("["):
            self.fail("no bracket")
        own = lambda: self.variant(head if head else self.head())
        members, self.inner_phase = [own()], "cis"
        while True:
            if self.take("(;)"):
                self.inner_phase = "unknown"
            elif self.take(";"):
                pass
            elif self.take("^"):
                self.inner_phase = "or"
            elif self.take(","):
                self.inner_phase = "products"
            else:
                break
            members.append(own())
        if not self.take("]"):
            self.fail("unclosed bracket")
        return members

    def variant(self, head: Member) -> Member:
        m = Member(head.accession, head.gene, head.axis)
        if self.look("(") and not self.uncertain_range():
            self.at += 1
            m.predicted = True
            self.protein(m) if m.axis == "p" else self.nucleic(m)
            if not self.take(")"):
                self.fail("unclosed parenthesis")
        else:
            self.protein(m) if m.axis == "p" else self.nucleic(m)
        return m

    # -- nucleic acids

    def uncertain_range(self) -> bool:
        return bool(re.compile(r"\([^()]*_[^()]*\)").match(self.text, self.at)) and self.text[self.at + 1 : self.at + 2] in "0123456789?*-"

    def position(self) -> str:
        if self.look("(") and self.uncertain_range():
            start = self.at
            self.at += 1
            if not self.match(_POINT) or not self.take("_") or not self.match(_POINT) or not self.take(")"):
                self.fail("bad uncertain position")
            return self.text[start : self.at]
        p = self.match(_POINT)
        if not p:
            self.fail("no position")
        return p

    def nucleic(self, m: Member) -> None:
        if self.take("="):
            m.edit = "identity"
            return
        if self.take("?") and (self.at == len(self.text) or self.text[self.at] in "];)"):
            m.edit = "unknown"
            return
        if self.text[self.at - 1 : self.at] == "?" and self.text[self.at - 2 : self.at - 1] in (".", "["):
            self.at -= 1
        if m.axis == "r" and (self.take("spl") or self.take("0")):
            m.edit = "splice" if self.text[self.at - 1] == "l" else "no_product"
            return
        m.start = m.end = self.position()
        if self.take("_"):
            m.end = self.position()
            if m.start.isdigit() and m.end.isdigit() and int(m.start) >= int(m.end) and m.axis not in "om":
                self.fail("positions not ascending")
        self.edit(m)

    def payload(self) -> str:
        """Bases, a count, a copied range or a bracketed list of those."""
        start = self.at
        if self.take("["):
            while True:
                if not self.part():
                    self.fail("bad inserted part")
                if not self.take(";"):
                    break
            if not self.take("]"):
                self.fail("unclosed bracket")
        elif not self.part():
            self.fail("nothing inserted")
        self.match(_COUNT)
        return self.text[start : self.at]

    def part(self) -> bool:
        if re.compile(r"\(?(?:\d+|\?)(?:_(?:\d+|\?))?\)").match(self.text, self.at) and self.look("("):
            self.match(re.compile(r"\((?:\d+|\?)(?:_(?:\d+|\?))?\)"))
            return True
        here = _ACCESSION.match(self.text, self.at)
        if here and self.text[here.end() : here.end() + 1] == ":":
            self.head()
        if self.match(_BASES):
            self.match(_COUNT)
            return True
        if self.match(_POINT):
            if self.take("_") and not self.match(_POINT):
                return False
            self.take("inv")
            self.match(_COUNT)
            return True
        return False

    def edit(self, m: Member) -> None:
        point = m.start == m.end
        if self.take("delins"):
            m.edit, m.alt = "delins", self.payload()
        elif self.take("del"):
            m.edit, m.ref = "del", self.match(_BASES)
            if self.take("ins"):
                m.edit, m.alt = "delins", self.payload()
        elif self.take("dup"):
            m.edit, m.ref = "dup", self.match(_BASES)
            if self.look("ins"):
                self.fail("duplication with an insertion")
        elif self.take("ins"):
            if point and not m.start.startswith("("):
                self.fail("insertion at one position")
            m.edit, m.alt = "ins", self.payload()
        elif self.take("inv"):
            if point and not m.start.startswith("("):
                self.fail("inversion of one base")
            m.edit = "inv"
        elif self.take("con"):
            m.edit, m.alt = "delins", self.text[self.at :]
            self.at = len(self.text)
        elif self.take("|"):
            m.edit, m.alt = "methylation", self.match(re.compile("gom|lom|met="))
            if not m.alt:
                self.fail("unknown methylation")
        elif self.take("="):
            m.edit = "identity"
            if self.look("/"):
                pass
        elif self.look("["):
            m.edit, m.count = "repeat", self.match(_COUNT)[1:-1]
            if not m.count:
                self.fail("bad copy count")
        elif bases := self.match(_BASES):
            if self.take(">"):
                m.edit, m.ref, m.alt = "sub", bases, self.match(_BASES)
                if not m.alt:
                    self.fail("no new base")
                if len(m.ref) > 1 or len(m.alt) > 1:
                    self.fail("several bases substituted")
                if m.start != m.end:
                    self.fail("substitution of a range")
            elif self.take("="):
                m.edit, m.ref = "identity", bases
            elif count := self.match(_COUNT):
                m.edit, m.ref, m.count = "repeat", bases, count[1:-1]
                while bases := self.match(_BASES):
                    more = self.match(_COUNT)
                    if not more:
                        self.fail("bad copy count")
                    m.edit, m.ref, m.count = "repeats", f"{m.ref};{bases}", f"{m.count};{more[1:-1]}"
            else:
                self.fail("no edit")
        elif self.take(">"):
            m.edit, m.alt = "sub", self.match(_BASES)
            if not m.alt:
                self.fail("no new base")
        else:
            self.fail("no edit")
        if m.axis in "gcno" and ("U" in m.alt or "u" in m.alt) and m.edit in ("sub", "ins", "delins"):
            self.fail("uracil in DNA")

    # -- proteins

    def residue(self) -> tuple[str, str]:
        aa = self.match(_AA)
        n = self.match(re.compile(r"[1-9]\d*")) if aa else ""
        if not n:
            self.fail("no residue")
        return aa, n

    def protein(self, m: Member) -> None:
        for mark, edit in (("=", "identity"), ("0?", "no_protein"), ("0", "no_protein"), ("?", "unknown")):
            if self.take(mark):
                m.edit = edit
                return
        aa, n = self.residue()
        m.ref, m.start, m.end = aa, n, n
        last = aa
        if self.take("_"):
            last, m.end = self.residue()
            if int(m.end) <= int(m.start):
                self.fail("positions not ascending")
            m.ref = f"{aa}_{last}"
        point = m.start == m.end
        if self.take("delins"):
            m.edit, m.alt = "delins", self.residues()
        elif self.take("del"):
            m.edit = "del"
        elif self.take("dup"):
            m.edit = "dup"
        elif self.take("ins"):
            if point:
                self.fail("insertion at one position")
            m.edit, m.alt = "ins", self.residues()
        elif self.take("fs"):
            m.edit = "frameshift"
            self.shift(m)
        elif self.look("ext"):
            self.take("ext")
            m.edit, m.alt = "extension", self.match(re.compile(r"(?:Ter|\*|X)?-?(?:\d+|\?)?"))
        elif self.take("="):
            m.edit = "identity"
        elif self.take("?"):
            m.edit = "unknown"
        elif count := self.match(_COUNT):
            m.edit, m.count = "repeat", count[1:-1]
        elif alt := self.match(_AA):
            m.alt, m.edit = alt, "sub"
            if self.take("fs"):
                m.edit = "frameshift"
                self.shift(m)
            elif self.take("ext"):
                m.edit, m.alt = "extension", alt + "ext" + self.match(re.compile(r"(?:Ter|\*|X)?-?(?:\d+|\?)?"))
            elif self.take("^"):
                others = [alt]
                others.append(self.match(_AA))
                while self.take("^"):
                    others.append(self.match(_AA))
                if not all(others):
                    self.fail("no residue")
                m.alt = "^".join(others)
            elif not point:
                self.fail("substitution of a range")
            elif alt in ("Ter", "*") and self.match(_AA):
                self.fail("residues after a stop")
            elif m.start == "1" and aa in ("Met", "M") and m.edit == "sub" and alt not in ("Met", "M"):
                self.fail("start loss as a substitution")
        else:
            self.fail("no edit")

    def shift(self, m: Member) -> None:
        stop = self.match(re.compile(r"(?:Ter|\*|X)(?:\d+|\?)?"))
        digits = re.sub(r"\D", "", stop)
        if digits == "1":
            self.fail("stop at once")
        if stop and m.alt and m.alt == m.ref:
            self.fail("unchanged first residue")
        m.count = digits or ("?" if stop else "")

    def residues(self) -> str:
        start = self.at
        if self.match(re.compile(r"\(?(?:\d+|\?)\)?(?=$|[\];)])")):
            return self.text[start : self.at]
        while self.match(_AA):
            if self.text[self.at - 1] == "*" or self.text[self.at - 3 : self.at] == "Ter":
                break
        if self.at == start:
            self.fail("nothing inserted")
        if self.match(_AA):
            self.fail("residues after a stop")
        return self.text[start : self.at]


def parse_text(text: str) -> tuple[str, list[Member]]:
    """(phase, members) of a description; raises Refused."""
    return Parser(text).whole()


def write_member(m: Member, with_head: bool = True) -> str:
    """The canonical text of a member."""
    head = f"{m.accession}{f'({m.gene})' if m.gene else ''}:{m.axis}." if with_head else ""
    place = m.start + (f"_{m.end}" if m.end != m.start else "")
    if m.axis == "p":
        if m.edit in ("identity", "no_protein", "unknown") and not m.start:
            body = {"identity": "=", "no_protein": "0", "unknown": "?"}[m.edit]
        else:
            a, _, b = m.ref.partition("_")
            place = f"{a}{m.start}" + (f"_{b}{m.end}" if b else "")
            stop = f"Ter{m.count}" if m.count else ""
            tail = {"identity": "=", "unknown": "?", "sub": m.alt, "frameshift": f"{m.alt}fs{stop}", "repeat": f"[{m.count}]", "extension": m.alt if "ext" in m.alt else f"ext{m.alt}"}
            body = place + tail.get(m.edit, m.edit + m.alt)
    elif not m.start:
        body = {"identity": "=", "unknown": "?", "splice": "spl", "no_product": "0"}[m.edit]
    else:
        repeats = "".join(f"{u}[{n}]" for u, n in zip(m.ref.split(";"), m.count.split(";"), strict=False))
        tail = {"sub": f"{m.ref}>{m.alt}", "identity": f"{m.ref}=", "repeat": repeats or f"[{m.count}]", "repeats": repeats, "methylation": f"|{m.alt}", "del": "del", "dup": "dup"}
        body = place + tail.get(m.edit, m.edit + m.alt)
    return head + (f"({body})" if m.predicted else body)


def write_text(phase: str, members: list[Member]) -> str:
    """The canonical text of a description."""
    first = write_member(members[0])
    if phase == "single":
        return first
    bodies = [write_member(m, False) for m in members]
    head = first[: len(first) - len(bodies[0])]
    joins = {"cis": ";", "unknown": "(;)", "or": "^", "products": ",", "mosaic": "/", "chimeric": "//", "ring": "::", "fusion": "::"}
    if phase == "trans":
        return head + ";".join(f"[{b}]" for b in bodies)
    if phase in ("mosaic", "chimeric", "ring", "fusion", "unknown"):
        return head + joins[phase].join(bodies)
    return f"{head}[{joins[phase].join(bodies)}]"


MEMBER = "struct<accession:string,gene:string,axis:string,start:string,end:string,edit:string,ref:string,alt:string,count:string,predicted:boolean>"


_STRUCT = f"struct<phase:string,members:array<{MEMBER}>,error:string,error_at:int,canonical:string>"
_ARROW = pa.struct([
    ("phase", pa.string()), ("members", pa.list_(pa.struct([(f.name, pa.bool_() if f.name == "predicted" else pa.string()) for f in fields(Member)]))),
    ("error", pa.string()), ("error_at", pa.int32()), ("canonical", pa.string()),
])


def read_row(text: str) -> dict:
    """The fields of a description, or why and where it is none."""
    try:
        phase, members = parse_text(text)
    except Refused as e:
        return {"error": e.why, "error_at": e.at}
    return {"phase": phase, "members": [vars(m) for m in members], "canonical": write_text(phase, members)}


def _udf():
    """As read_row() over Arrow arrays; null gives null, so that only texts that need it are read."""

    @F.arrow_udf(_STRUCT)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else read_row(t) for t in texts.to_pylist()], _ARROW)

    return run


def parse_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, phase, members, error, error_at and canonical of every row: errors are data. A null text is an error at 0."""
    read = df.select(F.col(key), F.col(text), _udf()(F.coalesce(F.col(text), F.lit(""))).alias("_r"))
    return read.select(key, text, "_r.*")


#: Accessions of the common forms that are valid and canonical as they stand.
_PLAIN = r"^(?:N[CGTWMRP]|X[MRP])_\d+(?:\.\d+)?$"


def parse_all(df: DataFrame, key: str, text: str) -> DataFrame:
    """As parse_column(), with the common forms read in the JVM and only the rest in Python, in one pass over the rows."""
    rows = df.select(F.col(key), F.col(text), parse_common(F.col(text)).alias("_v"))
    v = lambda x: F.col(f"_v.{x}")
    body = F.substring_index(text, ":", -1)
    ranged = body.contains("_")
    nucleic = v("axis").isin("g", "c", "n", "m") & ~v("accession").rlike("^.P_") & F.when(ranged, v("s") < v("e")).otherwise(v("edit").isin("sub", "del", "dup", "identity"))
    protein = (v("edit") == "missense") & v("accession").rlike("^.P_") & v("ref").isin(*AMINO) & v("alt").isin(*AMINO) & ~((v("s") == 1) & (v("ref") == "Met")) & ~body.contains("(")
    plain = F.coalesce(v("accession").rlike(_PLAIN) & (nucleic | protein), F.lit(False))
    rows = rows.withColumn("_plain", plain)
    rows = rows.withColumn("_r", _udf()(F.when(~F.col("_plain"), F.coalesce(F.col(text), F.lit("")))))
    empty = F.lit("")
    member = F.struct(
        v("accession").alias("accession"), empty.alias("gene"), v("axis").alias("axis"), v("s").cast("string").alias("start"), v("e").cast("string").alias("end"),
        F.when(v("edit") == "missense", "sub").otherwise(v("edit")).alias("edit"), v("ref").alias("ref"), v("alt").alias("alt"), empty.alias("count"), F.lit(False).alias("predicted"),
    )
    either = lambda mine, name: F.when(F.col("_plain"), mine).otherwise(F.col(f"_r.{name}")).alias(name)
    return rows.select(
        key, text, either(F.lit("single"), "phase"), either(F.array(member).cast(f"array<{MEMBER}>"), "members"), F.col("_r.error").alias("error"),
        F.col("_r.error_at").alias("error_at"), either(F.col(text), "canonical"),
    )


def parsed(text: Column) -> Column:
    """struct(phase, members, error, error_at, canonical) as a column expression, for SQL registration."""
    return _udf()(text)


def register(spark) -> None:
    """variant_parse(text) in SQL."""
    spark.udf.register("variant_parse", _udf())
