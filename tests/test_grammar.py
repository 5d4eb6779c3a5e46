"""The grammar by accept and reject tables, and the column form against the text form."""

import pytest

from nomenspark.functions.grammar import Refused, parse_all, parse_column, parse_text, register, write_text

ACCEPTED = {  # text: (phase, edits)
    "NM_000088.3:c.459A>G": ("single", ["sub"]),
    "NC_000001.11:g.100_102del": ("single", ["del"]),
    "NC_000001.11:g.100_102delACG": ("single", ["del"]),
    "NM_000088.3:c.-3_*5dup": ("single", ["dup"]),
    "NM_000088.3:c.88+1G>T": ("single", ["sub"]),
    "NM_000088.3:c.88+?_99-?del": ("single", ["del"]),
    "NM_000088.3:c.10_11insACG": ("single", ["ins"]),
    "NM_000088.3:c.10_11ins(5)": ("single", ["ins"]),
    "NM_000088.3:c.10_11ins20_30inv": ("single", ["ins"]),
    "NM_000088.3:c.10_11ins[AC;20_30]": ("single", ["ins"]),
    "NM_000088.3:c.10_11insNC_000001.11:g.5_9": ("single", ["ins"]),
    "NM_000088.3:c.10_12delinsAT": ("single", ["delins"]),
    "NM_000088.3:c.10_12delACGinsAT": ("single", ["delins"]),
    "NM_000088.3:c.10_12inv": ("single", ["inv"]),
    "NM_000088.3:c.10=": ("single", ["identity"]),
    "NM_000088.3:c.=": ("single", ["identity"]),
    "NM_000088.3:c.?": ("single", ["unknown"]),
    "NM_000088.3:c.10CAG[23]": ("single", ["repeat"]),
    "NM_000088.3:c.10_15[5]": ("single", ["repeat"]),
    "NM_000088.3:c.10CAG[20]CCG[3]": ("single", ["repeats"]),
    "NC_000001.11:g.(100_200)_(300_400)del": ("single", ["del"]),
    "NC_000001.11:g.(?_200)_(300_?)dup": ("single", ["dup"]),
    "NC_000001.11:g.pter_1000del": ("single", ["del"]),
    "NC_000011.10:g.1999904_1999946|gom": ("single", ["methylation"]),
    "NC_012920.1:m.3243A>G": ("single", ["sub"]),
    "NR_000001.1:n.5A>G": ("single", ["sub"]),
    "NM_000088.3:r.spl": ("single", ["splice"]),
    "NM_000088.3:r.(10a>g)": ("single", ["sub"]),
    "NP_000079.2:p.Arg12Gly": ("single", ["sub"]),
    "NP_000079.2:p.(Arg12Gly)": ("single", ["sub"]),
    "NP_000079.2:p.Arg12Ter": ("single", ["sub"]),
    "NP_000079.2:p.Arg97ProfsTer23": ("single", ["frameshift"]),
    "NP_000079.2:p.Arg97fs": ("single", ["frameshift"]),
    "NP_000079.2:p.Ala3_Ser5del": ("single", ["del"]),
    "NP_000079.2:p.Lys2_Gly3insGlnTer": ("single", ["ins"]),
    "NP_000079.2:p.Cys28delinsTrpVal": ("single", ["delins"]),
    "NP_000079.2:p.Ter110GlnextTer17": ("single", ["extension"]),
    "NP_000079.2:p.Ala2[10]": ("single", ["repeat"]),
    "NP_000079.2:p.(Gly56Ala^Ser^Cys)": ("single", ["sub"]),
    "NP_000079.2:p.0": ("single", ["no_protein"]),
    "NP_000079.2:p.=": ("single", ["identity"]),
    "NM_000088.3:c.[1A>G;5del]": ("cis", ["sub", "del"]),
    "NM_000088.3:c.[1A>G];[5del]": ("trans", ["sub", "del"]),
    "NM_000088.3:c.1A>G(;)5del": ("unknown", ["sub", "del"]),
    "NM_000088.3:c.[1A>G(;)5del]": ("unknown", ["sub", "del"]),
    "NM_000088.3:c.85=/85T>C": ("mosaic", ["identity", "sub"]),
    "NM_000088.3:c.85=//85T>C": ("chimeric", ["identity", "sub"]),
    "NM_000088.3:r.[10a>g,20_30del]": ("products", ["sub", "del"]),
    "[NM_000088.3:c.1A>G];[NM_000088.3:c.5del]": ("trans", ["sub", "del"]),
    "GRCh38(chr1):g.100A>G": ("single", ["sub"]),
    "NC_000001.11(NM_000088.3):c.5+3A>G": ("single", ["sub"]),
    "NM_000088.3(COL1A1):c.5A>G": ("single", ["sub"]),
    "LRG_1t1:c.5A>G": ("single", ["sub"]),
    "ENST00000357033.8:c.5A>G": ("single", ["sub"]),
    "P12345:p.Arg12Gly": ("single", ["sub"]),
}
REJECTED = {
    "": "no accession",
    "NM_000088.3": "no colon",
    "NM_000088.3:459A>G": "no axis",
    "NM_000088.3:c.0A>G": "no position",
    "NM_000088.3:c.10insA": "insertion at one position",
    "NM_000088.3:c.10_11ins": "nothing inserted",
    "NM_000088.3:c.10inv": "inversion of one base",
    "NM_000088.3:c.12_10del": "positions not ascending",
    "NM_000088.3:c.79_80GC>TT": "several bases substituted",
    "NM_000088.3:c.79GC>TT": "several bases substituted",
    "NM_000088.3:c.10_12A>G": "substitution of a range",
    "NM_000088.3:c.10dupinsA": "duplication with an insertion",
    "NM_000088.3:c.10_11insAUG": "uracil in DNA",
    "NM_000088.3:c.10delx": "trailing text",
    "NM_000088.3:c.[1A>G;5del": "unclosed bracket",
    "NP_000079.2:p.Arg97ProfsTer1": "stop at once",
    "NP_000079.2:p.Arg97ArgfsTer5": "unchanged first residue",
    "NP_000079.2:p.Arg5TerGly": "residues after a stop",
    "NP_000079.2:p.Met1Val": "start loss as a substitution",
    "NP_000079.2:p.Ala2insGly": "insertion at one position",
}
CANONICAL = {
    "NC_000001.11:g.100_102delACG": "NC_000001.11:g.100_102del",
    "NM_000088.3:c.10_12delACGinsAT": "NM_000088.3:c.10_12delinsAT",
    "NP_000079.2:p.Arg97Profs*23": "NP_000079.2:p.Arg97ProfsTer23",
    "[NM_000088.3:c.1A>G];[NM_000088.3:c.5del]": "NM_000088.3:c.[1A>G];[5del]",
}


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    phase, members = parse_text(text)
    assert (phase, [m.edit for m in members]) == ACCEPTED[text]
    again = write_text(phase, members)
    assert write_text(*parse_text(again)) == again


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(Refused) as e:
        parse_text(text)
    assert e.value.why == REJECTED[text]


@pytest.mark.parametrize("text", CANONICAL)
def test_canonical(text):
    assert write_text(*parse_text(text)) == CANONICAL[text]


def test_fast_and_full_agree(spark):
    texts = [*ACCEPTED, *REJECTED, *CANONICAL, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    full = {r.k: r for r in parse_column(df, "k", "t").collect()}
    fast = {r.k: r for r in parse_all(df, "k", "t").collect()}
    assert full == fast and len(full) == len(texts)
    assert parse_all(df.limit(0), "k", "t").count() == 0


def test_sql_function(spark):
    register(spark)
    row = spark.sql("SELECT variant_parse('NM_1.1:c.[1A>G;5del]') AS v, variant_parse('x') AS w").first()
    assert row.v.phase == "cis" and row.w.error == "no accession"
