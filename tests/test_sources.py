"""Readers and writers over files written here."""

import json

import pytest
from pyspark.sql import functions as F

from nomenspark import streaming
from nomenspark.sources import genomics as G
from nomenspark.sources import sinks, text


def put(path, body):
    path.write_text(body)
    return str(path)


def test_lines_and_exports(spark, tmp_path):
    p = put(tmp_path / "a.txt", "﻿NM_1.1:c.1A>G\n# note\n\n  NC_1.1:g.5del  # why\n")
    assert sorted(r.text for r in text.lines(spark, p).collect()) == ["NC_1.1:g.5del", "NM_1.1:c.1A>G"]
    row = ["x"] * 6 + ["NM_1.1:c.1A>G|NM_1.2:c.1A>G", "y", "NP_1.1:p.Ala1Gly"]
    p = put(tmp_path / "c.tsv", "#head\n" + "\t".join(row) + "\n" + "\t".join(row) + "\nshort\n")
    assert sorted(r.text for r in text.clinvar_export(spark, p).collect()) == ["NM_1.1:c.1A>G", "NM_1.2:c.1A>G", "NP_1.1:p.Ala1Gly"]
    df = spark.createDataFrame([("DP=1;CSQ=a|b|,c|d|e,c|d|e",), (".",)], "info string")
    assert [r[0] for r in df.select(text.consequence_fields(F.col("info"), "CSQ", 2)).collect()] == [["e"], []]
    docs = ['["a", "b"]', '[{"input": "a"}, {"input": "b"}]', '{"patterns": ["a", "b"]}']
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    assert [r[0] for r in df.select(text.json_patterns(F.col("t"))).collect()] == [["a", "b"]] * 3


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">NC_1.1 first one\nacgt\nAC\n>NC_2.1\nGG\n\nTT\n>empty\n")
    assert sorted(map(tuple, G.fasta(spark, p).collect())) == [("NC_1.1", "first one", "ACGTAC"), ("NC_2.1", "", "GGTT"), ("empty", "", "")]


def test_vcf_round_trip(spark, tmp_path):
    lines = ["chr1\t5\trs1\tA\tC,G\t30.0\tPASS\tDB;DP=3", "chr1\t9\t.\tAT\tA\t.\t.\t."]
    p = put(tmp_path / "a.vcf", "##fileformat=VCFv4.3\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"d\">\n#CHROM\tPOS\n" + "\n".join(lines) + "\nbroken\n")
    rows = {r.pos: r for r in G.vcf(spark, p).collect()}
    assert rows[5].alt == ["C", "G"] and rows[5].info == {"DB": "", "DP": "3"} and rows[9].id is None and rows[9].info == {}
    assert {(r.kind, r.id) for r in G.vcf_header(spark, p).collect()} == {("fileformat", None), ("INFO", "DP")}
    out = str(tmp_path / "out")
    sinks.write_vcf(G.vcf(spark, p).repartition(2), out, ["##fileformat=VCFv4.3", sinks.info_header("DP", "1", "Integer", "d")])
    back = [r.value for r in spark.read.text(out).collect()]
    assert [x for x in back if not x.startswith("#")] == lines
    assert sorted(r.pos for r in G.vcf(spark, out).collect()) == [5, 9]


GFF = """##gff-version 3
chr1\tx\tmRNA\t1\t100\t.\t-\t.\tID=rna-T1;Parent=gene-G
chr1\tx\texon\t61\t100\t.\t-\t.\tParent=rna-T1;gene=G
chr1\tx\texon\t1\t40\t.\t-\t.\tParent=rna-T1;gene=G
chr1\tx\tCDS\t11\t90\t.\t-\t0\tParent=rna-T1;gene=G
chr1\tx\tfive_prime_UTR\t201\t210\t.\t+\t.\tParent=rna-T2
chr1\tx\tCDS\t211\t250\t.\t+\t0\tParent=rna-T2
chr1\tx\tCDS\t301\t350\t.\t+\t0\tParent=rna-T2
chr1\tx\texon\t9\t5\t.\t+\t.\tParent=rna-T3
chr1\tx\texon
"""


def test_annotation(spark, tmp_path):
    features = G.annotation(spark, put(tmp_path / "a.gff3", GFF))
    got = {r.tx: r for r in G.transcripts(features).collect()}
    assert [tuple(e) for e in got["T1"].exons] == [(1, 61, 100), (2, 1, 40)] and (got["T1"].cds_lo, got["T1"].cds_hi, got["T1"].gene) == (11, 90, "G")
    assert [tuple(e) for e in got["T2"].exons] == [(1, 201, 250), (2, 301, 350)] and set(got) == {"T1", "T2"}
    assert {(r.problem, r.n) for r in G.problems(features).collect()} == {("order", 1), ("columns", 1)}
    gtf = 'chr2\tx\texon\t5\t9\t.\t+\t.\tgene_id "G2"; transcript_id "T9"; gene_name "N";\n'
    (row,) = G.transcripts(G.annotation(spark, put(tmp_path / "a.gtf", gtf))).collect()
    assert (row.tx, row.gene, [tuple(e) for e in row.exons]) == ("T9", "N", [(1, 5, 9)])
    line = json.loads(G.transcripts(features).where("tx = 'T1'").select(sinks.transcript_rows(features)).first()[0])
    assert line["id"] == "T1" and line["exons"][0]["lo"] == 61


def test_chains(spark, tmp_path):
    body = "# note\nchain 900 chr1 1000 + 100 160 chr2 2000 - 500 558 7\n20 5 3\n30 0 0\n5\n\nchain 10 chr1 1000 + 0 9 chr1 1000 + 0 9 8\n9\n"
    rows = sorted(map(tuple, G.chains(spark, put(tmp_path / "a.chain", body)).collect()))
    assert [r[0] for r in rows] == [7, 7, 7, 8]
    assert [r[8:] for r in rows] == [(100, 120, 500), (125, 155, 523), (155, 160, 553), (0, 9, 0)]
    assert rows[0][1:8] == (900, "chr1", "chr2", "-", 2000, 100, 160)


def test_reports_and_json(spark, tmp_path):
    p = put(tmp_path / "r.txt", "# x\n1\tassembled\t1\tChromosome\tCM1.1\t=\tNC_1.1\tPrimary\t5\tchr1\nu\tun\tna\tna\tGL1\t<>\tna\tx\t1\tna\n")
    assert [(r.name, r.refseq, r.ucsc) for r in G.assembly_report(spark, p).collect()] == [("1", "NC_1.1", "chr1"), ("u", None, None)]
    one = {"id": "NM_1.1", "gene_symbol": "G", "strand": "+", "sequence": "ACG", "cds_start": 1, "cds_end": 3, "exons": [{"number": 1, "start": 1, "end": 3}]}
    for name, body in (("a", [one]), ("b", {"transcripts": [one], "proteins": {}})):
        (r,) = G.transcript_json(spark, put(tmp_path / f"{name}.json", json.dumps(body))).collect()
        assert (r.id, r.cds_end, r.exons[0].end) == ("NM_1.1", 3, 3)
    with pytest.raises(Exception, match="unknown keys: other"):
        G.transcript_json(spark, put(tmp_path / "c.json", json.dumps({"other": 1}))).collect()
    cdot = {"transcripts": {"NM_1.1": {"gene_name": "G", "genome_builds": {"GRCh38": {"contig": "NC_1.1", "strand": "-", "exons": [[200, 250, 0, 1, 50, None], [100, 150, 1, 51, 100, None]]}}}}}
    rows = sorted(map(tuple, G.cdot(spark, put(tmp_path / "d.json", json.dumps(cdot)), "GRCh38").collect()))
    assert rows == [("NM_1.1", "G", "NC_1.1", -1, 1, 0, 50, 200, 250), ("NM_1.1", "G", "NC_1.1", -1, 2, 50, 100, 100, 150)]
    assert G.cdot(spark, str(tmp_path / "d.json"), "GRCh37").count() == 0


def test_result_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b", None, None), (2, "x", None, "parse_error", "no axis")], "line int, input string, normalized string, error string, detail string")
    sinks.write_results(sinks.result_rows(df).coalesce(1), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["line\tinput\tnormalized\tchanged\tstatus\tdetail", "1\ta\tb\ttrue\tok\t", "2\tx\t\tfalse\tparse_error\tno axis"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.txt", "NM_1.1:c.1A>G\n# c\n")
    run = lambda: streaming.write(streaming.described(streaming.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(tmp_path / "in" / "b.txt", "NC_1.1:g.5_6del\n")
    run()
    got = sorted((r.text, r.category, r.edit) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("NC_1.1:g.5_6del", "genomic_del", "del"), ("NM_1.1:c.1A>G", "coding_snv", "sub")]


def test_fasta_chunks_over_many_splits(spark, tmp_path):
    """Records over several splits, several in one, empty ones, and text before the first."""
    import random

    r, records = random.Random(4), {}
    for i in range(40):
        records[f"R{i}.1"] = "".join(r.choice("ACGTN") for _ in range(r.choice((0, 1, 63, 64, 65, 700, 20_000))))
    for name, width in (("a", 60), ("b", 7)):
        lines = ["not a sequence"] if name == "a" else []
        for acc, seq in records.items():
            lines += [f">{name}{acc} note", *(seq[k : k + width].lower() for k in range(0, len(seq), width)), ""]
        (tmp_path / f"{name}.fa").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(x.acc, x.chunk): x.bases for x in G.fasta_chunks(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n + acc, k): seq[64 * k : 64 * k + 64] for n in "ab" for acc, seq in records.items() for k in range((len(seq) + 63) // 64)}
    assert got == want


def test_repeated_info_keys_have_their_last_value(spark):
    from nomenspark.functions import vcf

    line = "1\t5\t.\tA\tC\t.\t.\tDP=3;DP=4;DB;DB"
    r = spark.createDataFrame([(line,)], "line string").select(vcf.parse_line(F.col("line")).alias("r")).first().r
    assert r.info == {"DP": "4", "DB": ""}
