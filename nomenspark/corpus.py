"""Domain tables derived from the relational test tables, in SQL text that Spark and DuckDB read alike.

They are inputs only: a query runs its operator over one of them, and its oracle states in SQL what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _n(x: str, width: int = 6) -> str:
    return f"lpad(CAST({x} AS STRING), {width}, '0')"


def _contig(n: str) -> str:
    """The accession of chromosome number n, 1 to 22, in build 38."""
    versions = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate((11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11), 1))
    return f"concat('NC_', {_n(n)}, '.', CASE {n} {versions} END)"


def _chrom(n: str) -> str:
    """A chromosome's name of 26: 22 numbers, X, Y without chr, the mitochondrion, and one that no assembly has."""
    return f"CASE {n} WHEN 22 THEN 'chrX' WHEN 23 THEN 'Y' WHEN 24 THEN 'chrM' WHEN 25 THEN 'chrUn_9' ELSE concat('chr', CAST(1 + {n} AS STRING)) END"


_BASES = "translate(md5({0}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_TRACTS = "translate(md5(concat(CAST(p_partkey AS STRING), '-{0}')), '0123456789abcdef', 'AAAAACCCCAAGGTTT')"
_PARTS = ", ".join(_TRACTS.format(i) for i in range(8))

TABLES: dict[str, tuple[list[str], str]] = {
    # 256 bases with runs and repeats
    "sequences": (["part"], f"""
        SELECT p_partkey AS k, concat('NC_', {_n('p_partkey')}, '.', CAST(1 + p_size % 3 AS STRING)) AS acc, concat({_PARTS}) AS seq FROM part"""),
    # one description a line item, with the fields it was written from
    "variants": (["lineitem"], f"""
        SELECT vid, axis, acc, edit, s, CASE WHEN edit IN ('sub', 'missense') THEN s ELSE e END AS e, ref, alt,
          CASE edit WHEN 'sub' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), ref, '>', alt)
            WHEN 'del' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), CASE WHEN e > s THEN concat('_', CAST(e AS STRING)) ELSE '' END, 'del')
            WHEN 'dup' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), CASE WHEN e > s THEN concat('_', CAST(e AS STRING)) ELSE '' END, 'dup')
            WHEN 'delins' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), CASE WHEN e > s THEN concat('_', CAST(e AS STRING)) ELSE '' END, 'delins', alt)
            WHEN 'ins' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), '_', CAST(e AS STRING), 'ins', alt)
            WHEN 'inv' THEN concat(acc, ':', axis, '.', CAST(s AS STRING), '_', CAST(e AS STRING), 'inv')
            ELSE concat(acc, ':p.', ref, CAST(s AS STRING), alt) END AS description
        FROM (
          SELECT vid, edit, s, axis, acc,
            CASE edit WHEN 'ins' THEN s + 1 WHEN 'inv' THEN s + 1 + w ELSE s + w END AS e,
            CASE WHEN edit = 'sub' THEN substr('ACGT', r, 1) WHEN edit = 'missense' THEN substr('AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal', 3 * a + 1, 3) ELSE '' END AS ref,
            CASE WHEN edit = 'sub' THEN substr('CGTA', r, 1) WHEN edit = 'missense' THEN substr('ArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrValAla', 3 * a + 1, 3)
              WHEN edit IN ('ins', 'delins') THEN substr({_BASES.format("CAST(pk AS STRING)")}, 1, CAST(1 + w AS INT)) ELSE '' END AS alt
          FROM (
            SELECT l_orderkey * 10 + l_linenumber AS vid, l_partkey AS pk, CAST(l_suppkey % 5 AS BIGINT) AS w, CAST(1 + l_partkey % 4 AS INT) AS r, CAST(l_partkey % 20 AS INT) AS a,
              10 + l_orderkey % 3000 AS s,
              CASE l_linenumber WHEN 1 THEN 'sub' WHEN 2 THEN 'del' WHEN 3 THEN 'dup' WHEN 4 THEN 'delins' WHEN 5 THEN 'ins' WHEN 6 THEN 'inv' ELSE 'missense' END AS edit,
              CASE WHEN l_linenumber >= 7 THEN 'p' WHEN l_orderkey % 5 = 0 THEN 'c' WHEN l_orderkey % 5 = 1 THEN 'n' ELSE 'g' END AS axis,
              concat(CASE WHEN l_linenumber >= 7 THEN 'NP_' WHEN l_orderkey % 5 = 0 THEN 'NM_' WHEN l_orderkey % 5 = 1 THEN 'NR_' ELSE 'NC_' END, {_n('l_partkey')}, '.', CAST(1 + l_suppkey % 3 AS STRING)) AS acc
            FROM lineitem
          ) x
        ) y"""),
    # accessions of every kind
    "accessions": (["lineitem"], f"""
        SELECT l_orderkey * 10 + l_linenumber AS vid, CASE l_partkey % 13 WHEN 0 THEN concat('NC_', {_n('l_orderkey')}, '.', CAST(l_linenumber AS STRING)) WHEN 1 THEN concat('NM_', {_n('l_orderkey')}, '.', CAST(l_linenumber AS STRING))
          WHEN 2 THEN concat('NR_', {_n('l_orderkey')}, '.1') WHEN 3 THEN concat('NP_', {_n('l_orderkey')}, '.1') WHEN 4 THEN concat('XM_', {_n('l_orderkey')}, '.2') WHEN 5 THEN concat('LRG_', CAST(l_orderkey AS STRING))
          WHEN 6 THEN concat('LRG_', CAST(l_orderkey AS STRING), 't', CAST(l_linenumber AS STRING)) WHEN 7 THEN concat('LRG_', CAST(l_orderkey AS STRING), 'p1') WHEN 8 THEN concat('ENST', {_n('l_orderkey', 11)}, '.4')
          WHEN 9 THEN concat('ENSG', {_n('l_orderkey', 11)}) WHEN 10 THEN concat('ENSMUSP', {_n('l_orderkey', 11)}, '.1') WHEN 11 THEN concat('P', {_n('l_suppkey', 5)}) ELSE concat('NG_', {_n('l_orderkey')}) END AS acc,
          l_partkey % 13 AS kind, {_n('l_orderkey')} AS six, {_n('l_orderkey', 11)} AS eleven, CAST(l_orderkey AS STRING) AS plain, l_linenumber AS n, {_n('l_suppkey', 5)} AS five
        FROM lineitem"""),
    # an edit on a stored sequence, 0-based half-open [s, e)
    "edits": (["lineitem", "part", "sequences"], f"""
        SELECT l_orderkey * 10 + l_linenumber AS vid, acc, seq, CAST(20 + l_orderkey % 200 AS INT) AS s,
          CAST(20 + l_orderkey % 200 + CASE WHEN l_linenumber % 3 = 1 THEN 0 ELSE 1 + l_suppkey % 4 END AS INT) AS e,
          CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN substr(seq, CAST(21 + l_orderkey % 200 AS INT), CAST(1 + l_partkey % 3 AS INT))
            ELSE substr({_BASES.format("CAST(l_orderkey AS STRING)")}, 1, CAST(1 + l_partkey % 4 AS INT)) END AS payload
        FROM lineitem JOIN sequences ON k = l_partkey"""),
    "transcripts": (["part"], f"""
        SELECT p_partkey AS k, concat(CASE WHEN p_partkey % 7 = 0 THEN 'NR_' WHEN p_partkey % 11 = 0 THEN 'XM_' ELSE 'NM_' END, {_n('CAST(floor(p_partkey / 2) AS BIGINT)')}, '.', CAST(1 + p_partkey % 2 AS STRING)) AS tx,
          p_brand AS gene, {_contig('(1 + p_partkey % 22)')} AS contig, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand,
          1000 + (p_partkey * 7919) % 90000 AS g0, 100 + p_size AS len1, 120 + 2 * p_size AS len2, 150 + p_size AS len3,
          CASE WHEN p_partkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(31 AS BIGINT) END AS cds_start,
          CASE WHEN p_partkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE 30 + 3 * CAST(floor((310 + 4 * p_size) / 3) AS BIGINT) END AS cds_end,
          CASE WHEN p_size = 1 THEN 'select' WHEN p_size = 2 THEN 'plus_clinical' ELSE 'none' END AS mane
        FROM part"""),
    # t0 and t1 in the transcript, g0 and g1 on the contig, all 0-based half-open; number in transcript order
    "exons": (["part", "transcripts"], """
        SELECT tx, contig, strand, 1 AS number, CAST(0 AS BIGINT) AS t0, CAST(len1 AS BIGINT) AS t1, CASE WHEN strand = 1 THEN g0 ELSE g0 + len3 + len2 + 400 END AS x0,
          CASE WHEN strand = 1 THEN g0 + len1 ELSE g0 + len3 + len2 + 400 + len1 END AS x1 FROM transcripts
        UNION ALL SELECT tx, contig, strand, 2, CAST(len1 AS BIGINT), CAST(len1 + len2 AS BIGINT), CASE WHEN strand = 1 THEN g0 + len1 + 200 ELSE g0 + len3 + 200 END,
          CASE WHEN strand = 1 THEN g0 + len1 + 200 + len2 ELSE g0 + len3 + 200 + len2 END FROM transcripts
        UNION ALL SELECT tx, contig, strand, 3, CAST(len1 + len2 AS BIGINT), CAST(len1 + len2 + len3 AS BIGINT), CASE WHEN strand = 1 THEN g0 + len1 + len2 + 400 ELSE g0 END,
          CASE WHEN strand = 1 THEN g0 + len1 + len2 + 400 + len3 ELSE g0 + len3 END FROM transcripts"""),
    # spliced sequences, and edits on them, 0-based half-open
    "tx_seqs": (["part", "transcripts"], f"""
        SELECT tx, x.k, gene, strand, cds_start, cds_end, len1, len2, len3, len1 + len2 + len3 AS len, substr(concat({", ".join(_TRACTS.format(i) for i in range(18))}), 1, CAST(len1 + len2 + len3 AS INT)) AS seq
        FROM transcripts x JOIN part ON p_partkey = x.k"""),
    "tx_edits": (["lineitem", "tx_seqs"], f"""
        SELECT vid, tx, seq, s, e, CASE WHEN edit = 'del' THEN '' WHEN edit = 'dup' THEN concat(substr(seq, s + 1, e - s), substr(seq, s + 1, e - s)) WHEN edit = 'sub' THEN translate(substr(seq, s + 1, 1), 'ACGT', 'CGTA')
          WHEN vid % 2 = 0 THEN substr(seq, s + 1, 2) ELSE substr({_BASES.format("CAST(vid AS STRING)")}, 1, CAST(1 + vid % 4 AS INT)) END AS payload, edit, strand, cds_start, cds_end, len1, len2, len
        FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY tx, e) AS nth FROM (
          SELECT l_orderkey * 10 + l_linenumber AS vid, tx, seq, strand, cds_start, cds_end, len1, len2, len, CAST(20 + (l_orderkey * 7) % 330 AS INT) AS s,
            CAST(20 + (l_orderkey * 7) % 330 + CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1 + l_suppkey % 4 END AS INT) AS e, CASE l_linenumber % 4 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' WHEN 2 THEN 'dup' ELSE 'sub' END AS edit
          FROM lineitem JOIN tx_seqs ON k = l_partkey) x) y WHERE nth = 1"""),
    # points on contigs
    "points": (["lineitem"], f"""
        SELECT l_orderkey * 10 + l_linenumber AS vid, {_contig('(1 + l_suppkey % 22)')} AS contig, 1000 + (l_orderkey * 131 + l_partkey * 17) % 92000 AS g FROM lineitem"""),
    # positions on transcripts: base (no zero), offset into an intron, past the stop or not
    "cpos": (["lineitem", "part", "transcripts"], """
        SELECT l_orderkey * 10 + l_linenumber AS vid, tx, CASE WHEN l_linenumber = 1 THEN -1 - l_orderkey % 30 WHEN l_linenumber = 2 THEN 1 + l_orderkey % 20 ELSE 1 + l_orderkey % 300 END AS base,
          CASE WHEN l_linenumber = 4 THEN 1 + l_suppkey % 40 WHEN l_linenumber = 5 THEN -1 - l_suppkey % 40 ELSE CAST(NULL AS BIGINT) END AS off, l_linenumber = 2 AS utr3
        FROM lineitem JOIN transcripts ON k = l_partkey"""),
    "vcf": (["lineitem"], f"""
        SELECT l_orderkey * 10 + l_linenumber AS vid, {_chrom('l_suppkey % 26')} AS chrom, 100 + l_orderkey * 7 + l_linenumber AS pos,
          concat(substr({_BASES.format("CAST(l_partkey AS STRING)")}, 1, CAST(1 + l_linenumber % 3 AS INT)), substr({_BASES.format("CAST(l_orderkey AS STRING)")}, 1, CAST(l_suppkey % 3 AS INT))) AS ref,
          concat(substr({_BASES.format("CAST(l_partkey AS STRING)")}, 1, CAST(1 + l_linenumber % 2 AS INT)), substr({_BASES.format("CAST(l_suppkey AS STRING)")}, 1, CAST(l_orderkey % 3 AS INT))) AS alt,
          CASE WHEN l_linenumber % 3 = 0 THEN substr({_BASES.format("CAST(l_partkey + 1 AS STRING)")}, 1, 2) ELSE '' END AS alt2,
          CASE WHEN l_returnflag = 'R' THEN 'q10' WHEN l_returnflag = 'A' THEN 'PASS' ELSE '.' END AS filter, CAST(l_quantity AS BIGINT) AS dp
        FROM lineitem"""),
    "rsids": (["orders"], f"""
        SELECT o_orderkey AS rs, {_chrom('o_custkey % 26')} AS chrom, 100 + o_orderkey * 7 + 1 AS pos, substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) AS ref, substr('CGTA', CAST(1 + o_orderkey % 4 AS INT), 1) AS alt FROM orders"""),
    "clinvar": (["orders", "customer"], """
        SELECT o_orderkey AS vcv, o_orderkey AS rs, concat('GENE', CAST(c_nationkey AS STRING)) AS gene,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Pathogenic' WHEN 'BUILDING' THEN 'Likely pathogenic' WHEN 'FURNITURE' THEN 'Uncertain significance' WHEN 'MACHINERY' THEN 'Likely benign' ELSE 'Benign' END AS significance,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'practice guideline' WHEN '2' THEN 'reviewed by expert panel' WHEN '3' THEN 'criteria provided, multiple submitters, no conflicts' WHEN '4' THEN 'criteria provided, single submitter' ELSE 'no assertion criteria provided' END AS review
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    # two chains a contig, of three blocks each with gaps, 0-based half-open
    "chain_blocks": (["nation"], """
        SELECT c.chain, c.score, c.t_name, c.q_name, c.q_strand, c.q_size, c.t_lo, c.t_hi, c.t_lo + b.i * 1000 AS t0, c.t_lo + b.i * 1000 + 900 AS t1, c.q_lo + b.i * 950 AS q0
        FROM (
          SELECT CAST(n_nationkey * 2 AS BIGINT) AS chain, CAST(5000 + n_nationkey * 10 AS BIGINT) AS score, concat('chr', CAST(n_nationkey AS STRING)) AS t_name, concat('chr', CAST(n_nationkey AS STRING)) AS q_name,
            CASE WHEN n_nationkey % 3 = 0 THEN '-' ELSE '+' END AS q_strand, CAST(100000 AS BIGINT) AS q_size, CAST(1000 + n_nationkey * 100 AS BIGINT) AS t_lo, CAST(3900 + n_nationkey * 100 AS BIGINT) AS t_hi, CAST(2000 + n_nationkey * 50 AS BIGINT) AS q_lo FROM nation
          UNION ALL
          SELECT CAST(n_nationkey * 2 + 1 AS BIGINT), CAST(1000 + n_nationkey * 10 AS BIGINT), concat('chr', CAST(n_nationkey AS STRING)), concat('chr', CAST(n_nationkey + 1 AS STRING)),
            '+', CAST(100000 AS BIGINT), CAST(2500 + n_nationkey * 100 AS BIGINT), CAST(5400 + n_nationkey * 100 AS BIGINT), CAST(7000 AS BIGINT) FROM nation
        ) c, (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT 1 UNION ALL SELECT 2) b"""),
    "lifts": (["lineitem"], """
        SELECT l_orderkey * 10 + l_linenumber AS vid, concat('chr', CAST(l_suppkey % 27 AS STRING)) AS contig, 900 + (l_orderkey * 37 + l_partkey * 11) % 7000 AS p1, 1 + l_suppkey % 60 AS len FROM lineitem"""),
    "tool_runs": (["events"], """
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS tool, CAST(floor(event_id / 2) AS BIGINT) AS input, event_type AS category, user_id % 8 AS shard, value > 20 AS ok,
          concat('out', CAST(user_id % 3 AS STRING)) AS output, value AS seconds FROM events"""),
}


def with_tables(*names: str) -> str:
    """WITH ... for a DuckDB query over derived tables."""
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t][1]})" for t in _order(names)) + "\n"


def _order(names) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for n in TABLES[name][0]:
            if n in TABLES:
                add(n)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


#: Session option: into how many tasks the large base tables are dealt, where their files have one row group each, as the
#: test tables have. Unset, tables are read as they lie.
DEAL = "spark.nomenspark.deal"


def _deal(spark: SparkSession, name: str) -> str:
    n = spark.conf.get(DEAL, None) if name in ("lineitem", "orders", "part") else None
    return f"/*+ REPARTITION({int(n)}) */ " if n else ""


#: Derived tables of long computed strings, which Spark reckons at 20 bytes each: it would send the whole table to every task
#: by way of the driver as long as the narrow file behind it is small. They are joined by sorting, whatever the estimate.
LONG = ("sequences",)


def _sorted(sql: str) -> str:
    """The same rows, with joins of long tables as sort-merge joins."""
    for t in LONG:
        sql = sql.replace(f"JOIN {t} ", f"JOIN (SELECT /*+ MERGE */ * FROM {t}) {t} ")
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    chain = _order([name])
    base = dict.fromkeys(b for t in chain for b in TABLES[t][0] if b in BASE)
    parts = [f"{b} AS (SELECT {_deal(spark, b)}* FROM parquet.`{sf_dir}/{b}.parquet`)" for b in base] + [f"{t} AS ({_sorted(TABLES[t][1])})" for t in chain]
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
