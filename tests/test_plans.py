"""Plans that must not send a table through the driver, whatever its files measure, and rows that the smallest tables lack."""

import duckdb
import pytest

from nomenspark import corpus, plans

#: Queries that join line items with long sequences.
JOINED = ["e9_spdi_types", "c15_parse_spdi", "q5_edit_to_record", "r7_context_changes", "l7_chance", "m2_genomic_window", "m4_needs_change", "m0_canonical_description", "m0_canonical_keeps_the_sequence", "m11_inverted_copies", "m14_stated_bases", "m18_on_own_reference", "m1_shift", "m8_canonical_edit", "m9_decomposition", "n1_from_windows", "n2_trim_window", "n4_extracted", "o3_with_reference", "o4_apply", "o5_canonical_spdi", "o6_same_sequence", "p2_denotations", "k3_windows"]


@pytest.mark.parametrize("name", JOINED)
def test_sequences_are_not_broadcast(spark, sf, name):
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_long_tables_are_joined_by_name():
    """The hint goes by the text of a join: each derived table that reads a long one has it."""
    for name, (reads, sql) in corpus.TABLES.items():
        assert (corpus._sorted(sql) != sql) == any(t in corpus.LONG for t in reads), name


def test_spdi_of_the_part_numbered_like_the_mitochondrion(spark, tmp_path):
    name = "o3_spdi_to_description"
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT 12920::BIGINT + i AS p_partkey, 7 AS p_size FROM range(2) r(i)")
    con.execute("CREATE TABLE lineitem AS SELECT 40::BIGINT + i AS l_orderkey, 12920::BIGINT + i % 2 AS l_partkey, i AS l_suppkey, (1 + i % 7)::INT AS l_linenumber FROM range(14) r(i)")
    for table in ("part", "lineitem"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).select("vid", "description").collect()))
    want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
    assert got == want and any(d.startswith("NC_012920.") for _, d in got)


def test_windows_of_parts_that_share_an_accession(spark, tmp_path):
    """Numbers of seven digits are cut to six, so ten parts have one accession and each its own sequence."""
    name = "k3_windows"
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT 1000000::BIGINT + i % 3 AS p_partkey, 7 AS p_size FROM range(4) r(i)")
    con.execute("CREATE TABLE lineitem AS SELECT 40::BIGINT + i AS l_orderkey, 1000000::BIGINT + i % 3 AS l_partkey, i AS l_suppkey, (1 + i % 7)::INT AS l_linenumber FROM range(21) r(i)")
    for table in ("part", "lineitem"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).select("vid", "acc", "s", "e", "bases").collect()))
    want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
    assert got == want and len({acc for _, acc, *_ in got}) == 1 and len({bases for *_, bases in got}) > 3
