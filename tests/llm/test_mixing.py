"""Mixing against the contract's arithmetic and a brute-force flow."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from nomenspark.llm import q05
from nomenspark.llm.common import Scratch
from nomenspark.llm.mixing import by_weights, make_plan, route, rows_of, take, water_fill


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q05.op5_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    by = {}
    for i, r in docs.items():
        by[r.source] = by.get(r.source, 0) + size[i]
    wanted, taken = by_weights()(by, sum(by.values())), {}
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], by[s], pytest.approx(wanted[s]))
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] = taken.get(s, 0) + r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - wanted[s]) <= largest for s in by)
    assert sum(wanted.values()) == pytest.approx(sum(by.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, q05.op5_mixing(spark, sf).collect()))


def test_water_fill():
    got = water_fill({"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 2, None: 3}, 1015, 3)
    assert got["a"] == 30 and got[None] == 15 and got["b"] == pytest.approx(970)
    assert water_fill({}, {}, 0, 3) == {}
    assert water_fill({"a": 0, "b": 4}, {"a": 1, "b": 2}, 4, 3) == {"a": 0, "b": 4}


def test_route_is_cheapest():
    patterns = {json.dumps(p): n for p, n in ((["a"], 3), (["a", "b"], 2), (["b"], 1))}
    quotas = {"a": 4, "b": 5}
    got = route(patterns, quotas, 3)
    assert sum(got.values()) == 9
    cost = lambda f, n: sum(max(0, min(f - k * n, n)) * k for k in range(3))
    best = min(
        cost(a, 3) + cost(ab1 + ab2, 2) + cost(b, 1)
        for a, ab1, ab2, b in itertools.product(range(10), range(7), range(7), range(4))
        if a + ab1 == 4 and ab2 + b == 5 and a <= 9 and ab1 + ab2 <= 6 and b <= 3
    )
    assert sum(cost(got[p], n) for p, n in patterns.items()) == best


def test_plain_sources_need_no_network():
    """Thousands of sources at once, and the same amounts as by the flow where some overlap."""
    many = {json.dumps([f"s{i}"]): i + 1 for i in range(5000)}
    got = route(many, {f"s{i}": 2 * i for i in range(5000)}, 3)
    assert all(got[json.dumps([f"s{i}"])] == min(2 * i, 3 * (i + 1)) for i in range(5000))
    both = {json.dumps(p): n for p, n in ((["a"], 5), (["b", "c"], 4), ([], 9), ([None], 2))}
    assert route(both, {"a": 20, "b": 3, "c": 9, None: 1}, 3) == {'["a"]': 15, '["b", "c"]': 12, "[]": 0, "[null]": 1}


def test_overlapping_sources_over_the_table(spark):
    """Documents that belong to their source and to their language: the flow routes each pattern, within its documents'
    three copies, and fills every quota that the overlap lets it fill, at the least cost in repeats."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = rows_of(docs.select("doc_id", "text", "source", "lang"), F.array(F.col("source"), F.concat(F.lit("lang-"), F.col("lang"))), "doc_id", 3)
    plan = make_plan(made, Scratch(spark, "test"))
    got, wanted = take(made, plan).collect(), {r.source: r.target for r in plan.sources.collect()}
    assert len(got) == docs.count() and all(0 <= r.copies <= 3 for r in got)
    size, given = {}, {}
    for r in got:
        size[r._pattern] = size.get(r._pattern, 0) + r._size
        given[r._pattern] = given.get(r._pattern, 0) + r.copies * r._size
    assert sum(len(json.loads(p)) > 1 for p in size) > 4
    exact = route(size, {s: round(t) for s, t in wanted.items()}, 3)
    largest = max(r._size for r in got)
    assert all(abs(given[p] - exact[p]) <= largest for p in size)
    # a max flow: no pattern with room left touches a source with quota left, along any chain of patterns
    pulp = sum(exact.values())
    cuts = []
    for n in range(len(wanted) + 1):
        for chosen in itertools.combinations(sorted(wanted, key=str), n) if len(wanted) <= 12 else ():
            inside = set(chosen)
            cuts.append(sum(round(t) for s, t in wanted.items() if s not in inside) + sum(3 * n for p, n in size.items() if inside & set(json.loads(p))))
    assert not cuts or pulp == min(cuts)


def test_edges(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "one two", None), (4, "a b c", "y"), (4, "a b c", "y"), (None, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("full", F.lit("clash"))
    for frame in (df, df.limit(0)):
        made = rows_of(frame.select("doc_id", "text", "source"), F.array("source"), "doc_id", 1)
        got = take(made, make_plan(made, Scratch(spark, "test"))).collect()
        assert len(got) == frame.count() and all(0 <= r.copies <= 3 for r in got)
    over = df.select("doc_id", "text", F.when(F.col("doc_id") > 2, F.array(F.lit("x"), F.lit("y"))).alias("s"))
    made = rows_of(over, F.col("s"), "doc_id", 1)
    got = take(made, make_plan(made, Scratch(spark, "test"))).collect()
    assert all(r.copies == 0 for r in got if r.s is None) and sum(r.copies * r._size for r in got) == 8
