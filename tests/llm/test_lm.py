"""Stupid-backoff scores against plain dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenspark.llm import lm_scores, q07
from nomenspark.llm.lm_scores import bounds, count_table, distinct_grams, pack, score, unpack


def brute(rows, order):
    words = [[w.decode() for w in (t or "").encode().translate(lm_scores.LOWER).split()] for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total, n_all, out = sum((grams(w) for w in words), Counter()), sum(map(len, words)), []
    for (key, _), w in zip(rows, words, strict=True):
        own, log, top = grams(w), 0.0, 0
        c = lambda g: total[g] - own[g]  # noqa: E731, B023
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    log += math.log(factor * max(c(g), 1) / max(n_all - len(w), 1))
                elif c(g) > 0:
                    log += math.log(factor * c(g) / c(g[:-1]))
                if c(g) > 0:
                    top += n == order
                    break
                factor *= lm_scores.BACKOFF
        out.append((key, len(w), top, pytest.approx(log, abs=1e-6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    r = random.Random(order)
    rows = [(i, " ".join(r.choice("a b c the of and x y z".split()) for _ in range(r.randrange(60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "Unseen WORDS only here"), (103, "the the the the"), (103, "the the the the"), (104, "x " * 30000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, slice int")
    got = {}
    for x in score(df, order).collect():
        got.setdefault(x.doc_id, []).append((x.doc_id, x.n_words, x.n_top, x.log_score))
        assert (x.mean_log is None) == (x.n_words == 0)
    want = brute(rows, order)
    assert sum(map(len, got.values())) == len(want)
    for w in want:
        assert w in got[w[0]]


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [x.n_words for x in score(df).collect()] == [2, 2]
    assert score(df.limit(0)).count() == 0


def test_count_table(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "A B")], "slice long, text string").withColumn("key", F.lit(1))
    got = count_table(distinct_grams(df.repartition(2, "slice"), 2, 3)).collect()
    assert sorted((x.n, x.total) for x in got) == [(1, 2), (1, 3), (2, 1), (2, 2)]
    cuts = bounds(3)
    assert all(x.part == np.searchsorted(cuts, np.uint64(x.key % (1 << 64)), side="right") for x in got)


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 64, 1000, np.uint64))
    assert (unpack(pack(keys)) == keys).all() and len(unpack(pack(keys[:0]))) == 0


def test_texts_are_dealt_once(spark, sf):
    """Both readings of the slices use one exchange."""
    plan = score(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_registered_trigrams_see_shuffled_text(spark, sf):
    """The query equals the plain version on the tables, reads its texts once, and goes below a chain of common
    pairs where no trigram of it occurs, which bigrams cannot tell."""
    from nomenspark.llm.queries import queries

    df = queries()["op7_lm_scores"](spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(x.doc_id, x.n_words, x.n_top): x.log_score for x in df.collect()}
    for key, n, top, log in brute(rows, 3):
        assert abs(got[key, n, top] - log.expected) < 0.001
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    pairs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b q", "r b c", "s b q", "t b c", "a b u", "a b c"])], "doc_id long, text string")
    at = lambda order: {x.doc_id: x.n_top for x in score(pairs, order).collect()}
    assert at(2)[5] == 2 and at(3)[5] == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, size):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{size}/documents.parquet'")
    out = con.execute(q07.SQL)
    columns = [c[0] for c in out.description]
    got = q07.op7_lm_scores(spark, f"/root/testdata/sf{size}").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(out.fetchall(), key=repr)
