"""MinHash near-dedup against all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nomenspark.llm import minhash, q09
from nomenspark.llm.common import Scratch

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = [w.decode() for w in (text or "").translate(LOWER).encode().split()]
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """Component of every document over an inverted index of all shingles."""
    sets = [shingles(t, k) for _, t in rows]
    index, up = defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in index[x]:
                both[j] += 1
            index[x].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}  # (doc_id is null, doc_id, row) of each component's first row
    for i, (d, _) in enumerate(rows):
        own = (d is None, d or 0, i)
        low[root(i)] = min(low.get(root(i), own), own)
    least = [None if low[root(i)][0] else low[root(i)][1] for i in range(len(rows))]
    return sorted(((d, len(sets[i]), least[i], least[i] == d, low[root(i)][2] == i) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept", "first").collect()), key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_equals_all_pairs(spark, size):
    d = f"/root/testdata/sf{size}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in q09.op9_minhash(spark, d).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted((x[:4] for x in brute(rows, 4, 80)), key=str)


def test_chains_blocks_and_copies(spark, monkeypatch):
    """A large group of near copies over several blocks, chains, exact copies, and texts that are less alike."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, base = [], [r.choice(vocabulary) for _ in range(120)]
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(120)] = r.choice(vocabulary)
        rows.append((i * 3, " ".join(words)))
    chain = [r.choice(vocabulary) for _ in range(100)]
    for i in range(20):
        chain = chain[2:] + [r.choice(vocabulary) for _ in range(2)]
        rows.append((1000 - i, " ".join(chain).upper()))
    rows += [(2000 + i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(30)]
    rows += [(3000 + i, "Short Text") for i in range(25)] + [(3100, "short\ttext"), (3200, None), (3201, ""), (3202, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))
    got = minhash.near_duplicates(df, Scratch(spark, "test"), 5, 80)
    assert rows_of(got) == brute(rows, 5, 80)


def test_rows_that_share_a_doc_id_or_have_none(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [
        (3, a), (5, a), (5, b), (7, b + " more"), (9, "a b"), (9, "a b"), (None, "A B"), (None, "x y"), (None, "x y"), (11, None), (11, None), (12, ""),
        (8, " ".join(f"long{i % 7919}x{i}" for i in range(60000))), (4, " ".join(f"long{i % 7919}x{i}" for i in range(60000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "rid", "first", "m")})
    got = minhash.near_duplicates(df.coalesce(1), Scratch(spark, "test"))
    want = brute(rows, 5, 80)
    # which of the repeated rows is first depends on the table's order, how many are does not
    drop = lambda found: sorted((x[:4] for x in found), key=str)
    assert drop(rows_of(got)) == drop(want)
    stay = lambda found: sorted((x[:3] for x in found if x[4]), key=str)
    assert stay(rows_of(got)) == stay(want)
    assert minhash.near_duplicates(df.limit(0), Scratch(spark, "test")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just at 0.8 are linked: 400 pairs of one shared part and two parts of their own."""
    rows = []
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(200)]
        other = words[:-22] + [f"q{i}w{j}" for j in range(22)]  # 174 of 218 shingles of 5 shared: 0.798; of 1 word less: 0.8 or more
        other[len(words) - 22] = words[-22]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute(rows, 5, 80)
    assert sum(not x[3] for x in want) == 400
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test"), 5, 80)) == want
