"""Substring dedup: chunk bounds against the plain gear hash, repeated passages against shared word windows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenspark.llm import q08, substring
from nomenspark.llm.common import Scratch


def plain_cuts(raw):
    """The rolling form of the gear hash, byte by byte."""
    out, h, before = [], 0, None
    for i, c in enumerate(raw):
        h = ((h << 1) + int(substring.GEAR[c])) & 0xFFFF
        if h >> 11 == 0:
            if before is None or i + 1 - before > substring.LEAST:
                out.append(i + 1)
            before = i + 1
    bounds = sorted({0, len(raw), *out})
    whole = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        whole += [*range(a + substring.MOST, b, substring.MOST), b]
    return whole


def test_cut_points_equal_the_rolling_hash():
    r = random.Random(1)
    for raw in (b"", b"a", b"a" * 1000, bytes(r.randrange(256) for _ in range(5000)), b"the of and to " * 90):
        assert substring.cut_points(np.frombuffer(raw, np.uint8)).tolist() == plain_cuts(raw)


def test_insertions_move_few_chunks():
    r = random.Random(2)
    raw = bytes(r.randrange(97, 123) for _ in range(4000))
    other = raw[:2000] + b"inserted" + raw[2000:]
    chunks = lambda x: {x[a:b] for a, b in zip([0, *plain_cuts(x)], plain_cuts(x), strict=False)}
    assert len(chunks(raw) - chunks(other)) <= 2


def brute(rows, n):
    """(words that other rows hold too, words that any row holds before) of every row, in windows of n words."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    words, held = [(rows[i][1] or "").encode().split() for i in order], defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    out, before = {}, set()
    for i, w in enumerate(words):
        shared, later = set(), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if len(held[key]) > 1:
                shared |= set(range(k, k + n))
            if key in before:
                later |= set(range(k, k + n))
            before.add(key)
        out[rows[order[i]][0]] = (len(shared), len(later))
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_finds_shared_passages_and_no_others(spark, size):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").collect()]
    got = q08.op8_substring_dedup(spark, f"/root/testdata/sf{size}").collect()
    assert {r.doc_id: (r.repeated_words, r.later_words) for r in got} == brute(rows, 25) and len(got) == len(rows)
    assert any(r.n_shared_chunks and not r.n_spans for r in got)


def test_any_spacing_and_alphabet(spark):
    """Small alphabets, shifted, respaced and cut passages: the chunks drop no window that is shared."""
    r = random.Random(6)
    for letters in ("ab", "abcdefghijklmnop", "\u4e2d\u6587\u00e9a"):
        word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
        pool, rows = [[word() for _ in range(80)] for _ in range(12)], []
        for i in range(150):
            text = []
            for _ in range(r.randrange(1, 4)):
                text += [word() for _ in range(r.randrange(30))]
                p, a = r.choice(pool), r.randrange(50)
                text += p[a : a + r.randrange(10, 80)]
            rows.append((i, "".join(w + r.choice((" ", "\n", "  \t")) for w in text)))
        got = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()
        count = lambda spans: sum(s.words for s in spans)
        assert {x.doc_id: (count(x.spans), count(x.later)) for x in got} == brute(rows, 25)


def test_later_passages_are_removed(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    a, b = (" ".join(word() for _ in range(40)) for _ in range(2))
    own = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(5, f"{own[0]} {a} {own[1]}"), (5, f"{own[2]} {a}"), (None, f"{a} {own[3]} {b} {b}"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("rid", F.lit("clash"))
    got = {(x.doc_id, x.text, x.n_removed) for x in substring.without_repeats(df, Scratch(spark, "test")).collect()}
    assert got == {(5, rows[0][1], 0), (5, f"{own[2]} ", 40), (None, f" {own[3]} {b} ", 80), (7, None, 0), (8, "", 0)}
    assert substring.without_repeats(df.limit(0), Scratch(spark, "test")).count() == 0


def test_planted_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(60)]
    planted = {3 * i for i in range(20)}
    rows = [(i, t[:200] + " " + passage + " " + t[200:]) if i in planted else (i, t) for i, t in rows]
    rows += [(100, None), (101, ""), (102, "x" * 300_000), (None, "null id " + passage), (103, "short line"), (104, "short line")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    got = substring.repeated_spans(df, Scratch(spark, "test")).collect()
    assert len(got) == len(rows)
    assert {x.doc_id for x in got if x.spans} == planted | {None}
    first = [x.doc_id for x in got if any(s.first for s in x.spans)]
    assert first == [0]
    for x in got:
        text = dict(rows)[x.doc_id] or ""
        for s in x.spans:
            inside = text.encode()[s.start : s.end].decode()
            assert len(set(inside.split()) & set(passage.split())) >= 25 and s.end - s.start <= len(passage) + 2 * substring.MOST
    assert substring.repeated_spans(df.limit(0), Scratch(spark, "test")).count() == 0


def test_every_short_passage_is_found_whole(spark):
    """Passages of 51 words of two to four letters, each in two texts, and one that a text repeats within itself."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 5)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(60)]
    rows = [(i, f"A{i} " + " ".join(word() for _ in range(40)) + f" B{i} {passages[i % 60]} C{i} " + " ".join(word() for _ in range(40))) for i in range(120)]
    rows.append((200, f"X {passages[0][::-1]} Y {passages[0][::-1]} Z"))
    got = {x.doc_id: x for x in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()}
    for i, text in rows[:-1]:
        assert [text.encode()[s.start : s.end].decode() for s in got[i].spans] == [passages[i % 60]]
        assert [(s.words, s.first) for s in got[i].spans] == [(51, i < 60)]
        assert not got[i].within
    assert not got[200].spans and [(s.words, s.start) for s in got[200].within] == [(51, rows[-1][1].index("Y") + 2)]
