"""The rule ledger, its policies and ablations against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from nomenspark.llm import q03
from nomenspark.llm.quality_rules import POLICIES, RULES, Rule, ablations, apply_policy, ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(repeated)


def bits(m):
    n, chars, symbols, lines, dup, repeated = m
    fails = (n < 50, 100 * repeated > 50 * n, symbols > n, n > 0 and 100 * dup > 60 * lines, n > 0 and not 2 * n <= chars <= 40 * n, n > 100_000)
    return sum(f << i for i, f in enumerate(fails))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    some = lambda n, of: " ".join(r.choice(of) for _ in range(n))
    return [
        None, "", " \n\t\r\x0b\x0c ", "a", "a b", "a b c", "a b c d", "a b c a b c", "x x x x x x", "same", "same", "one\n\n one\none\n", "\u00a0 \u2003 \u00e9\U0001f600", "## * $$ % & | < >",
        some(60, ["word", "other", "third", "more"]), some(200, [f"w{i}" for i in range(500)]), "\n".join(["a line of its own"] * 30), some(60, ["q"]), some(55, ["y" * 50, "z" * 60]),
        some(120_000, [f"v{i}" for i in range(3000)]), "k" * 300_000,
    ] + [some(r.randrange(1, 90), list("abcdefgh")) for _ in range(40)]


@pytest.fixture(scope="module")
def book(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_words", "failed_bits", "kept", "col", "_words")})
    return ledger(df)


def test_measurements_and_bits(book, texts):
    got = {r.doc_id: r for r in book.collect()}
    assert len(got) == len(texts) and book.columns == ["doc_id", *(c for c in book.columns if c in MEASURES), "failed_bits"]
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in MEASURES) == measure(t), (t or "")[:40]
        assert got[i].failed_bits == bits(measure(t))
    assert {b for i in got for b in range(6) if got[i].failed_bits >> b & 1} == set(range(6))  # every rule fires


@pytest.mark.parametrize("policy", POLICIES)
def test_policies_and_ablations(book, texts, policy):
    mask, every = POLICIES[policy], [bits(measure(t)) for t in texts]
    kept = {r.doc_id for r in apply_policy(book, policy).where("kept").collect()}
    assert kept == {i for i, b in enumerate(every) if not b & mask}
    got = {r.rule: (r.bit, r.n_failed, r.n_only, r.failed_with) for r in ablations(book, policy).collect()}
    want = {}
    for rule in RULES:
        if mask >> rule.bit & 1:
            hit = [b & mask for b in every if b >> rule.bit & 1]
            together = 0
            for b in hit:
                together |= b
            want[rule.name] = (rule.bit, len(hit), sum(b == 1 << rule.bit for b in hit), together)
    assert got == want
    # what an ablation says is what the policy without the rule keeps more
    for rule in RULES:
        if mask >> rule.bit & 1:
            more = apply_policy(book, "less", {"less": mask & ~(1 << rule.bit)}).where("kept").count()
            assert more == len(kept) + want[rule.name][2]


def test_empty_table_and_wrong_rules(spark, book):
    empty = ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == book.columns
    assert ablations(empty).count() == 0
    with pytest.raises(ValueError):
        ledger(empty.selectExpr("doc_id", "'' text"), rules=(Rule(1, "a", "true"), Rule(1, "b", "true")))


def test_a_filter_measures_once_and_plan_is_native(book):
    plan = apply_policy(book).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("([^") == 1 and "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q03.op3_quality_rules(spark, sf).collect():
        m = measure(docs[r.doc_id])
        assert tuple(r[c] for c in MEASURES) == m and r.failed_bits == bits(m)
        assert r.base_failed == bool(bits(m) & 3) and r.kept == (not bits(m) & 31)
