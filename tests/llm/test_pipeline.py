"""Every stage of the pipeline against a plain version, on its own input."""

import hashlib
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from nomenspark.llm.bpe import load_ranks  # noqa: E402
from nomenspark.llm.common import Scratch  # noqa: E402
from nomenspark.llm.mixing import by_weights  # noqa: E402
from nomenspark.llm.secret_scan import base_findings, findings_of, mask, trained  # noqa: E402

from .test_minhash import brute as near_brute  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_rules(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    return not (
        len(words) < 50 or 100 * len(repeated) > 50 * len(words) or len(re.findall(r"[#*$%&|<>]", text)) > len(words)
        or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or chars < 2 * len(words) or chars > 40 * len(words)
    )


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage and its output, as lists of rows."""
    scratch, d = Scratch(spark, "test"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.lit("extra") for c in ("kept", "cid", "ids", "copies", "row", "findings", "size")})
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, d), "stage")
        out.append(docs.collect())
    return out


def test_columns(steps):
    assert all(r[0].__fields__ == steps[0][0].__fields__ for r in steps[:-1])
    assert len(pipeline.STAGES) == 5 and all(r.kept == "extra" for rows in steps[:-1] for r in rows)


def test_quality(steps):
    assert sorted(r.doc_id for r in steps[1]) == sorted(r.doc_id for r in steps[0] if kept_by_rules(r.text))


def test_near_dedup(steps):
    want = [x[0] for x in near_brute([(r.doc_id, r.text) for r in steps[1]], 5, 80) if x[4]]
    assert sorted(r.doc_id for r in steps[2]) == sorted(want)


def test_near_dedup_judges_rows_not_doc_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (1, c), (1, c), (None, c), (None, "alone " + a[:90]), (None, None)]
    docs = Scratch(spark, "test").table(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")), "docs")
    left = pipeline.near_dedup(spark, docs, None)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, a), (5, b), (1, c), (None, "alone " + a[:90]), (None, None)], key=str)


def test_secrets(steps):
    before = {r.doc_id: r.text for r in steps[2]}
    for r in steps[3]:
        (found,) = findings_of([before[r.doc_id]], trained())
        assert r.text == mask(before[r.doc_id], [(a, b) for a, _, b, _ in found], "[SECRET]")
        assert r.n_chars == len(r.text) and not base_findings(r.text)
    assert len(steps[3]) == len(steps[2])


def test_mixing(steps):
    size = {r.doc_id: len(WORD.findall(r.text)) for r in steps[3]}
    by, taken = Counter(), Counter()
    for r in steps[3]:
        by[r.source] += size[r.doc_id]
    for r in steps[4]:
        taken[r.source] += size[r.doc_id]
    wanted = by_weights()(by, sum(by.values()))
    assert all(abs(taken[s] - wanted[s]) <= max(size.values()) for s in by)
    assert max(Counter(r.doc_id for r in steps[4]).values()) <= 3


def test_encoding(steps):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in steps[4]}
    assert Counter(r.doc_id for r in steps[5]) == Counter(r.doc_id for r in steps[4])
    for r in steps[5]:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_hard_rows(spark, tmp_path, steps):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[5])
    long = " ".join(f"word{i % 977}x{i}" for i in range(30000))
    rows = [(None, "en", None), (1, None, "a"), (2, "", "a"), (3, long, None), (3, long, None), (4, long, "b"), (None, long, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "null as lang", "cast(null as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {3, None} and out
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
