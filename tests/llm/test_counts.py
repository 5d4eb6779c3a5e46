"""Token counts against the compiled library."""

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from nomenspark.llm import q02  # noqa: E402
from nomenspark.llm.token_counts import Merges, count_tokens  # noqa: E402

from .test_tokens import TEXTS, frame  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def test_counts_equal_library(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in count_tokens(frame(spark, TEXTS), PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), t and t[:40]
        assert got[i].n_bytes == len((t or "").encode())


def test_query(spark, sf):
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q02.op2_token_counts(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 512)


def test_batches_and_empty(spark):
    m = Merges(PATH)
    words = ["hello", " world", "aaaa", "x" * 5000]
    assert m.count(words, 4).tolist() == m.count(words).tolist()
    assert m.count([]).tolist() == []
    assert count_tokens(frame(spark, TEXTS).limit(0), PATH).count() == 0
