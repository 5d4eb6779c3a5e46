"""Round trip of the token files."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from nomenspark.llm import q04  # noqa: E402
from nomenspark.llm.token_files import new_folder, read_tokens, write_tokens  # noqa: E402

from .test_tokens import TEXTS  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def expected(rows, library):
    out, start = [], 0
    for key, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf):
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in q04.op4_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(docs, library)


def test_edges(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = [(len(TEXTS) - i, t, 5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    back = read_tokens(write_tokens(df, PATH, out := new_folder(spark), 2), out)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.raw))) for r in back.collect())
    assert got == expected([(a, b) for a, b, _ in rows], library)


def test_null_and_repeated_keys_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, "d"), (None, None)], "doc_id long, text string")
    back = read_tokens(write_tokens(df, PATH, out := new_folder(spark), 2), out).collect()
    assert sorted(r.n_tokens for r in back) == [1, 2, 2, 3, 3]
    ends = sorted((r.start, r.start + r.n_tokens) for r in back)
    assert [b for _, b in ends[:-1]] == [a for a, _ in ends[1:]] and ends[0][0] == 0
    assert all(r.doc_id is None for r in back if r.start < ends[2][0])
    assert read_tokens(write_tokens(df.limit(0), PATH, out := new_folder(spark), 2), out).count() == 0
