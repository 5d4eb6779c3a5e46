"""Encoding and counting against the compiled tokenizer libraries."""

import hashlib
import random
import time

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from nomenspark.llm import bpe, q01, token_counts, windows  # noqa: E402
from nomenspark.llm.pretokenize import Cutter  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "  \n\t ", "It's we'll   x", "a" * 3000, "ab" * 700, "été naïve ñandú größe", "\U0001f600\U0001f468‍\U0001f469",
    "<|endoftext|>", "x<|endoftext|>y", "0123456789" * 20, "a͸b֌c࢏d", "\x00\x1c\x85 　z", "same", "same",
    "".join(random.Random(1).choice("abcdefgh") for _ in range(2000)), "=" * 500 + "-" * 333,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")


def test_encode_equals_library_and_decodes(spark, library):
    got = {r.doc_id: r for r in bpe.encode(frame(spark, TEXTS), RANKS, P.PATTERN, decoded=True).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == library.encode_ordinary(t or ""), t and t[:40]
        assert bytes(got[i].decoded) == (t or "").encode()


def test_decode_operator(spark, library):
    rows = [(1, library.encode_ordinary("héllo wörld")), (2, []), (3, None)]
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS, P.PATTERN).collect()}
    assert got == {1: "héllo wörld".encode(), 2: b"", 3: b""}


def test_empty_table(spark):
    assert bpe.encode(frame(spark, TEXTS).limit(0), RANKS, P.PATTERN, decoded=True).count() == 0


def test_query_digests(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q01.op1_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_cutter_follows_the_library_on_every_code_point():
    from tokenizers import pre_tokenizers

    split, cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), Cutter(P.PATTERN)
    for i in range(0, 0x110000, 7):
        if not 0xD800 <= i < 0xE000:
            x = f"a{chr(i)}1{chr(i)} {chr(i)}.{chr(i)} b"
            assert cut(x) == [x[a:b] for _, (a, b) in split.pre_tokenize_str(x)], hex(i)


def test_windows_pieces_and_whole_words_agree(monkeypatch):
    """One word contracted whole, in small windows, and by ranks at once."""
    r, model, merges = random.Random(8), bpe.Bpe(RANKS), token_counts.Merges(P.path("byte_bpe_50k.json"))
    words = ["aaaaaaa", "abababab", "internationalisation", "z" * 70, "mississippi" * 9, "\u4e2d\u6587" * 30, "\u00e9t\u00e9" * 40]
    words += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 150))) for alphabet in ("ab", "aeinorst", "0123456789", "=-", "\u3042\u3044\u30f3a") for _ in range(60)]
    whole = [model._contract([w.encode()])[0].tolist() for w in words]
    for window, stride, most in ((64, 32, 512), (8, 4, 512), (16, 8, 20), (64, 32, 0)):
        for name, value in (("WINDOW", window), ("STRIDE", stride), ("MOST", most)):
            monkeypatch.setattr(windows, name, value)
        model.pieces.clear(), merges.pieces.clear()
        flat, lens = model.encode_words(words)
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == whole
        assert merges.count(words).tolist() == list(map(len, whole))


SCRIPTS = {
    "han": (0x4E00, 0x9FA5), "thai": (0xE01, 0xE3A), "kana": (0x3041, 0x30FE), "hangul": (0xAC00, 0xD7A3), "cyrillic": (0x410, 0x450), "emoji": (0x1F600, 0x1F640), "latin": (97, 123),
}


def test_very_long_texts_of_any_script(spark, library):
    """Texts of a megabyte and less without spaces, equal to the library and in time that grows with their length."""
    r = random.Random(9)
    texts = ["".join(chr(r.randrange(*SCRIPTS[k])) for _ in range(60_000)) for k in SCRIPTS]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), " ".join(f"w{i * 7919 % 104729}" for i in range(150_000)), "ab " * 300_000]
    got = {row.doc_id: row for row in bpe.encode(frame(spark, texts), RANKS, P.PATTERN, decoded=True).collect()}
    counted = {row.doc_id: row.n_tokens for row in token_counts.count_tokens(frame(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        assert bytes(got[i].decoded) == t.encode() and len(got[i].ids) == counted[i]
        if i != len(SCRIPTS):  # the library takes minutes for a word of a megabyte
            assert got[i].ids == library.encode_ordinary(t)


def test_time_is_linear_without_spaces():
    r, model = random.Random(10), bpe.Bpe(RANKS)
    model.encode_words(["warm"])
    took = []
    for n in (50_000, 400_000):
        model.pieces.clear()
        word, start = "".join(r.choice("acgt") for _ in range(n)), time.process_time()
        model.encode_words([word])
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]  # 8 times the length


def test_latin_pattern_gives_the_same_pieces():
    r = random.Random(5)
    cut = Cutter(P.PATTERN)
    for _ in range(3000):
        x = "".join(chr(r.randrange(256)) if r.random() < 0.5 else r.choice(" 'strevmld1\n") for _ in range(20))
        assert cut.latin(x) == cut.find(x)
