"""Training corpus pipeline: quality rules, near-dedup, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet and reads it back as the
next one's docs. All but the last return the columns of their input, so that columns beyond the documented doc_id, text,
lang, source and n_chars ride along; a stage's own columns never meet them, whatever they are called.

1. quality rules: documents that the default policy of the rule ledger rejects go. Those with a null or empty text have
   no words and go here.
2. MinHash near-dedup: of each group of documents linked by a similarity of 0.8 or more of their five-word shingles, the
   one with the smallest doc_id stays. Rows are judged and removed one by one, by numbers of their own: of repeated rows
   one stays, and rows that share a doc_id, or have none, stand and fall by their own texts.
3. secret scans: findings are masked in the text, and n_chars follows it. All documents stay.
4. mixing sources to target weights: sources weigh 1, 2, 3, repeating; a document that the mix takes k times becomes k
   rows, one that it does not take goes.
5. byte-level BPE encoding: doc_id, source, ids, and as a check of the decoding the digest of the decoded bytes.
"""

import public_tokenizers
from pyspark.sql import functions as F

from nomenspark.llm.bpe import encode
from nomenspark.llm.common import Scratch, read
from nomenspark.llm.minhash import near_duplicates
from nomenspark.llm.mixing import make_plan, rows_of, take
from nomenspark.llm.quality_rules import apply_policy, ledger
from nomenspark.llm.secret_scan import redact, trained

SEED = 20260101


def quality(spark, docs, sf_dir):
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    return apply_policy(ledger(whole, keep=("doc",))).where("kept").select("doc.*")


def near_dedup(spark, docs, sf_dir):
    scratch = Scratch(spark, "pipeline-minhash")
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    judged = near_duplicates(rows.select("row", "doc.doc_id", "doc.text"), scratch, row="row")
    stay = judged.where("first").select("row")
    return rows.join(stay.hint("merge"), "row", "left_semi").select("doc.*")


def secrets(spark, docs, sf_dir):
    return redact(docs, trained())


def mixing(spark, docs, sf_dir):
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", "text")
    rows = rows_of(whole, F.array(F.col("source").cast("string")), "doc_id", SEED)
    taken = take(rows, make_plan(rows, Scratch(spark, "pipeline-mixing"))).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def encoding(spark, docs, sf_dir):
    key = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    coded = encode(key, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key="key", decoded=True)
    return coded.select(
        F.col("key.doc_id").alias("doc_id"), F.col("key.source").alias("source"), F.size("ids").cast("long").alias("n_tokens"),
        "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding", encoding),
]
#: The network, the routing and the merges are no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
