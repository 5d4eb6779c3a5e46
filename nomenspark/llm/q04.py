"""Query op4_token_files. SQL can't hold the tokenizer; tests compare with the library and read the files back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .token_files import new_folder, read_tokens, write_tokens

END_ID = 2


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), new_folder(spark)
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), out, END_ID)
    back = read_tokens(manifest, out, kind=docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))
