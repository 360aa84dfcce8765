"""op3: pack all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import packing

NAME = "op3_pack_sequences"
TOKENIZER = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Token ids are beyond SQL; the tests hold the query against a brute-force version.
ORACLE_SQL = None
