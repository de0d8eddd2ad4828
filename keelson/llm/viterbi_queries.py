"""Query of the subword encoding. SQL has no vocabulary: tests compare with a plain search over the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.packing_queries import tokenizer_path
from keelson.llm.registry import query, table
from keelson.llm.viterbi import decode, encode_apart, whole


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a digest of their ids, the best score, and the digest of the text decoded from the ids."""
    path = tokenizer_path("piece_bpe_32k.model")
    short, long = encode_apart(table(spark, sf_dir, "documents"), path)
    back = whole(decode(short, path), decode(long, path))
    return back.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        "score", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
