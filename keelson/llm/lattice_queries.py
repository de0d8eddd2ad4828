"""Query of the language-model scores. SQL cannot sum over segmentations: tests check it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.lattice import score_documents
from keelson.llm.packing_queries import tokenizer_path
from keelson.llm.registry import query, table

FOLDS, HELD_OUT = 7, 2


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return score_documents(table(spark, sf_dir, "documents"), held_out, tokenizer_path("piece_bpe_32k.model"))
