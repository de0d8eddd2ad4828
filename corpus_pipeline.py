"""A corpus from raw documents: quality rules, toxicity, near duplicates, repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of their input. Null texts are empty and fall to the quality rules; repeated rows fall
to the near-duplicate stage; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.jaccard import Similar, one_of_each
from keelson.llm.packing import pack
from keelson.llm.packing_queries import tokenizer_path
from keelson.llm.quality import passing, quality
from keelson.llm.quality_queries import base_failed
from keelson.llm.store import kept
from keelson.llm.substrings import repeated_substrings
from keelson.llm.toxicity import classify
from keelson.llm.toxicity_queries import THRESHOLD, fitted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return passing(quality(docs), F.col("kept") & ~base_failed())


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fit on the labelled documents, calls toxic go."""
    # the chain names its results p_<category>; columns of the input that begin so step aside
    aside = {c: f"_aside_{c}" for c in docs.columns if c.startswith("p_")}
    judged = classify(docs.withColumnsRenamed(aside), fitted(spark, sf_dir))
    return judged.where(F.col("p_toxic") < THRESHOLD).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 of five-word shingles."""
    return one_of_each(docs, Similar(shingle=5, num=80, den=100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur twice are cut out of all texts; ``n_chars`` follows the text."""
    out = repeated_substrings(docs, separator=None, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 4096 tokens."""
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL can neither fit the classifiers nor run the tokenizer; tests check each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
