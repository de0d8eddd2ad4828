"""Query of the toxicity chain. SQL cannot fit it: tests measure its accuracy on labelled rows it has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.registry import query, table
from keelson.llm.text import release
from keelson.llm.toxicity import Chain, classify, train

THRESHOLD = 0.5


def fitted(spark: SparkSession, sf_dir: str) -> Chain:
    """The chain junk, toxic, fit on the labelled rows of ``documents``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ["junk", "toxic"])
    release()  # the driver lives on, and would keep the most that fitting held
    return chain


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = classify(docs, fitted(spark, sf_dir))
    return judged.select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
