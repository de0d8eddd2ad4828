"""Query of the secret scan. SQL cannot parse the encodings; tests compare it with a brute-force version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.registry import query, table
from keelson.llm.secret_scan import BASE, find_secrets


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(*kinds: str) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(*kinds))


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    digest = F.sha2(joined(of_kind(*BASE)).cast("binary"), 256).alias("base_sha256")
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts, digest, joined(F.col("found")).alias("spans"))
