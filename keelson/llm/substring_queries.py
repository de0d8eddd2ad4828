"""Queries of the two substring operators, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.registry import query, table
from keelson.llm.suffixes import repeated_bytes
from keelson.llm.substrings import repeated_substrings

_OP4 = r"""
with w as (select doc_id, row_number() over () as k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') as words from documents),
g as (select k, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) as m from (select k, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)),
d as (select k, i from (select k, i, count(*) over (partition by m) as c from g) where c > 1),
r as (select distinct k, p from (select k, unnest(range(i, i + 35)) as p from d)),
s as (select k, list(p) as gone from r group by k),
o as (select doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed,
  case when gone is null then words else list_filter(words, lambda v, i: not list_contains(gone, i)) end as kept from w left join s using (k))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from o"""


@query("op4_substring_dedup", _OP4)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
