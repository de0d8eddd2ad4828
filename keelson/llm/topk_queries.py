"""Query of the exact top-k search, with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.registry import query, table
from keelson.llm.topk import top_k

_SQL = """
with v as (select vec_id, row_number() over () as k, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 100 = 0),
s as (select q.k, q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::bigint as score
  from q join v on q.k <> v.k and len(q.v) = len(v.v)),
r as (select *, row_number() over (partition by k order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10"""


@query("op2_exact_topk", _SQL)
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
