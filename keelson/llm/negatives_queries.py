"""Query of the hard-negative mining, with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.negatives import hard_negatives
from keelson.llm.registry import query, table

_SQL = """
with v as (select vec_id, row_number() over () as k, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::hugeint) as v
  from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.k, a.vec_id as anchor_id, c.k as ck, c.vec_id, a.label = c.label as same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::hugeint as score
  from v a join v c on a.k <> c.k and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by k order by score desc, vec_id nulls last, ck) as near from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.k, p.ck order by s.score desc, s.vec_id nulls last, s.ck) as rank
  from p join s on p.k = s.k and p.near <= 5 and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score::bigint as positive_score, negative_score::bigint as negative_score
from n where rank <= 10"""


@query("op12_hard_negatives", _SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
