"""Query of the Jaccard join, with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.jaccard import similar
from keelson.llm.registry import query, table

_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') as words from documents),
g as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
      else list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
b as (select x, y from e union all select y, x from e),
r(doc_id, seen) as (select doc_id, doc_id from w union select r.doc_id, b.y from r join b on b.x = r.seen)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.seen) as component_id
from w join r using (doc_id) left join n using (doc_id) group by w.doc_id, n.n"""


@query("op9_jaccard_join", _SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
