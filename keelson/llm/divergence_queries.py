"""Query of the source divergence audit, with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.divergence import divergence
from keelson.llm.registry import query, table

_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select k, lang, source, unnest(terms) as term from d),
keep as (select lang, term, count(*)::hugeint as n from t group by all having count(distinct k) >= 3),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from keep group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from t join keep using (lang, term) group by all),
m as (select lang, source, sum(n)::hugeint as total from c group by all),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(m.total, 0) + v.v) as p,
    1 + 1000000000 * (k.n + 1) // (v.total + v.v) as base
  from g join keep k using (lang) join v using (lang) left join m on m.lang = g.lang and m.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::hugeint as value
  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, ((p - base) * (p - base) // base)::bigint from grid where n > 0 and p > base),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200"""


@query("op13_source_divergence", _SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
