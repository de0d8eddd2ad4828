"""Query of the quality rules, with its checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.quality import RULES, STOP_WORDS, quality
from keelson.llm.registry import query, table

_SPACE = r"[\x20\x09-\x0D]"


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = []
    for r in RULES:
        parts = ([f"{r.signal} < {r.low}"] if r.low is not None else []) + ([f"{r.signal} > {r.high}"] if r.high is not None else [])
        failed.append(f"(({' or '.join(parts)}) and n_words >= {r.min_words})")
    return rf"""
with t as (select doc_id, row_number() over () as k, coalesce(text, '') as x from documents),
w as (
  select doc_id, k, x, list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda v: v <> '') as words,
         list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) as lines from t),
m as (
  select doc_id, k, len(words) as n_words, words,
         length(regexp_replace(x, '{_SPACE}', '', 'g')) as word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(x, '[^!?]', '', 'g')) as n_marks,
         len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         len(list_filter(lines, lambda v: regexp_matches(v, '^\s*[-*•]'))) as n_bullet_lines,
         len(list_filter(words, lambda v: lower(v) in ({stop}))) as n_stop_words from w),
g as (
  select k, i, count(*) over (partition by k, g) as c from (
    select k, i, array_to_string(list_slice(words, i, i + 4), ' ') as g
    from (select k, words, unnest(range(1, n_words - 3)) as i from m where n_words >= 5))),
r as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from g where c > 1) group by k),
s as (
  select m.*, coalesce(r.n, 0) as n_repeat_words, 100.0 * coalesce(r.n, 0) / greatest(n_words, 1) as repeat_words_pct,
         word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(n_words, 1) as symbols_per_word,
         n_marks / greatest(n_words, 1) as marks_per_word, n_stop_words / greatest(n_words, 1) as stop_word_ratio,
         n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, n_bullet_lines / greatest(n_lines, 1) as bullet_line_ratio
  from m left join r using (k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or {' or '.join(failed)}) as kept
from s"""


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@query("op8_quality_rules", _sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = base_failed()
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )
