import re

import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from keelson.llm.quality import RULES, Rule, measure, passing, quality, verdict
from keelson.llm.quality_queries import base_failed


def expected(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_signals(spark):
    rows = [*texts()[:6], *texts()[7:], (90, "# a | b <c>\n# a | b <c>\n\n \n- x"), (91, "a b c d e f a b c d e x y a b c d e")]
    got = measure(documents(spark, rows)).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == expected(r["text"]), r


def test_rules_and_whole_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None), (3, "one two three four the of and in to a b c d e f")])
    judged = verdict(measure(docs), [Rule("few", "n_words", low=10)])
    assert {(r["row"]["doc_id"], r["kept"], tuple(r["reasons"])) for r in judged.collect()} == {(1, False, ("few",)), (2, False, ("few",)), (3, True, ())}
    out = passing(judged, F.col("kept") & ~base_failed())
    assert out.schema == docs.schema and [r["doc_id"] for r in out.collect()] == [3]
    assert passing(quality(docs.limit(0)), F.col("kept")).count() == 0


def test_no_python(spark):
    plan = quality(documents(spark), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("Scan")[0].replace("RoundRobin", "")) or "Exchange RoundRobin" in plan


@pytest.mark.parametrize("signal", [r.signal for r in RULES])
def test_rules_name_signals(spark, signal):
    assert signal in measure(documents(spark, [(1, "x")])).columns
