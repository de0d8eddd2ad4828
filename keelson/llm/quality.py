"""Quality rules: a threshold table compiled into plain Spark columns, no user functions.

``measure`` adds the signals of each text, ``verdict`` compiles a table of ``Rule`` rows into one boolean column and one
column with the names of the broken rules. Every step is a projection of the row it reads: no shuffle, no Python.

Words are runs of characters other than the space and U+0009 to U+000D. A null or empty text has no words: all counts
are 0, every ratio is 0, and it fails the word count. Rows are judged alone, so repeated rows get equal verdicts and an
empty table gives an empty result. Only ``text`` is read; other columns are in ``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent short words; one list for all languages, as a text is not asked for its language.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an "
    "de la que el en y los se del las un por con no una su al es lo "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le et les des est une dans qui pour pas sur au il elle plus ce ne"
).split()


@dataclass(frozen=True)
class Rule:
    """``signal`` must lie in [low, high] for texts of at least ``min_words`` words."""

    name: str
    signal: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The verdict's thresholds. Signals are columns of ``measure``.
RULES = (
    Rule("few words", "n_words", low=10),
    Rule("repeated windows", "repeat_words_pct", high=20.0),
    Rule("word length", "mean_word_chars", low=1.5, high=20.0),
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("shouting", "marks_per_word", high=0.5),
    Rule("stop words", "stop_word_ratio", low=0.02, min_words=50),
    Rule("repeated lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9, min_words=50),
)


def _count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """``row``, the columns of ``docs`` as they are, and the signals of the row's whole ``text``.

    Windows of five words are compared by a 64-bit hash of their words' hashes inside one text. Each array that a lambda
    looks into is a column of its own projection, so that it is built once and not once per element.
    """
    words = F.split(F.col("_trimmed"), SPACE_CLASS + "+")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select(
        "row",
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        _count_chars(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_chars(F.col("_text"), "!?").cast("long").alias("n_marks"),
        F.btrim("_text", F.lit(SPACE)).alias("_trimmed"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0).alias("_lines"),
    )
    rows = rows.select(
        "row", "word_chars", "n_symbols", "n_marks",
        F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(words).alias("_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda line: F.regexp_like(line, F.lit(r"^\s*[-*•]")))).cast("long").alias("n_bullet_lines"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "_words"],
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    rows = rows.select(
        *rows.columns,
        F.slice(
            F.transform(
                "_hashes",
                lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]),
            ),
            F.lit(1),
            F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)),
        ).alias("_windows"),
    ).drop("_hashes")
    rows = rows.select(
        *rows.columns,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    ).drop("_windows")
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    rows = rows.select(
        *rows.columns,
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda e, i: same(e, F.get(F.col("_sorted"), i - 1)) | same(e, F.get(F.col("_sorted"), i + 1)),
                ),
                lambda e: e["i"],
            )
        ).alias("_at"),
    ).drop("_sorted")
    step = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW))))
    rows = rows.select(
        *[c for c in rows.columns if c != "_at"],
        F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("n_lines"), F.lit(1))
    return rows.select(
        *rows.columns,
        (100.0 * per_word("n_repeat_words")).alias("repeat_words_pct"),
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_marks").alias("marks_per_word"),
        per_word("n_stop_words").alias("stop_word_ratio"),
        per_line("n_dup_lines").alias("dup_line_ratio"),
        per_line("n_bullet_lines").alias("bullet_line_ratio"),
    )


def broken(rule: Rule) -> Column:
    """True where the row breaks the rule."""
    signal = F.col(rule.signal)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (signal < rule.low)
    if rule.high is not None:
        out = out | (signal > rule.high)
    return out & (F.col("n_words") >= rule.min_words) if rule.min_words else out


def verdict(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``kept`` and ``reasons`` (names of the broken rules, in table order)."""
    names = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return measured.withColumn("reasons", names).withColumn("kept", F.size("reasons") == 0)


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return verdict(measure(docs), rules)


def passing(judged: DataFrame, condition: Column) -> DataFrame:
    """The rows of a ``verdict`` for which ``condition`` holds, as they were.

    A filter would be pushed below the projections and put all arrays into one expression, where lambdas build them anew for
    each element; a generator is not.
    """
    return judged.select(F.explode(F.when(condition, F.array("row"))).alias("row")).select("row.*")
