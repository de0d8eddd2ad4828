"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and to in a is that it for on was be with as by this are at from Ab cd EF gh ij kl mn op".split()


def texts(seed: int = 7) -> list[tuple]:
    rnd = random.Random(seed)
    some = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage, base = some(14), some(60)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "ONE"), (7, some(3000))]
    out += [(10 + k, f"{some(8)} {passage}\n{some(6)}") for k in range(4)]
    out += [(20, base), (21, base), (21, base), (22, base + " tail"), (23, base.upper()), (24, base.replace("the", "thy"))]
    out += [(30, "aa " * 40), (31, "é漢🙂 x\x0by\x0cz w " + some(12)), (None, some(20)), (None, None), (33, passage)]
    out += [(40 + k, some(rnd.randint(1, 40))) for k in range(12)]
    return out


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    wide = [(i, t, "en", None, len(t or ""), "x", 1, None, "h") for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, k1 string, row int, found string, vid string"
    ).repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
