"""Comparison of tables by hash trees."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.operators import verify as V

COLUMNS = "k int, a int, b int, s string, xs array<int>, m map<string,int>, n struct<p:int,q:array<string>>"


def table(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(3)


def made(seed, n=3000):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice([None, *v])
    return [
        (i % 2500, pick(1, 2), pick(1, 2), pick("", "x"), pick([], [1], [None, 1], [1, None]), pick({}, {"u": 1, "v": None}, {"v": 1, "u": None}), pick((None, ["z"]), (1, None), (1, [None])))
        for i in range(n)
    ]


def key(row):
    return repr((row[:5], sorted(row[5].items()) if row[5] is not None else None, tuple(row[6]) if row[6] is not None else None))


def expected(left, right):
    counts = Counter(map(key, left))
    counts.subtract(map(key, right))
    return {k: n for k, n in counts.items() if n}


def found(verdict):
    return {key(tuple(r)[:-1]): r["surplus"] for r in verdict.rows.collect()}


@pytest.mark.parametrize("bits", [10, 1])
def test_named_differences(spark, monkeypatch, bits):
    monkeypatch.setattr(V, "BITS", bits)
    left = made(1)
    right = [r for r in left if r[0] != 7] + left[40:43] + [left[50][:1] + (9,) + left[50][2:]]
    random.Random(2).shuffle(right)
    got = V.verify(table(spark, left), table(spark, right).select("n", "m", "xs", "s", "b", "a", "k"))
    assert got.row_count == len(left) and not got.same
    assert found(got) == expected(left, right) != {}


def test_equal_tables_cost_one_scan_a_side(spark, monkeypatch):
    left = made(3)
    calls = []
    monkeypatch.setattr(V, "materialise", lambda *a: calls.append(a))
    got = V.verify(table(spark, left), table(spark, left[::-1]))
    assert got.same and got.rows.count() == 0 and not calls
    empty = table(spark, left).limit(0)
    assert V.verify(empty, empty).same and V.verify(empty, empty).row_count == 0


@pytest.mark.parametrize(
    "one, other",
    [
        ((1, None, 1, "", [], {}, None), (1, 1, None, "", [], {}, None)),
        ((1, 1, 1, None, [None, 1], None, None), (1, 1, 1, None, [1, None], None, None)),
        ((1, 1, 1, "", [], {}, None), (1, 1, 1, "", None, {}, None)),
        ((1, 1, 1, "", [], {"u": None, "v": 1}, None), (1, 1, 1, "", [], {"u": 1, "v": None}, None)),
        ((1, 1, 1, "", [], None, (None, None)), (1, 1, 1, "", [], None, None)),
        ((1, 1, 1, "", [], None, (1, [None, "a"])), (1, 1, 1, "", [], None, (1, ["a", None]))),
    ],
)
def test_places_of_nulls_count(spark, one, other):
    got = V.verify(table(spark, [one, one]), table(spark, [one, other]))
    assert found(got) == {key(one): 1, key(other): -1}


def test_only_narrow_rows_are_shuffled(spark):
    left = table(spark, made(4))
    rows = V.hashed(left, 1).withColumn("n1", V.node(1))
    plan = V.differing(rows, ["n1"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.split("Exchange hashpartitioning")[1]
    assert "partial_sum" in plan and not any(f"{c}#" in exchange.split("HashAggregate")[0] for c in ("s", "xs", "m"))


def test_columns_must_agree(spark):
    left = table(spark, made(5, 3))
    with pytest.raises(ValueError, match="columns differ"):
        V.verify(left, left.drop("s"))
    assert V.verify(left, left.withColumn("s", F.col("s"))).same
