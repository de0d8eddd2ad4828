"""Sliced scans give what plain windows give, also when one key owns most rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import rows
from keelson.operators import chains as K
from keelson.operators import schedule as J
from keelson.plans.scans import latest_per_key, running_rank, slice_rows, top_per_key
from keelson.session import scratch_path


def skewed(spark, n=3000, seed=3):
    rng = random.Random(seed)
    data = [(i, 0 if rng.random() < 0.6 else rng.randrange(1, 30), rng.randrange(500)) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, k bigint, v bigint")


def test_small_keys_are_not_cut(spark):
    assert not slice_rows(skewed(spark), ["k"], [F.col("id").asc()]).cut


def test_large_key_is_cut_and_in_order(spark, small_slices):
    cut = slice_rows(skewed(spark), ["k"], [F.col("v").asc(), F.col("id").asc()])
    assert cut.cut
    spans = cut.rows.filter("k = 0").groupBy("_slice").agg(F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi"))
    spans = [(tuple(r["lo"]), tuple(r["hi"])) for r in spans.orderBy("_slice").collect()]
    assert len(spans) > 2
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_running_rank(spark, small_slices):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert rows(running_rank(df, ["k"], order), "id", "rank") == rows(plain, "id", "rank")


def test_carry_is_bounded_by_the_number_of_slices(spark, small_slices):
    cut = slice_rows(skewed(spark), ["k"], [F.col("id").asc()])
    carried = cut._carried(cut.rows, {"_n": F.count(F.lit(1))}, {"_b": lambda w: F.sum("_n").over(w)}, False)
    rows_ = cut.rows.count()
    assert carried.count() <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_ // 10))


def test_null_keys_are_carried(spark, small_slices):
    df = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), "id")
    got = running_rank(df, ["k"], [F.col("id").asc()])
    assert rows(got.groupBy("k").agg(F.max("rank").alias("m"), F.count("rank").alias("n")).fillna("none"), "k", "m", "n") == [("a", 30, 30), ("none", 30, 30)]


def test_latest_per_key_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "id string, seq int, v string")
    assert sorted(map(tuple, latest_per_key(df, ["id"], ["seq"]).collect())) == [("a", 2, None), ("b", 1, "y")]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_top_per_key_limits_before_the_shuffle(spark):
    top = top_per_key(skewed(spark), ["k"], [F.col("v").desc(), F.col("id").asc()], 5)
    assert "WindowGroupLimit" in plan(top) and "Partial" in plan(top)


def test_salted_top_per_key(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    assert rows(top_per_key(df, ["k"], order, 40, salts=8), "k", "id", "rank") == rows(top_per_key(df, ["k"], order, 40), "k", "id", "rank")
    assert plan(top_per_key(df, ["k"], order, 1000, salts=8)).count("WindowGroupLimit") >= 4


def brute_queue(triggers):
    out, free = {}, {}
    for tid, job, s, d in sorted(triggers, key=lambda t: (t[2], t[0])):
        start = max(s, free.get(job, s))
        free[job] = start + d
        out[tid] = (start, start + d)
    return out


def brute_skip(triggers):
    out, free = {}, {}
    for tid, job, s, d in sorted(triggers, key=lambda t: (t[2], t[0])):
        ran = s >= free.get(job, s)
        if ran:
            free[job] = s + d
        out[tid] = ran
    return out


@pytest.fixture()
def trigger_log(spark):
    rng = random.Random(11)
    data = []
    for i in range(1500):
        job = 0 if rng.random() < 0.5 else rng.randrange(1, 9)
        # equal starts and runs of no length included
        data.append((i, job, rng.randrange(4000) * 1_000_000, rng.choice([0, 1, 3, 10, 200]) * 1_000_000))
    df = spark.createDataFrame(data, "trigger_id bigint, job_id bigint, s bigint, duration_us bigint")
    return data, df.withColumn("start_time", F.timestamp_micros("s").cast("timestamp_ntz")).drop("s")


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@pytest.mark.parametrize("sliced", [False, True])
def test_queue(spark, trigger_log, sliced, request):
    if sliced:
        request.getfixturevalue("small_slices")
    data, df = trigger_log
    got = J.queue_outcome(df).select("trigger_id", micros("started_at"), micros("finished_at")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_queue(data)


@pytest.mark.parametrize("sliced,limit", [(False, None), (True, None), (True, 1), (True, 40), (True, 10_000)])
def test_skip(spark, trigger_log, sliced, limit, request):
    if sliced:
        request.getfixturevalue("small_slices")
    data, df = trigger_log
    got = J.skip_outcome(df, island_limit=limit).collect()
    assert len(got) == len(data)
    assert {r["trigger_id"]: r["ran"] for r in got} == brute_skip(data)


@pytest.mark.parametrize("sliced", [False, True])
def test_skip_without_job_start_or_duration(spark, sliced, request):
    if sliced:
        request.getfixturevalue("small_slices")
    # ten of each: the job without an id is a job of its own
    data = [(n * 10 + k, job, at and at + n * 100, length) for n in range(10) for k, (job, at, length) in enumerate(
        [(None, 1, 50), (None, 20, 5), (7, 2, None), (7, 2, 10), (7, 5, 1), (7, None, 3), (8, 20, 5)])]
    df = spark.createDataFrame(data, "trigger_id bigint, job_id bigint, s bigint, duration_us bigint")
    got = J.skip_outcome(df.withColumn("start_time", F.timestamp_micros("s").cast("timestamp_ntz")).drop("s"))
    assert {r["trigger_id"] % 10: r["ran"] for r in got.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert got.count() == len(data) and got.groupBy((F.col("trigger_id") % 10).alias("k")).agg(F.countDistinct("ran").alias("n")).filter("n > 1").count() == 0


def test_cancel_and_overlap_sliced_equal_plain(spark, trigger_log):
    _, df = trigger_log
    plain_cancel, plain_overlap = rows(J.cancel_previous_outcome(df)), rows(J.overlap_audit(df))
    spark.conf.set("spark.keelson.rowsPerKey", "10")
    try:
        assert rows(J.cancel_previous_outcome(df)) == plain_cancel
        assert rows(J.overlap_audit(df)) == plain_overlap
    finally:
        spark.conf.unset("spark.keelson.rowsPerKey")


def test_usable_at_sliced(spark, small_slices):
    rng = random.Random(5)
    recs = [(f"r{i}", "db0" if i % 2 else "db1", rng.randrange(1000), rng.choice(["SUCCESS", "FAILED"])) for i in range(400)]
    points = [(f"p{i}", "db0" if i % 3 else "db1", rng.randrange(-5, 1005)) for i in range(300)]
    at = F.timestamp_micros(F.col("t") * 1_000_000).cast("timestamp_ntz")
    records = spark.createDataFrame(recs, "id string, profile_name string, t bigint, status string").withColumn("start_time", at)
    asked = spark.createDataFrame(points, "point_id string, profile_name string, t bigint").withColumn("at", at)
    got = {r["point_id"]: r["id"] for r in K.usable_at(records, asked).collect()}
    for pid, db, t in points:
        best = [(rt, rid) for rid, rdb, rt, st in recs if rdb == db and st == "SUCCESS" and rt <= t]
        assert got[pid] == (max(best)[1] if best else None)


def test_missed_runs_sliced(spark, small_slices):
    minutes = lambda c: F.timestamp_micros(F.col(c) * 60_000_000).cast("timestamp_ntz")
    rng = random.Random(9)
    fires = [(i % 3, rng.randrange(3000)) for i in range(400)]
    ran = [(rng.randrange(3), rng.randrange(3000)) for _ in range(200)]
    expected = spark.createDataFrame(fires, "job_id bigint, t bigint").select("job_id", minutes("t").alias("fire_time"))
    seen = spark.createDataFrame(ran, "job_id bigint, t bigint").select("job_id", minutes("t").alias("start_time"))
    got = sorted((r[0], r[1]) for r in J.missed_runs(expected, seen, 5).select("job_id", (micros("fire_time") / 60_000_000).cast("bigint")).collect())
    assert got == sorted((j, t) for j, t in fires if not any(k == j and t <= u <= t + 5 for k, u in ran))


def test_scratch_is_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
