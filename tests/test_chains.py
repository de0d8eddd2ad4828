"""Chains and retention against direct walks on awkward graphs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.operators import catalog as C
from keelson.operators import chains as K
from keelson.operators import retention as R

T0 = datetime(2024, 1, 1)


def record(rid, parent=None, chain=None, db="db", start=T0, end=None, kind="FULL", status="SUCCESS", tables=(), uri=None, size=None):
    return (rid, db, kind, "PLAIN_SQL", parent, chain, list(tables), start, end, None, size, uri, status, None)


def frame(spark, records):
    return spark.createDataFrame(records, C.CATALOG_SCHEMA)


def blank(text):
    return text is None or not text.strip()


def walk_effective(rec, by_id):
    seen, at = set(), rec
    while True:
        if not blank(at[5]):
            return at[5]
        if blank(at[4]):
            return at[0]
        seen.add(at[0])
        at = by_id.get(at[4])
        if at is None or at[0] in seen:
            return rec[4]


def walk_root(rec, by_id):
    path, at = [rec[0]], rec
    while not blank(at[4]):
        nxt = by_id.get(at[4])
        if nxt is None:
            return "DANGLING", at[4], path
        if nxt[0] in path:
            return "CYCLE", None, path
        path.append(nxt[0])
        at = nxt
    return "ROOT", at[0], path


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(17)
    records = []
    for i in range(600):
        pick = rng.random()
        parent = None if pick < 0.08 else "gone" if pick < 0.12 else "  " if pick < 0.14 else f"n{rng.randrange(600)}"
        chain = f"c{rng.randrange(5)}" if rng.random() < 0.05 else " " if rng.random() < 0.05 else None
        records.append(record(f"n{i}", parent, chain, status="FAILED" if rng.random() < 0.02 else "SUCCESS"))
    # a long handle with many nodes at its end, a self-loop, and circles of two and three
    records += [record(f"h{i}", f"h{i - 1}" if i else None) for i in range(400)]
    records += [record(f"s{i}", "h399") for i in range(200)]
    records += [record("self", "self"), record("a", "b"), record("b", "a"), record("x", "y"), record("y", "z"), record("z", "x"), record("to-x", "x")]
    return records


def test_effective_chain(spark, awkward):
    by_id = {r[0]: r for r in awkward}
    got = {r["id"]: r["eff_chain"] for r in K.effective_chain(frame(spark, awkward)).collect()}
    assert got == {r[0]: walk_effective(r, by_id) for r in awkward}


def test_walks(spark, awkward):
    by_id = {r[0]: r for r in awkward}
    got = {r["id"]: r for r in K.walk_to_root(frame(spark, awkward)).collect()}
    assert len(got) == len(awkward)
    for rec in awkward:
        end, end_id, path = walk_root(rec, by_id)
        row = got[rec[0]]
        assert (row["end"], row["end_id"]) == (end, end_id)
        if end == "ROOT":
            assert row["steps"] == len(path) - 1
        if end != "CYCLE":
            assert row["all_success"] == all(by_id[p][12] == "SUCCESS" for p in path)


def test_lineage(spark, awkward):
    by_id = {r[0]: r for r in awkward}
    targets = ["s7", "h0", "h255", "n5", "n77", "self", "to-x", "unknown"]
    got = K.restore_lineage(frame(spark, awkward), spark.createDataFrame([(t,) for t in targets], "target_id string")).collect()
    by_target = {}
    for r in got:
        by_target.setdefault(r["target_id"], {})[r["step"]] = r["id"]
    for t in targets:
        kind, _, path = walk_root(by_id[t], by_id) if t in by_id else ("NONE", None, [])
        want = dict(enumerate(reversed(path))) if kind == "ROOT" else {}
        assert by_target.get(t, {}) == want


def test_inheritance(spark):
    known = frame(spark, [record("p1", chain="c1"), record("p2"), record("p3", chain=" ")])
    asked = frame(
        spark,
        [
            record("i1", "p1", kind="INCREMENTAL"), record("i2", "p2", kind="DIFFERENTIAL"), record("i3", "p3", kind="INCREMENTAL"),
            record("i4", "p1", "own", kind="INCREMENTAL"), record("i5", "none", kind="INCREMENTAL"), record("f1", "p1"),
        ],
    )
    got = dict(rows(K.inherit_chain(asked, known), "id", "backup_chain_id"))
    assert got == {"i1": "c1", "i2": "p2", "i3": "i3", "i4": "own", "i5": "i5", "f1": "f1"}


def test_scope(spark):
    known = frame(spark, [record("p", tables=["users", "orders"]), record("q", tables=["users"])])
    asked = frame(
        spark,
        [
            record("same", "p", kind="INCREMENTAL", tables=["orders", "users", "users"]),
            record("other", "q", kind="INCREMENTAL", tables=["orders"]),
            record("full", "q", tables=["orders"]),
            record("lost", "gone", kind="INCREMENTAL", tables=["orders"]),
        ],
    )
    assert [r["id"] for r in K.scope_violations(asked, known).collect()] == ["other"]


def asof():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def days_ago(n):
    return datetime(2024, 1, 31) - timedelta(days=n)


def test_base_stays_while_a_child_is_kept(spark):
    rec = [record("full", chain="c", start=days_ago(10)), record("inc", "full", "c", start=days_ago(1), kind="INCREMENTAL")]
    assert R.delete_set(frame(spark, rec), asof(), keep_last=5).count() == 0
    assert R.delete_set(frame(spark, rec), asof(), retention_days=5).count() == 0


def test_retention_edges(spark):
    rec = [
        record("edge", start=days_ago(7)),
        record("old", start=days_ago(7) - timedelta(microseconds=1)),
        record("ended", start=days_ago(20), end=days_ago(2)),
        record("timeless", start=None),
    ]
    df = frame(spark, rec)
    gone = lambda **rule: sorted(r["id"] for r in R.delete_set(df, asof(), **rule).collect())
    assert gone(retention_days=7) == ["old", "timeless"]
    assert gone(keep_last=1) == ["edge", "old", "timeless"]
    assert gone(keep_last=2, retention_days=7) == ["old", "timeless"]
    assert gone(keep_last=3) == ["timeless"]
    assert gone(keep_last=5000) == []
    assert gone() == []
    for bad in ({"keep_last": 0}, {"retention_days": -1}):
        with pytest.raises(ValueError):
            R.delete_set(df, asof(), **bad)


def test_retention_ranks_sliced(spark, small_slices):
    rng = random.Random(2)
    rec = [record(f"r{i}", db="big" if i % 3 else f"d{i % 5}", start=days_ago(rng.randrange(300))) for i in range(300)]
    rules = spark.createDataFrame([("big", 37, None), ("d0", 2, 100), ("d3", None, None), ("d1", -1, 3)], "db string, keep_last int, retention_days int")
    got = {r["id"] for r in R.delete_set_by_rule(frame(spark, rec), rules, asof()).collect()}
    want = set()
    for db, keep, days in [("big", 37, None), ("d0", 2, 100)]:
        mine = sorted((r for r in rec if r[1] == db), key=lambda r: (-r[7].timestamp(), r[0]))
        for place, r in enumerate(mine):
            if place >= keep and not (days is not None and r[7] >= days_ago(days)):
                want.add(r[0])
    assert got == want


def test_shared_objects_are_not_deleted(spark):
    rec = [
        record("a", start=days_ago(30), uri="s3://b/shared"), record("b", start=days_ago(1), uri="s3://b/shared"),
        record("c", start=days_ago(40), uri="gs://b/own"), record("d", start=days_ago(41)),
    ]
    df = frame(spark, rec)
    plan = R.object_delete_plan(R.delete_set(df, asof(), retention_days=7), df)
    assert rows(plan, "uri", "scheme") == [("gs://b/own", "gs")]


def test_status_filter(spark):
    rec = [record("ok", start=days_ago(30)), record("bad", start=days_ago(30), status="FAILED")]
    got = R.delete_set(frame(spark, rec), asof(), retention_days=1, statuses=["FAILED"])
    assert [r["id"] for r in got.collect()] == ["bad"]


def test_duplicate_and_missing_ids(spark):
    from datetime import datetime

    from keelson.operators import chains as K
    from pyspark.sql import functions as F

    day = lambda n: datetime(2024, 1, n)
    data = [("a", None, "c1", day(1)), ("a", None, "c2", day(2)), ("b", "a", None, day(3)), (None, "a", None, day(4)), (None, None, "own", day(5))]
    records = spark.createDataFrame([(*r, "SUCCESS") for r in data], "id string, parent_backup_id string, backup_chain_id string, start_time timestamp, status string")
    got = K.effective_chain(records).select("id", "start_time", "eff_chain").collect()
    assert sorted((r["start_time"].day, r["eff_chain"]) for r in got) == [(1, "c1"), (2, "c2"), (3, "c1"), (4, "c1"), (5, "own")]
    assert K.with_parent(records, records, "backup_chain_id").count() == len(data)
    assert K.chain_usability(records).count() == 2


def test_rules_of_jobs_give_up_what_any_of_them_gives_up(spark):
    settings = [("a", "3", "10"), ("a", "5", "2"), ("a", "4", "12"), ("a", "3", "10"), ("a", "8", "9"), ("a", "2", "-4"), ("a", "x", None),
                ("b", None, "7"), ("c", "0", "0"), (None, "4", None)]
    jobs = spark.createDataFrame(settings, "database string, keep_last_setting string, retention_days_setting string")
    front = rows(R.rules_by_database(jobs).filter("db is not null"))
    assert front == [("a", 3, 10), ("a", 5, 2), ("b", 1, 7)]
    # every cohort is judged as by all valid rules
    every = [(3, 10), (5, 2), (4, 12), (8, 9)]
    goes = lambda rules, rank, age: any(rank > k and age > d for k, d in rules)
    kept = [(k, d) for db, k, d in front if db == "a"]
    assert all(goes(every, rank, age) == goes(kept, rank, age) for rank in range(12) for age in range(16))
