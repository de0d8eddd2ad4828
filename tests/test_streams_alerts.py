"""Streams in several batches, alerts, cron texts, catalog rows."""

import json
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import rows
from keelson.operators import alerts as N
from keelson.operators import catalog as C
from keelson.operators import chains as K
from keelson.operators import schedule as J
from keelson.plans.backup import BackupRequest, Catalog, commit_step, restore_table, run_backup
from keelson.session import scratch_path
from keelson.sources.snapshots import TrackedTable
from keelson.streaming import jobs as T
from keelson.streaming.runs import RunTable


def drop_files(df, path, column, groups):
    """One file per group, written one after the other."""
    for g in groups:
        df.filter(F.col(column) == g).drop(column).coalesce(1).write.mode("append").parquet(path)


def test_streamed_chain_in_the_catalog(spark):
    table = TrackedTable("t", ("k",), "pos")
    data = [(1, 1, "a", 0), (2, 2, "b", 0), (1, 3, "a2", 1), (3, 4, "c", 2), (2, 5, "b2", 3)]
    df = spark.createDataFrame(data, "k int, pos bigint, v string, g int")
    schema = df.drop("g").schema
    source, root = scratch_path(spark, "src"), scratch_path(spark, "sb")
    catalog = Catalog(spark, f"{root}/catalog")
    stream = lambda: T.file_stream(spark, source, schema, batch_files=1)
    run = lambda cp: T.backup_stream(stream(), table, catalog, root, "d", "live", f"{root}/{cp}")
    drop_files(df, source, "g", [0, 1])
    assert run("_cp") == "live-1"
    drop_files(df, source, "g", [2, 3])
    assert run("_cp") == "live-3"
    expected = [
        ("live-0", "FULL", None, "live-0", "SUCCESS", "2"), ("live-1", "INCREMENTAL", "live-0", "live-0", "SUCCESS", "3"),
        ("live-2", "INCREMENTAL", "live-1", "live-0", "SUCCESS", "4"), ("live-3", "INCREMENTAL", "live-2", "live-0", "SUCCESS", "5"),
    ]
    told = lambda: rows(catalog.with_positions(), "id", "backup_type", "parent_backup_id", "backup_chain_id", "status", "last_position")
    assert told() == expected
    sizes = {r["id"]: r["file_size_bytes"] for r in catalog.current().collect()}
    state = lambda target: rows(restore_table(catalog, target, table, root, "d"), "k", "v")
    assert state("live-3") == [(1, "a2"), (2, "b2"), (3, "c")] and state("live-1") == [(1, "a2"), (2, "b")]
    # a stream that lost its checkpoint tries every batch again: one record each, nothing new
    before = catalog.log().count()
    assert run("_other") == "live-3"
    assert told() == expected and catalog.log().count() == before
    assert {r["id"]: r["file_size_bytes"] for r in catalog.current().collect()} == sizes and state("live-3") == [(1, "a2"), (2, "b2"), (3, "c")]
    # the chain is one for lineage and retention
    assert rows(K.restore_lineage(catalog.current(), spark.createDataFrame([("live-2",)], "target_id string")), "step", "id") == [(0, "live-0"), (1, "live-1"), (2, "live-2")]
    assert rows(K.effective_chain(catalog.current()), "id", "eff_chain") == [(f"live-{n}", "live-0") for n in range(4)]
    # and a run can go on from it
    later = spark.createDataFrame([(9, 9, "z")], schema).unionByName(df.drop("g"))
    run_backup(catalog, BackupRequest("d", [table], 10, root, "INCREMENTAL", parent_id="live-3", backup_id="b", selected=("t",)), lambda name: later)
    assert state("b") == [(1, "a2"), (2, "b2"), (3, "c"), (9, "z")]


def test_a_batch_that_failed_before_its_record_is_written_anew(spark, monkeypatch):
    table = TrackedTable("t", ("k",), "pos")
    df = spark.createDataFrame([(1, 1), (2, 2)], "k int, pos bigint")
    root = scratch_path(spark, "sb")
    catalog = Catalog(spark, f"{root}/catalog")

    def fail(*_):
        raise OSError("no more disk")

    with monkeypatch.context() as m:
        m.setattr(Catalog, "append", fail)
        with pytest.raises(OSError):
            commit_step(catalog, "s", 0, table, root, "d", df)
    assert catalog.current().count() == 0
    assert commit_step(catalog, "s", 0, table, root, "d", df) and not commit_step(catalog, "s", 0, table, root, "d", df)
    assert restore_table(catalog, "s-0", table, root, "d").count() == 2


def test_upsert_stream_ignores_arrival_order(spark):
    df = spark.createDataFrame([("x", 2, "done", 0), ("x", 1, "begun", 1), ("y", 1, "begun", 1), ("y", 3, None, 2)], "id string, seq bigint, s string, g int")
    source, sink = scratch_path(spark, "src"), scratch_path(spark, "up")
    drop_files(df, source, "g", [0, 1, 2])
    got = T.upsert_stream(T.file_stream(spark, source, df.drop("g").schema, batch_files=1), sink, f"{sink}-cp")
    assert rows(got) == [("x", 2, "done"), ("y", 3, None)]


def schema_of(spark, text):
    return spark.createDataFrame([], text).schema


def stored(spark, path):
    return spark.read.schema("id int").option("recursiveFileLookup", "true").parquet(f"{path}/slot=*").count()


def test_runs_grow_with_the_ids_and_not_with_the_batches(spark):
    path, schema = scratch_path(spark, "runs"), schema_of(spark, "id int, seq int, v string")
    table = RunTable(spark, path, schema, ["id"], ["seq"])
    want, most = {}, 0
    random = Random(5)
    for number in range(14):
        # a few ids are changed in every batch; the order of changes is not the order of arrival
        batch = [(random.randrange(40), random.randrange(10**6), f"b{number}") for _ in range(8)]
        table.merge(spark.createDataFrame(batch, schema))
        for row in batch:
            want[row[0]] = max(want.get(row[0], row), row, key=lambda r: r[1])
        if number % 5 == 2:
            table.merge(spark.createDataFrame(batch, schema))
        live = [r["rows"] for r in table.manifest() if r["state"] == "live"]
        assert all(rows >= 2 * sum(live[n + 1 :]) for n, rows in enumerate(live))
        assert sum(live) <= 1.5 * len(want)
        most = max(most, len(live))
    assert rows(table.current()) == sorted(want.values())
    assert most > 1
    # beside the live runs, only those of the manifest before are still there
    assert stored(spark, path) <= 3 * len(want)
    table.merge(spark.createDataFrame([], schema))
    assert rows(table.current()) == sorted(want.values())


def test_a_batch_that_failed_before_its_manifest_leaves_the_table_as_it_was(spark, monkeypatch):
    path, schema = scratch_path(spark, "runs"), schema_of(spark, "id int, seq int")
    table = RunTable(spark, path, schema, ["id"], ["seq"])
    assert rows(table.current()) == []
    table.merge(spark.createDataFrame([(1, 1), (2, 1)], schema))
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", fails)
        with pytest.raises(OSError):
            table.merge(changed := spark.range(2, 4).selectExpr("cast(id as int) id", "2 seq"))
    assert rows(table.current()) == [(1, 1), (2, 1)]
    table.merge(changed)
    assert rows(table.current()) == [(1, 1), (2, 2), (3, 2)]


def fails(*_):
    raise OSError("no more disk")


def test_streamed_upserts_over_many_batches(spark):
    data = [(n % 7, (n * 37) % 60, f"v{n}", g) for g in range(6) for n in range(g * 9, g * 9 + 12)]
    df = spark.createDataFrame(data, "id int, seq int, v string, g int")
    source, sink = scratch_path(spark, "src"), scratch_path(spark, "up")
    drop_files(df, source, "g", range(6))
    stream = lambda: T.file_stream(spark, source, df.drop("g").schema, batch_files=1)
    want = sorted({row[0]: row[:3] for row in sorted(data, key=lambda r: r[1])}.values())
    assert rows(T.upsert_stream(stream(), sink, f"{sink}-cp")) == want
    # the checkpoint is lost: every batch comes again
    assert rows(T.upsert_stream(stream(), sink, f"{sink}-other")) == want


def windows(spark, data, files, query):
    """Closed windows of rows (minute, id, job, status) that come in the given number of files, in order."""
    t = datetime(2024, 1, 1)
    size = -(-len(data) // files)
    held = [(t + timedelta(minutes=m), i, job, status, n // size) for n, (m, i, job, status) in enumerate(data)]
    df = spark.createDataFrame(held, "start_time timestamp_ntz, id int, job string, status string, g int")
    source, sink = scratch_path(spark, "src"), scratch_path(spark, "win")
    drop_files(df, source, "g", range(files))
    return rows(T.closed_windows(query(T.file_stream(spark, source, df.drop("g").schema, batch_files=1)), sink, f"{sink}-cp"))


def test_windows_do_not_depend_on_the_number_of_batches(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    # disorder stays within the delay; ids 3 and 6 come twice; the last row closes what is before it
    data = [(5, 1, "a", "FAILED"), (50, 2, "a", "OK"), (20, 3, "a", "OK"), (20, 3, "a", "OK"), (70, 4, "b", "OK"), (65, 5, None, "OK"),
            (130, 6, "b", "FAILED"), (130, 6, "b", "FAILED"), (100, 7, "a", "OK"), (900, 8, "a", "OK")]
    rates = lambda stream: T.run_rates(stream, delay="1 hour", unique="id")
    sessions = lambda stream: T.run_sessions(stream, "job", delay="1 hour", gap="20 minutes", unique="id")
    in_one, in_five = windows(spark, data, 1, rates), windows(spark, data, 5, rates)
    assert in_one == in_five == [(t(0), t(60), 3, 1), (t(60), t(120), 3, 0), (t(120), t(180), 1, 1)]
    got = windows(spark, [r for r in data if r[2]], 1, sessions)
    assert got == windows(spark, [r for r in data if r[2]], 3, sessions)
    assert got == [("a", t(5), t(40), 2, 1), ("a", t(50), t(70), 1, 0), ("a", t(100), t(120), 1, 0), ("b", t(70), t(90), 1, 0), ("b", t(130), t(150), 1, 1)]


def test_late_rows_are_dropped(spark):
    t = datetime(2024, 1, 1)
    data = [(t + timedelta(minutes=m), "SUCCESS" if m % 2 else "FAILED", g) for g, ms in enumerate([[1, 5], [130, 190], [185], [3, 600]]) for m in ms]
    df = spark.createDataFrame(data, "start_time timestamp_ntz, status string, g int")
    source, sink = scratch_path(spark, "src"), scratch_path(spark, "rates")
    drop_files(df, source, "g", [0, 1, 2, 3])
    stream = T.file_stream(spark, source, df.drop("g").schema, batch_files=1)
    got = T.closed_windows(T.run_rates(stream, delay="1 hour"), sink, f"{sink}-cp")
    assert rows(got, "window_start", "runs", "failures") == [(t, 2, 0), (t + timedelta(hours=2), 1, 1), (t + timedelta(hours=3), 2, 1)]


ALERT = "id string, title string, message string, success boolean, details map<string,string>"


def test_bodies(spark):
    df = spark.createDataFrame([("1", "T", "M", True, {"Size": "5"}), ("2", "T", "M", False, {})], ALERT)
    df = df.withColumn("channels", F.array(F.lit("TELEGRAM"), F.lit("slack"), F.lit("Discord"), F.lit("mail"), F.lit(None)))
    got = {(r["id"], r["channel"]): json.loads(r["body"]) for r in N.render(N.route(df), "42").collect()}
    assert len(got) == 6
    assert got["1", "telegram"] == {"chat_id": "42", "text": "<b>[SUCCESS] T</b>\nMessage: M\n\n<b>Details:</b>\n• <b>Size:</b> 5\n", "parse_mode": "HTML"}
    assert got["2", "telegram"]["text"] == "<b>[FAILED] T</b>\nMessage: M\n"
    assert got["1", "slack"]["blocks"][1]["text"]["text"] == "*Message:* M\n\n*Details:*\n• *Size:* 5\n"
    assert got["2", "slack"]["text"] == "[FAILED] T: M"
    assert got["1", "discord"]["embeds"][0]["fields"] == [{"name": "Size", "value": "5", "inline": True}]
    assert got["2", "discord"] == {"embeds": [{"title": "[FAILED] T", "description": "M", "color": 0xE74C3C}]}


def test_restore_alerts(spark):
    got = rows(N.restore_alerts(spark.createDataFrame([("a", None), ("b", "boom")], "target_id string, error string")), "id", "title", "message", "success")
    assert got == [
        ("a", "Restore Successful", "Successfully restored backup chain up to target a", True),
        ("b", "Restore Failed", "Failed to restore backup b: boom", False),
    ]


def fire_times(spark, cron, begin="2024-02-27 00:00:00", end="2024-03-05 00:00:00"):
    jobs = spark.createDataFrame([(1, cron)], "job_id int, cron string")
    return [r["fire_time"] for r in J.expected_runs(jobs, begin, end).orderBy("fire_time").collect()]


def test_cron_texts(spark):
    assert fire_times(spark, "30 4 29 2 *") == [datetime(2024, 2, 29, 4, 30)]
    assert fire_times(spark, "0 0 0 ? * SUN") == fire_times(spark, "0 0 * * 7") == [datetime(2024, 3, 3)]
    assert fire_times(spark, "15/20 10 10 1 3 *") == [datetime(2024, 3, 1, 10, 10, s) for s in (15, 35, 55)]
    assert fire_times(spark, "0 0 0 1 mar fri") == [datetime(2024, 3, 1)]
    assert fire_times(spark, "0 0 0 1 3 mon") == []
    assert len(fire_times(spark, "*/15 * * * *")) == 7 * 96
    assert fire_times(spark, "0 0 * * *", "2024-03-01 00:00:01", "2024-03-02 00:00:00") == []


@pytest.mark.parametrize("bad", ["61 * * * *", "a b c d e", "* * *", "5-1 * * * *", "*/0 * * * *", "0 0 L-31 * *", "0 0 * * L", "0 0 32W * *", "0 0 * * 1#0"])
def test_bad_cron_texts_are_rejected(spark, bad):
    jobs = J.schedulable(spark.createDataFrame([(1, bad), (2, "* * * * *")], "job_id int, cron string"))
    good, rejected = J.split_cron(jobs)
    assert [r["job_id"] for r in good.collect()] == [2] and [r["job_id"] for r in rejected.collect()] == [1]


def nearest(y, m, n, days):
    """The working day of the month nearest to its day n; none if the month has no such day."""
    working = [d for d in days if (d.year, d.month) == (y, m) and d.weekday() < 5]
    there = any((d.year, d.month, d.day) == (y, m, n) for d in days)
    return min(working, key=lambda d: abs(d.day - n)) if there else None


CALENDAR_RULES = {
    "0 0 L * *": lambda d, last, near: d.day == last,
    "0 0 L-3 * *": lambda d, last, near: d.day == last - 3,
    "0 0 1W * *": lambda d, last, near: d == near(1),
    "0 0 31W * *": lambda d, last, near: d == near(31),
    "0 0 1,L,15W * *": lambda d, last, near: d.day in (1, last) or d == near(15),
    "0 0 LW * *": lambda d, last, near: d == near(last),
    "0 0 * * friL": lambda d, last, near: d.weekday() == 4 and d.day + 7 > last,
    "0 0 ? * MON#5": lambda d, last, near: d.weekday() == 0 and d.day > 28,
    "0 0 * * 7#1,5L": lambda d, last, near: (d.weekday() == 6 and d.day <= 7) or (d.weekday() == 4 and d.day + 7 > last),
    "0 0 L * 0L": lambda d, last, near: d.day == last and d.weekday() == 6,
    "0 0 30 2 *": lambda d, last, near: False,
}


def test_calendar_rules(spark):
    jobs = spark.createDataFrame(list(enumerate(CALENDAR_RULES)), "job_id int, cron string")
    days = [datetime(2023, 1, 1) + timedelta(days=n) for n in range(6 * 365 + 2)]  # whole years, two of them leap years
    last = {(d.year, d.month): d.day for d in days}
    want = [
        (n, d)
        for n, named in enumerate(CALENDAR_RULES.values())
        for d in days
        if named(d, last[d.year, d.month], lambda k, d=d: nearest(d.year, d.month, k, days))
    ]
    got = rows(J.expected_runs(jobs, "2023-01-01 00:00:00", str(days[-1] + timedelta(days=1))), "job_id", "fire_time")
    assert got == sorted(want)


def test_unscheduled_jobs_have_reasons(spark):
    texts = ["0 1 * * *", None, "", "x 1 * * *", "0 0 1 * * 1-9", "* *", "0 1 5W,32 * *", "@never"]
    jobs = spark.createDataFrame(list(enumerate(texts)), "job_id int, cron string")
    assert rows(J.unscheduled_jobs(jobs), "job_id", "reason") == [
        (1, "missing cron expression"), (2, "missing cron expression"), (3, "minute: x"), (4, "weekday: 1-9"),
        (5, "fields: 2"), (6, "day: 5W,32"), (7, "fields: 1"),
    ]
    assert rows(J.expected_runs(jobs, "2024-01-01 00:00:00", "2024-01-02 00:00:00")) == [(0, datetime(2024, 1, 1, 1))]
    none = spark.createDataFrame([], "job_id int, cron string")
    assert rows(J.unscheduled_jobs(none)) == [] and rows(J.expected_runs(none, "2024-01-01 00:00:00", "2024-02-01 00:00:00")) == []


def misfires(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    missed = [(job, at(h)) for job in (1, 2, 3, 4, 5) for h in (1, 2, 4, 9)] + [(None, at(1)), (None, at(2))]
    runs = [(job, at(h)) for job in (1, 2, 3, 4, 5, None) for h in (0, 3, 4, 5)]
    policies = [(1, "fire_now"), (2, "FIRE_ALL"), (3, " ignore "), (4, "sometimes"), (6, "IGNORE")]
    got = J.misfire_outcome(
        spark.createDataFrame(missed, "job_id int, fire_time timestamp_ntz"),
        spark.createDataFrame(runs, "job_id int, start_time timestamp_ntz"),
        spark.createDataFrame(policies, "job_id int, misfire string"),
    )
    once = [(1, "MERGED", 3), (2, "FIRED", 3), (4, "FIRED", 4), (9, "PENDING", None)]
    each = [(1, "FIRED", 3), (2, "FIRED", 3), (4, "FIRED", 4), (9, "PENDING", None)]
    told = {1: once, 2: each, 3: [(h, "DROPPED", None) for h in (1, 2, 4, 9)], 4: [(h, "UNKNOWN", None) for h in (1, 2, 4, 9)], 5: once, None: once[:2]}
    want = {(job, at(h), outcome, run and at(run)) for job, list_ in told.items() for h, outcome, run in list_}
    found = [tuple(r) for r in got.select("job_id", "fire_time", "outcome", "run_at").collect()]
    assert len(found) == len(want) and set(found) == want


def test_misfires(spark):
    misfires(spark)


def test_misfires_over_slices(spark):
    """Every job is cut; a run or fire time may lie in a later slice."""
    spark.conf.set("spark.keelson.rowsPerKey", "2")
    try:
        misfires(spark)
    finally:
        spark.conf.unset("spark.keelson.rowsPerKey")


def test_blank_cron_is_dropped(spark):
    jobs = spark.createDataFrame([(1, " "), (2, None), (3, "0 1 * * *")], "job_id int, cron string")
    assert rows(J.schedulable(jobs)) == [(3, "0 0 1 * * *")]


def test_history_record(spark):
    t = datetime(2024, 1, 1)
    row = ("b-001", "prod", "FULL", "PLAIN_SQL", None, "chain-001", ["users"], t, t + timedelta(minutes=2), 120000, 1048576, "file:///backups/b-001.sql.gz", "SUCCESS", None)
    df = spark.createDataFrame([row], C.CATALOG_SCHEMA)
    assert len(df.columns) == 14
    assert C.run_summary(df).first()["summary"] == (
        "Backup SUCCESS! ID: b-001 | Profile: prod | Type: FULL | Size: 1048576 bytes | Uri: file:///backups/b-001.sql.gz"
    )
    assert C.report_lines(df).first()["line"].startswith("b-001                     | prod            | FULL         | PLAIN_SQL    | 1048576   ")


def test_random_ids(spark):
    df = spark.range(50).withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    ids = [r[0] for r in df.select(C.random_backup_id("t")).collect()]
    assert len(set(ids)) == 50 and all(i.startswith("b-1704067200000-") and len(i) == 24 for i in ids)


def test_registered_alert_streams_send_whole_bodies(spark):
    queries = entry_point.queries()
    sent = lambda name: {(r["id"], r["channel"]): r["body"] for r in queries[name](spark, "/root/testdata/sf0.001").collect()}
    whole, plain = sent("t3_streaming_alerts"), sent("t3_streaming_alerts_plain")
    assert whole and whole.keys() == plain.keys()
    assert all("Details:" in body and "Type:" in body for body in whole.values())
    assert any("Size:" in body for body in whole.values()) and not any("Details:" in body for body in plain.values())
