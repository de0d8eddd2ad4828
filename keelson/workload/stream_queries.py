"""Queries that run streams to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators.catalog import CATALOG_COLUMNS
from keelson.plans.backup import Catalog, restore_table
from keelson.session import scratch_path
from keelson.sources.snapshots import TrackedTable
from keelson.streaming import jobs as T
from keelson.workload.catalog_queries import FLAT, flat, run_log
from keelson.workload.fixtures import duck_history, history_of, table
from keelson.workload.registry import query
from keelson.workload.schedule_queries import ALERTS, SLACK, SLACK_PLAIN, TELEGRAM, TELEGRAM_PLAIN

#: One batch of a backup stream.
BATCH_BYTES = 64 << 30

EVENTS = TrackedTable("events", ("event_id",), "ts")


def table_stream(spark, sf_dir, name, batch_bytes=None):
    """A given table as a stream of its files. The glob lets the table be a folder or one file."""
    schema = table(spark, sf_dir, name).schema
    return T.file_stream(spark, f"{sf_dir}/{name}.parque[t]", schema, batch_bytes)


#: Batches that a registered stream arrives in, and files of each.
BATCHES, FILES = 4, 2


def arriving(spark, rows, batches, label):
    """``rows`` as a stream of ``BATCHES`` batches: a row comes in each of its ``batches``, numbers from 0 (null: none)."""
    path, held = scratch_path(spark, label), rows.withColumn("_batch", batches)
    for k in range(BATCHES):
        held.filter(F.array_contains("_batch", k)).drop("_batch").repartition(FILES).write.mode("append").parquet(path)
    return T.file_stream(spark, path, rows.schema, batch_files=FILES)


@query("t1_streaming_backup", "select * from events")
def streaming_backup(spark, sf_dir):
    """Events committed to the catalog batch by batch, then restored as a chain."""
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "stream-backup")
    catalog = Catalog(spark, f"{root}/catalog")
    stream = arriving(spark, events, F.array(F.pmod("event_id", F.lit(BATCHES))), "stream-events")
    newest = T.backup_stream(stream, EVENTS, catalog, root, "app", "live", f"{root}/_checkpoint")
    return restore_table(catalog, newest, EVENTS, root, "app", schema=events.schema).select(*events.columns)


@query("t2_streaming_upsert", duck_history(f"select {FLAT} from raw_history"))
def streaming_upsert(spark, sf_dir):
    """The run log as a stream of starts and ends, some late and some twice; the newest status per id."""
    sink = scratch_path(spark, "upsert")
    log = run_log(history_of(table(spark, sf_dir, "events")))
    number = F.substring("id", 3, 20).cast("bigint")
    # ends come a batch after or before their starts, and every 13th row again with the last batch
    batch = F.pmod(number + F.col("seq") * F.when(number % 5 == 0, -1).otherwise(1), F.lit(BATCHES))
    stream = arriving(spark, log, F.array(batch, F.when(number % 13 == 0, F.lit(BATCHES - 1).cast("bigint"))), "run-log")
    return flat(T.upsert_stream(stream, sink, f"{sink}-checkpoint").select(*CATALOG_COLUMNS))


def alert_bodies(slack: str, telegram: str) -> str:
    return duck_history(
        f"select id, 'slack' as channel, {slack} as body from heads union all "
        f"select id, 'telegram', cast(to_json({{'chat_id': 'ops', 'text': {telegram}, 'parse_mode': 'HTML'}}) as varchar) from heads",
        ALERTS,
    )


def alerts_sent(spark, sf_dir, details):
    sink = scratch_path(spark, "alerts")
    stream = history_of(table_stream(spark, sf_dir, "events", BATCH_BYTES))
    return T.alert_stream(stream, sink, f"{sink}-checkpoint", ["Slack", "telegram", "fax"], "ops", details)


@query("t3_streaming_alerts", alert_bodies(SLACK, TELEGRAM))
def streaming_alerts(spark, sf_dir):
    """Whole bodies, with the details of each run."""
    return alerts_sent(spark, sf_dir, True)


@query("t3_streaming_alerts_plain", alert_bodies(SLACK_PLAIN, TELEGRAM_PLAIN))
def plain_streaming_alerts(spark, sf_dir):
    """As runs send them: without details."""
    return alerts_sent(spark, sf_dir, False)


@query("t3_streaming_alerts_with_details", alert_bodies(SLACK, TELEGRAM))
def detailed_streaming_alerts(spark, sf_dir):
    return alerts_sent(spark, sf_dir, True)


@query(
    "t4_run_rates",
    duck_history(
        "select * from (select date_trunc('hour', start_time) as window_start, date_trunc('hour', start_time) + interval 1 hour as window_end, "
        "count(*) as runs, count(*) filter (status = 'FAILED') as failures from raw_history group by 1, 2) x "
        "where window_end <= (select max(start_time) - interval 2 hour from raw_history)"
    ),
)
def run_rates(spark, sf_dir):
    """Hourly runs and failures of the windows that the watermark has closed."""
    # one batch: the table's files have no arrival order, and none of its rows may count as late
    rows = history_of(table_stream(spark, sf_dir, "events")).select("id", "start_time", "status")
    sink = scratch_path(spark, "windows")
    return T.closed_windows(T.run_rates(rows), sink, f"{sink}-checkpoint")


# The quarter a run starts in decides its batch; every seventh comes a batch late, every 17th comes again with the batch after, every
# 29th comes with the last. A batch of number b drops rows up to the newest time of the batches up to b - 2, less the delay.
QUARTERS = ["2024-01-08 12:00:00", "2024-01-16 00:00:00", "2024-01-23 12:00:00"]
LATE = (
    "base as (select *, cast(substr(id, 3) as bigint) as n, "
    + " + ".join(f"cast(start_time >= timestamp '{q}' as int)" for q in QUARTERS)
    + " as quarter from raw_history), "
    "arrived as (select *, least(3, quarter + cast(n % 7 = 0 as int)) as b from base where n % 29 <> 0 union all select *, 3 from base where n % 29 = 0 "
    "union all select *, least(3, quarter + 1) from base where n % 17 = 0), "
    "marks as (select b, max(date_trunc('milliseconds', start_time)) - interval 2 hour as newest from arrived group by b), "
    "kept as (select distinct a.id, a.profile_name, a.start_time, a.status from arrived a where not exists "
    "(select 1 from marks m where m.b <= a.b - 2 and a.start_time <= m.newest)), "
    "final as (select max(newest) as mark from marks)"
)


def late_arrivals(spark, sf_dir):
    rows = history_of(table(spark, sf_dir, "events")).select("id", "profile_name", "start_time", "status")
    number = F.substring("id", 3, 20).cast("bigint")
    quarter = sum((F.col("start_time") >= F.lit(q).cast("timestamp_ntz")).cast("int") for q in QUARTERS)
    on = F.when(number % 29 == 0, 3).otherwise(F.least(F.lit(3), quarter + (number % 7 == 0).cast("int")))
    again = F.when(number % 17 == 0, F.least(F.lit(3), quarter + 1))
    return arriving(spark, rows, F.array(on, again), "late-runs")


@query(
    "t4_late_run_rates",
    duck_history(
        "select * from (select date_trunc('hour', start_time) as window_start, date_trunc('hour', start_time) + interval 1 hour as window_end, "
        "count(*) as runs, count(*) filter (status = 'FAILED') as failures from kept group by 1, 2) x where window_end <= (select mark from final)",
        LATE,
    ),
)
def late_run_rates(spark, sf_dir):
    """Hourly rates over several batches with late and repeated records."""
    sink = scratch_path(spark, "late-windows")
    return T.closed_windows(T.run_rates(late_arrivals(spark, sf_dir), unique="id"), sink, f"{sink}-checkpoint")


@query(
    "t4_run_sessions",
    duck_history(
        "select profile_name, min(start_time) as session_start, max(start_time) + interval 30 minute as session_end, count(*) as runs, "
        "count(*) filter (status = 'FAILED') as failures from (select *, sum(case when start_time <= before + interval 30 minute then 0 else 1 end) "
        "over (partition by profile_name order by start_time, id) as s from (select *, lag(start_time) over (partition by profile_name order by start_time, id) as before "
        "from kept) x) y group by profile_name, s having max(start_time) + interval 30 minute <= (select mark from final)",
        LATE,
    ),
)
def run_sessions(spark, sf_dir):
    """Sessions of each database's runs over the same batches."""
    sink = scratch_path(spark, "sessions")
    return T.closed_windows(T.run_sessions(late_arrivals(spark, sf_dir), "profile_name", unique="id"), sink, f"{sink}-checkpoint")
