"""Inputs of the registered queries, derived from the given tables by plain projections.

Each text is used by Spark and by the checking engine; ``{...}`` marks the few places where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.operators.catalog import CATALOG_COLUMNS, decode_records

SPARK = {
    "text": "string",
    "after_ms": "ts + make_dt_interval(0, 0, 0, cast(round(value * 1000) as decimal(18, 0)) / 1000)",
}
DUCK = {
    "text": "varchar",
    "after_ms": "ts + to_milliseconds(cast(round(value * 1000) as bigint))",
}

# Eight neighbouring events form a chain: a FULL, then increments, with a DIFFERENTIAL in the middle. A third of the
# chains belong to one database. Some chains have a blank, dangling or circular link, or a different table list.
HISTORY = """
 g as (select *, event_id % 8 as n, event_id - event_id % 8 as base,
        cast(floor(event_id / 8) as bigint) as c from events),
 raw_history as (select
   concat('b-', cast(event_id as {text})) as id,
   case when c % 41 = 0 then null when c % 3 = 0 then 'db0' else concat('db', cast(c % 20 as {text})) end as profile_name,
   case when n = 0 then 'FULL' when n = 4 then 'DIFFERENTIAL' else 'INCREMENTAL' end as backup_type,
   case event_id % 7 when 0 then 'CUSTOM_FC' when 1 then 'BINLOG' when 2 then 'WAL' when 3 then 'OPLOG'
        when 4 then null else 'PLAIN_SQL' end as dump_format,
   case when n = 0 then case when c % 7 = 0 then ' ' else null end
        when event_id % 97 = 0 then concat('gone-', cast(event_id as {text}))
        when event_id % 101 = 1 then concat('b-', cast(event_id as {text}))
        when c % 29 = 0 and n = 1 then concat('b-', cast(base + 2 as {text}))
        when c % 31 = 0 and n = 5 then concat('b-', cast(base + 7 as {text}))
        when n = 4 then concat('b-', cast(base as {text}))
        else concat('b-', cast(event_id - 1 as {text})) end as parent_backup_id,
   case when n = 0 or event_type = 'view' or c % 29 = 0 or c % 31 = 0 then null
        when event_id % 101 = 1 then '' else concat('b-', cast(base as {text})) end as backup_chain_id,
   case when event_id % 31 = 5 then 'users' when c % 3 = 0 then '' when c % 3 = 1 then 'users,orders'
        when n % 2 = 0 then ' orders , users,' else 'users,orders,users' end as target_tables,
   ts as start_time,
   case when event_type = 'error' then null else {after_ms} end as end_time,
   cast(round(value * 1000) as bigint) as duration_ms,
   case when event_type = 'signup' then null else cast(round(value * 1000) as bigint) * 7 end as file_size_bytes,
   case when event_id % 13 = 0 then null
        when event_id % 11 = 0 then concat('file:///backups/shared-', cast(c % 50 as {text}), '.sql.gz')
        when c % 5 = 0 then concat('s3://bucket-', cast(c % 4 as {text}), '/b/', cast(event_id as {text}))
        when c % 5 = 1 then concat('AZ://box/', cast(event_id as {text}))
        when c % 5 = 2 then concat('gs:store/k/', cast(event_id as {text}))
        when c % 5 = 3 then concat('/plain/path/', cast(event_id as {text}))
        else concat('ftp://elsewhere/', cast(event_id as {text})) end as destination_uri,
   case event_type when 'error' then 'FAILED' when 'signup' then 'IN_PROGRESS' else 'SUCCESS' end as status,
   case when event_type = 'error' then concat('exit code ', cast(event_id % 7 as {text})) end as error_message
  from g)
"""

# A trigger log: a third of the triggers belong to job 0.
TRIGGERS = """
 triggers as (select event_id as trigger_id, case when event_id % 3 = 0 then 0 else user_id % 20 end as job_id,
   ts as start_time, cast(round(value * 1000) as bigint) * {scale} as duration_us from events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history_of(events: DataFrame) -> DataFrame:
    """Catalog rows with decoded table lists, from a batch or a stream of events."""
    text = f"with {HISTORY.format(**SPARK)} select {', '.join(CATALOG_COLUMNS)} from raw_history"
    rows = events.sparkSession.sql(text.replace("from events", "from {events}"), events=events)
    return decode_records(rows)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(table(spark, sf_dir, "events"))


def triggers(spark: SparkSession, sf_dir: str, scale: int = 100_000) -> DataFrame:
    text = f"with {TRIGGERS.format(scale=scale)} select * from triggers"
    return spark.sql(text.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def duck_history(select: str, more: str = "", recursive: bool = False) -> str:
    """Checking SQL over the history rows."""
    head = "with recursive" if recursive else "with"
    return f"{head} {HISTORY.format(**DUCK)} {',' + more if more else ''} {select}"


def duck_triggers(select: str, more: str = "", scale: int = 100_000, recursive: bool = False) -> str:
    head = "with recursive" if recursive else "with"
    return f"{head} {TRIGGERS.format(scale=scale)} {',' + more if more else ''} {select}"
