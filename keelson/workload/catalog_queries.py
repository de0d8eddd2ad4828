"""Queries over the backup catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions.text import encode_tables, safe_name, table_set
from keelson.operators import catalog as C
from keelson.plans.scans import slice_rows
from keelson.workload.fixtures import duck_history, history, table
from keelson.workload.registry import query

LIST = "[trim(x) for x in string_split(coalesce(target_tables, ''), ',') if trim(x) <> '']"
TABLES = f"array_to_string({LIST}, ',')"
ISO = "strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f')"
NAMES = ", ".join(C.CATALOG_COLUMNS)
FLAT = NAMES.replace("target_tables", f"{TABLES} as target_tables")


def flat(df):
    """Table lists as comma text, so that results compare as plain values."""
    return df.withColumn("target_tables", encode_tables("target_tables"))


def run_log(rows):
    """Each record twice: its start and its end, as an append-only log holds them."""
    both = rows.withColumn("seq", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    started = F.col("seq") == 1
    return (
        both.withColumn("status", F.when(started, F.lit("IN_PROGRESS")).otherwise(F.col("status")))
        .withColumn("end_time", F.when(~started, F.col("end_time")))
        .withColumn("error_message", F.when(started, F.lit("pending")).otherwise(F.col("error_message")))
        .withColumn("file_size_bytes", F.when(started, F.lit(0).cast("bigint")).otherwise(F.col("file_size_bytes")))
    )


@query("p1_history_filter", duck_history(f"select {FLAT} from raw_history where profile_name = 'db0'"))
def history_filter(spark, sf_dir):
    return flat(C.only_database(history(spark, sf_dir), "db0"))


@query("p2_fixed_projection", duck_history(f"select {FLAT} from raw_history"))
def fixed_projection(spark, sf_dir):
    return flat(history(spark, sf_dir).select(*C.CATALOG_COLUMNS))


@query("p3_point_lookup", duck_history(f"select {FLAT} from raw_history where id = 'b-77'"))
def point_lookup(spark, sf_dir):
    return flat(C.lookup(history(spark, sf_dir), "b-77"))


BAD = (
    "select id, case when cast(substr(id, 3) as bigint) % 17 = 0 then 'WEEKLY' else backup_type end as backup_type, "
    "case when cast(substr(id, 3) as bigint) % 23 = 0 then 'ZIP' else dump_format end as dump_format from raw_history"
)


def with_bad_rows(spark, sf_dir):
    number = F.substring("id", 3, 20).cast("bigint")
    rows = history(spark, sf_dir)
    return rows.withColumn("backup_type", F.when(number % 17 == 0, "WEEKLY").otherwise(F.col("backup_type"))).withColumn(
        "dump_format", F.when(number % 23 == 0, "ZIP").otherwise(F.col("dump_format"))
    )


@query(
    "p4_enum_quarantine",
    duck_history(
        "select id, backup_type, dump_format, (backup_type <> 'WEEKLY' and coalesce(dump_format, '') <> 'ZIP') as valid from bad",
        f"bad as ({BAD})",
    ),
)
def enum_quarantine(spark, sf_dir):
    valid, quarantine = C.split_valid(with_bad_rows(spark, sf_dir))
    columns = ["id", "backup_type", "dump_format"]
    return valid.select(*columns, F.lit(True).alias("valid")).unionAll(
        quarantine.select(*columns, F.lit(False).alias("valid"))
    )


@query(
    "p5_report_defaults",
    duck_history(
        "select id, coalesce(profile_name, 'N/A') as profile, coalesce(backup_type, 'N/A') as type, "
        "coalesce(dump_format, 'N/A') as format, coalesce(file_size_bytes, 0) as size, "
        f"coalesce(status, 'N/A') as status, coalesce({ISO}, 'N/A') as start_time from raw_history"
    ),
)
def report_defaults(spark, sf_dir):
    return C.report_rows(history(spark, sf_dir))


def runs(spark, sf_dir):
    return history(spark, sf_dir).select(
        "id",
        "start_time",
        F.expr("start_time + make_dt_interval(0, 0, 0, cast(duration_ms as decimal(18, 0)) / 1000)").alias("finished_at"),
        F.col("file_size_bytes").alias("bytes"),
        F.col("error_message").alias("error"),
    )


@query(
    "p6_run_states",
    duck_history(
        "select id, cast(1 as integer) as seq, 'IN_PROGRESS' as status, start_time, cast(null as timestamp) as end_time, "
        "cast(0 as bigint) as duration_ms, cast(0 as bigint) as file_size_bytes, cast(null as varchar) as error_message "
        "from raw_history union all "
        "select id, 2, case when error_message is null then 'SUCCESS' else 'FAILED' end, start_time, "
        "start_time + to_milliseconds(duration_ms), duration_ms, coalesce(file_size_bytes, 0), error_message from raw_history"
    ),
)
def run_states(spark, sf_dir):
    return C.run_states(runs(spark, sf_dir))


@query(
    "p7_request_defaults",
    duck_history(
        "select id, coalesce(nullif(backup_type, 'FULL'), 'FULL') as backup_type, coalesce(profile_name, 'default') as profile_name, "
        f"{TABLES} as target_tables, coalesce(destination_uri, 'file:///backups/backup.sql') as destination_uri from raw_history"
    ),
)
def request_defaults(spark, sf_dir):
    rows = history(spark, sf_dir)
    rows = rows.withColumn("backup_type", F.when(F.col("backup_type") != "FULL", F.col("backup_type")))
    rows = rows.withColumn("target_tables", F.when(F.size("target_tables") > 0, F.col("target_tables")))
    done = flat(C.request_defaults(rows))
    return done.select("id", "backup_type", "profile_name", "target_tables", "destination_uri")


def jobs(spark, sf_dir):
    """One backup job per customer with settings in the two spellings."""
    key = F.col("c_custkey")
    kinds = F.array(*[F.lit(v) for v in ("full", "Incremental", "weekly", "DIFFERENTIAL")])
    policies = F.array(*[F.lit(v) for v in ("skip", "QUEUE", "cancel_previous")])
    type_key = F.when(key % 2 == 0, "backup-type").otherwise("backupType")
    settings = F.map_filter(
        F.map_from_arrays(
            F.array(
                type_key,
                *[F.lit(n) for n in ("onOverlap", "single-transaction", "output", "misfireInstruction", "cron", "tables")],
                *[F.lit(n) for n in ("encrypt", "passphrase", "keep-last", "retention-days", "notifications")],
            ),
            F.array(
                F.when(key % 5 > 0, F.element_at(kinds, (key % 4 + 1).cast("int"))),
                F.when(key % 7 > 0, F.element_at(policies, (key % 3 + 1).cast("int"))),
                F.when(key % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
                F.when(key % 3 == 0, F.concat(F.lit("s3://jobs/"), key.cast("string"))).when(key % 3 == 1, F.lit(" ")),
                F.when(key % 4 == 0, F.lit("FIRE_ONCE")),
                F.when(key % 6 > 0, F.concat(F.lit("0 "), (key % 24).cast("string"), F.lit(" * * *"))),
                F.when(key % 4 == 1, F.lit(" users, ,orders ")).when(key % 4 == 2, F.lit("")),
                F.when(key % 6 == 0, F.lit("true")).when(key % 6 == 1, F.lit("false")),
                F.when(key % 6 == 0, F.concat(F.lit("pass-"), key.cast("string"))),
                F.when(key % 8 == 0, F.lit("many")).when(key % 2 == 1, (key % 9).cast("string")),
                F.when(key % 5 > 1, (key % 30 - 2).cast("string")),
                F.when(key % 3 == 1, F.lit("telegram, slack")),
            ),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job-"), key.cast("string")).alias("job_id"),
        F.concat(F.lit("p"), (key % 120).cast("string")).alias("profile"),
        settings.alias("settings"),
        F.concat(F.lit("db"), F.col("c_nationkey").cast("string")).alias("database"),
    )


@query(
    "p8_job_defaults",
    """
    select concat('job-', cast(c_custkey as varchar)) as job_id, concat('p', cast(c_custkey % 120 as varchar)) as profile,
      case when c_custkey % 5 = 0 then 'FULL' else case c_custkey % 4 when 1 then 'INCREMENTAL' when 3 then 'DIFFERENTIAL' else 'FULL' end end as backup_type,
      case when c_custkey % 7 = 0 then 'SKIP' else case c_custkey % 3 when 0 then 'SKIP' when 1 then 'QUEUE' else 'CANCEL_PREVIOUS' end end as on_overlap,
      c_custkey % 2 = 0 as single_transaction,
      case when c_custkey % 4 = 0 then 'FIRE_ONCE' end as misfire_instruction,
      case when c_custkey % 3 = 0 then concat('s3://jobs/', cast(c_custkey as varchar))
           else concat('file:///backups/db', cast(c_nationkey as varchar), '.sql.gz') end as output,
      case when c_custkey % 6 > 0 then concat('0 ', cast(c_custkey % 24 as varchar), ' * * *') end as cron,
      case when c_custkey % 4 = 1 then 'users,orders' else '' end as tables, c_custkey % 6 = 0 as encrypt,
      case when c_custkey % 6 = 0 then concat('pass-', cast(c_custkey as varchar)) end as passphrase,
      case when kn > 0 then kn when dn > 0 then 1 end as keep_last, case when kn > 0 or dn > 0 then dn end as retention_days,
      case when c_custkey % 3 = 1 then 'telegram,slack' else '' end as notifications
    from (select *, cast(case when c_custkey % 2 = 1 then c_custkey % 9 else 0 end as integer) as kn,
      cast(case when c_custkey % 5 > 1 then c_custkey % 30 - 2 else 0 end as integer) as dn from customer) c
    """,
)
def job_defaults(spark, sf_dir):
    lists = {name: encode_tables(name) for name in ("tables", "notifications")}
    return C.job_defaults(jobs(spark, sf_dir)).withColumns(lists)


@query(
    "p9_connection_defaults",
    """
    with asked as (select concat('r', cast(c_custkey as varchar)) as request_id, concat('p', cast(c_custkey % 120 as varchar)) as profile,
        case when c_custkey % 6 = 0 then 'postgres' when c_custkey % 6 = 1 then ' ' end as db_type,
        case when c_custkey % 5 = 0 then concat('host-', cast(c_custkey as varchar)) end as host,
        case when c_custkey % 9 = 0 then 6000 else 0 end as port,
        case when c_custkey % 4 = 0 then c_name end as database from customer),
      prof as (select concat('p', cast(s_suppkey as varchar)) as profile, case when s_suppkey % 2 = 0 then 'postgresql' else 'mysql' end as db_type,
        concat('s', cast(s_nationkey as varchar)) as host, case when s_suppkey % 3 = 0 then 0 else 7000 end as port, s_name as username,
        'erp' as database from supplier)
    select request_id, coalesce(nullif(trim(a.db_type), ''), p.db_type, 'mysql') as db_type, coalesce(a.host, p.host, 'localhost') as host,
      cast(case when a.port > 0 then a.port when p.port > 0 then p.port
           when coalesce(nullif(trim(a.db_type), ''), p.db_type, 'mysql') in ('postgres', 'postgresql') then 5432 else 3306 end as integer) as port,
      coalesce(p.username, 'root') as username, '' as password, coalesce(a.database, p.database, 'mydb') as database
    from asked a left join prof p on a.profile = p.profile
    """,
)
def connection_defaults(spark, sf_dir):
    key, supplier = F.col("c_custkey"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    asked = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("r"), key.cast("string")).alias("request_id"),
        F.concat(F.lit("p"), (key % 120).cast("string")).alias("profile"),
        F.when(key % 6 == 0, "postgres").when(key % 6 == 1, " ").alias("db_type"),
        F.when(key % 5 == 0, F.concat(F.lit("host-"), key.cast("string"))).alias("host"),
        F.when(key % 9 == 0, 6000).otherwise(0).alias("port"),
        none.alias("username"),
        none.alias("password"),
        F.when(key % 4 == 0, F.col("c_name")).alias("database"),
    )
    profiles = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), supplier.cast("string")).alias("profile"),
        F.when(supplier % 2 == 0, "postgresql").otherwise("mysql").alias("db_type"),
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("host"),
        F.when(supplier % 3 == 0, 0).otherwise(7000).alias("port"),
        F.col("s_name").alias("username"),
        none.alias("password"),
        F.lit("erp").alias("database"),
    )
    return C.connection_defaults(asked, profiles)


@query(
    "p10_database_kind",
    duck_history(
        "select id, dump_format, case when dump_format in ('CUSTOM_FC', 'WAL') then 'postgresql' when dump_format = 'OPLOG' "
        "then 'mongodb' else 'mysql' end as db_kind from raw_history"
    ),
)
def database_kind(spark, sf_dir):
    return history(spark, sf_dir).select("id", "dump_format", C.database_kind().alias("db_kind"))


@query(
    "p11_report_lines",
    duck_history(
        "select id, format('{:<25} | {:<15} | {:<12} | {:<12} | {:<10} | {:<10} | {}', id, coalesce(profile_name, 'N/A'), "
        "backup_type, coalesce(dump_format, 'N/A'), coalesce(file_size_bytes, 0), status, "
        f"{ISO}) as line from raw_history"
    ),
)
def report_lines(spark, sf_dir):
    return C.report_lines(history(spark, sf_dir))


@query(
    "p12_run_summary",
    duck_history(
        "select id, concat('Backup ', coalesce(status, 'null'), '! ID: ', id, ' | Profile: ', coalesce(profile_name, 'null'), ' | Type: ', "
        "coalesce(backup_type, 'null'), ' | Size: ', coalesce(cast(file_size_bytes as varchar), 'null'), ' bytes | Uri: ', "
        "coalesce(destination_uri, 'null')) as summary from raw_history"
    ),
)
def run_summary(spark, sf_dir):
    return C.run_summary(history(spark, sf_dir))


@query("c1_catalog_schema", duck_history(f"select {FLAT} from raw_history"))
def catalog_schema(spark, sf_dir):
    """A catalog folder made from the history: what is stored has the catalog's columns."""
    from keelson.plans.backup import Catalog
    from keelson.session import scratch_path

    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    catalog.append(history(spark, sf_dir))
    return flat(catalog.current())


@query("c2_upsert", duck_history(f"select {FLAT} from raw_history"))
def upsert(spark, sf_dir):
    return flat(C.current(run_log(history(spark, sf_dir))))


@query("c3_table_lists", duck_history(f"select id, {TABLES} as tables, cast(len({LIST}) as integer) as n from raw_history"))
def table_lists(spark, sf_dir):
    rows = history(spark, sf_dir)
    return rows.select("id", encode_tables("target_tables").alias("tables"), F.size("target_tables").alias("n"))


@query(
    "c4_backup_id",
    "select event_id, concat('b-', cast(epoch_us(ts) // 1000 as varchar), '-', substr(sha256(concat_ws('|', cast(event_id as varchar), "
    "cast(user_id as varchar))), 1, 8)) as id from events",
)
def backup_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.backup_id("ts", "event_id", "user_id").alias("id"))


STATES = (
    "states as (select case when event_id % 5 = 0 then ' ' else concat('db', cast(user_id % 20 as {text})) end as profile_name, "
    "event_id as seq, ts as last_backup_time, event_type as last_position from events)"
)


@query(
    "c5_state_upsert",
    f"with {STATES.format(text='varchar')} select profile_name, max(seq) as seq, max_by(last_backup_time, seq) as last_backup_time, "
    "max_by(last_position, seq) as last_position from states where trim(profile_name) <> '' group by 1",
)
def state_upsert(spark, sf_dir):
    text = f"with {STATES.format(text='string')} select * from states".replace("from events", "from {events}")
    return C.upsert_state(spark.sql(text, events=table(spark, sf_dir, "events")))


@query("c6_safe_names", "select page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') as safe from pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_name("url").alias("safe"))


@query(
    "c7_state_derivation",
    duck_history(
        "select profile_name, max_by(id, start_time) filter (backup_type = 'FULL') as last_full_backup_id, max_by(id, start_time) as last_backup_id, "
        "(array_agg(backup_chain_id order by start_time desc))[1] as current_chain_id, max(start_time) as last_backup_time "
        "from raw_history where status = 'SUCCESS' group by 1"
    ),
)
def state_derivation(spark, sf_dir):
    return C.state_by_database(history(spark, sf_dir))


@query(
    "o1_sorted_history",
    duck_history("select id, profile_name, start_time, status from raw_history order by start_time desc nulls last, id"),
)
def sorted_history(spark, sf_dir):
    return C.history(history(spark, sf_dir)).select("id", "profile_name", "start_time", "status")


@query(
    "o2_top_history",
    duck_history("select id, profile_name, start_time, status from raw_history order by start_time desc nulls last, id limit 20"),
)
def top_history(spark, sf_dir):
    return C.history(history(spark, sf_dir), C.REPORT_LIMIT).select("id", "profile_name", "start_time", "status")


MEASURES = (
    "count(*) as runs, cast(sum(file_size_bytes) as bigint) as bytes, "
    "round(cast(sum(duration_ms) as double) / count(duration_ms), 3) as avg_ms from raw_history group by "
)
KEYS = "profile_name, backup_type, status"


@query("a1_group_aggregate", duck_history(f"select {KEYS}, {MEASURES} {KEYS}"))
def group_aggregate(spark, sf_dir):
    return C.roll_up(history(spark, sf_dir), "plain")


@query(
    "a2_latest_with_fallback",
    duck_history("select coalesce(profile_name, 'default') as db, max(coalesce(end_time, start_time)) as latest from raw_history group by 1"),
)
def latest_with_fallback(spark, sf_dir):
    rows = history(spark, sf_dir)
    return rows.groupBy(F.coalesce("profile_name", F.lit("default")).alias("db")).agg(
        F.max(F.coalesce("end_time", "start_time")).alias("latest")
    )


@query("a4_rollup", duck_history(f"select {KEYS}, cast(grouping({KEYS}) as bigint) as level, {MEASURES} rollup ({KEYS})"))
def rollup(spark, sf_dir):
    return C.roll_up(history(spark, sf_dir), "rollup")


@query("a4_cube", duck_history(f"select {KEYS}, cast(grouping({KEYS}) as bigint) as level, {MEASURES} cube ({KEYS})"))
def cube(spark, sf_dir):
    return C.roll_up(history(spark, sf_dir), "cube")


@query(
    "a4_grouping_sets",
    duck_history(
        f"select {KEYS}, cast(grouping({KEYS}) as bigint) as level, {MEASURES} grouping sets ((profile_name), (backup_type, status), ())"
    ),
)
def grouping_sets(spark, sf_dir):
    return C.grouping_sets(history(spark, sf_dir))


@query(
    "w4_previous_run",
    duck_history(
        "select id, profile_name, lag(id) over w as previous_id, lead(id) over w as next_id from raw_history "
        "window w as (partition by profile_name order by start_time, id)"
    ),
)
def previous_run(spark, sf_dir):
    """Neighbouring runs of each database, scanned in slices when one database is large."""
    rows = history(spark, sf_dir).select("id", F.coalesce("profile_name", F.lit("")).alias("db"), "profile_name", "start_time")
    cut = slice_rows(rows, ["db"], [F.col("start_time").asc(), F.col("id").asc()])
    here = cut.rows.withColumn("_prev", F.lag("id").over(cut.window())).withColumn("_next", F.lead("id").over(cut.window()))
    place = F.struct("start_time", "id")
    both = cut.with_carry(here, {"_last": F.max_by("id", place)}, {"_before": lambda w: F.last("_last").over(w)})
    both = cut.with_carry(both, {"_first": F.min_by("id", place)}, {"_after": lambda w: F.last("_first").over(w)}, backward=True)
    return both.select(
        "id", "profile_name", F.coalesce("_prev", "_before").alias("previous_id"), F.coalesce("_next", "_after").alias("next_id")
    )


@query(
    "u2_equal_table_sets",
    duck_history(
        f"select id, list_sort(list_distinct({LIST})) = ['orders', 'users'] as same, array_to_string(list_sort(list_distinct({LIST})), ',') as tables "
        "from raw_history"
    ),
)
def equal_table_sets(spark, sf_dir):
    mine = table_set("target_tables")
    return history(spark, sf_dir).select(
        "id", (mine == F.array(F.lit("orders"), F.lit("users"))).alias("same"), F.array_join(mine, ",").alias("tables")
    )


@query(
    "f13_json_state",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, "
    "concat('{\"databaseName\":\"db', cast(user_id % 20 as varchar), '\",\"lastPosition\":\"', event_type, '\"}') as state from events",
)
def json_state(spark, sf_dir):
    """State documents written as JSON, and a JSON field read back."""
    rows = table(spark, sf_dir, "events")
    state = F.struct(
        F.concat(F.lit("db"), (F.col("user_id") % 20).cast("string")).alias("databaseName"),
        F.col("event_type").alias("lastPosition"),
    )
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(state).alias("state"))
