"""The catalog of backup runs: schema, upsert, history, defaults, state and report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.text import BACKUP_TYPES, DEFAULT_URI, DUMP_FORMATS, blank_to_null, decode_tables, first_given
from keelson.plans.scans import latest_per_key

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("profile_name", T.StringType()),
        T.StructField("backup_type", T.StringType()),
        T.StructField("dump_format", T.StringType()),
        T.StructField("parent_backup_id", T.StringType()),
        T.StructField("backup_chain_id", T.StringType()),
        T.StructField("target_tables", T.ArrayType(T.StringType())),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("destination_uri", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)
CATALOG_COLUMNS = CATALOG_SCHEMA.fieldNames()

#: Fixed value: rows the report shows when no positive limit is given.
REPORT_LIMIT = 20


def current(log: DataFrame) -> DataFrame:
    """Current view of an append-only log: the last written row per id replaces every column, nulls included."""
    return latest_per_key(log, ["id"], ["seq"]).select(*CATALOG_COLUMNS)


def only_database(records: DataFrame, name: str | None) -> DataFrame:
    if name is None or not name.strip():
        return records
    return records.filter(F.col("profile_name") == name)


def history(records: DataFrame, limit: int = 0, name: str | None = None) -> DataFrame:
    """Newest first; a limit of 0 or less means all rows."""
    rows = only_database(records, name).select(*CATALOG_COLUMNS)
    rows = rows.orderBy(F.col("start_time").desc_nulls_last(), F.col("id").asc())
    return rows.limit(limit) if limit > 0 else rows


def lookup(records: DataFrame, backup_id: str) -> DataFrame:
    """The record of one id, or no row."""
    return records.filter(F.col("id") == backup_id).limit(1)


def known_values(backup_type: str = "backup_type", dump_format: str = "dump_format") -> Column:
    """True when both enumerated texts are null or one of the accepted spellings."""
    kind, form = F.col(backup_type), F.col(dump_format)
    return (kind.isNull() | kind.isin(*BACKUP_TYPES)) & (form.isNull() | form.isin(*DUMP_FORMATS))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): a row with unknown enum text does not fail the others."""
    return records.filter(known_values()), records.filter(~known_values())


def report_rows(records: DataFrame) -> DataFrame:
    """The columns of the history report with N/A for missing text and 0 for a missing size."""
    missing = F.lit("N/A")
    return records.select(
        "id",
        F.coalesce("profile_name", missing).alias("profile"),
        F.coalesce("backup_type", missing).alias("type"),
        F.coalesce("dump_format", missing).alias("format"),
        F.coalesce("file_size_bytes", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("status", missing).alias("status"),
        F.coalesce(iso_time("start_time"), missing).alias("start_time"),
    )


def iso_time(c: str) -> Column:
    """ISO text of a timestamp with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def report_lines(records: DataFrame) -> DataFrame:
    """One fixed-width line per record (widths 25, 15, 12, 12, 10, 10 are fixed values)."""
    row = report_rows(records)
    line = F.format_string(
        "%-25s | %-15s | %-12s | %-12s | %-10d | %-10s | %s",
        "id", "profile", "type", "format", "size", "status", "start_time",
    )
    return row.select("id", line.alias("line"))


def run_summary(records: DataFrame) -> DataFrame:
    line = F.format_string(
        "Backup %s! ID: %s | Profile: %s | Type: %s | Size: %d bytes | Uri: %s",
        "status", "id", "profile_name", "backup_type", "file_size_bytes", "destination_uri",
    )
    return records.select("id", line.alias("summary"))


def request_defaults(requests: DataFrame) -> DataFrame:
    """FULL, 'default', no tables and the default URI where a request leaves them out."""
    return (
        requests.withColumn("backup_type", F.coalesce("backup_type", F.lit("FULL")))
        .withColumn("profile_name", F.coalesce("profile_name", F.lit("default")))
        .withColumn("target_tables", F.coalesce("target_tables", F.array().cast("array<string>")))
        .withColumn("destination_uri", F.coalesce("destination_uri", F.lit(DEFAULT_URI)))
    )


def run_states(runs: DataFrame) -> DataFrame:
    """The two rows a run writes: IN_PROGRESS at its start (seq 1), then SUCCESS or FAILED (seq 2).

    ``runs`` has id, start_time, finished_at, bytes and error (null when it went well).
    """
    state = F.explode(F.array(F.lit(1), F.lit(2)))
    both = runs.withColumn("seq", state)
    ended = F.col("seq") == 2
    millis = F.expr("timestampdiff(MILLISECOND, start_time, finished_at)")
    return both.select(
        "id",
        "seq",
        F.when(~ended, F.lit("IN_PROGRESS")).when(F.col("error").isNull(), F.lit("SUCCESS")).otherwise(F.lit("FAILED")).alias("status"),
        "start_time",
        F.when(ended, F.col("finished_at")).alias("end_time"),
        F.when(ended, millis).otherwise(F.lit(0)).cast("bigint").alias("duration_ms"),
        F.when(ended, F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("file_size_bytes"),
        F.when(ended, F.col("error")).alias("error_message"),
    )


def job_defaults(jobs: DataFrame) -> DataFrame:
    """Job rows with all their fields and defaults. ``settings`` is a map that may use dashed or camel-case spellings.

    Lists are comma texts; none is an empty list. A retention rule needs a positive number of chains or days.
    """
    setting = lambda dashed, camel: F.coalesce(F.element_at("settings", dashed), F.element_at("settings", camel))
    kind = F.upper(setting("backup-type", "backupType"))
    true = lambda name: F.coalesce(F.element_at("settings", name) == "true", F.lit(False))
    truth = true("single-transaction") | true("singleTransaction")
    # the same job gets the same id whenever it is read
    made = F.concat(F.lit("job-"), F.substring(F.sha2(F.to_json(F.struct("profile", "database", F.array_sort(F.map_entries("settings")))), 256), 1, 32))
    keep, days = (F.coalesce(F.element_at("settings", n).try_cast("int"), F.lit(0)) for n in ("keep-last", "retention-days"))
    ruled = (keep > 0) | (days > 0)
    return jobs.select(
        F.coalesce("job_id", made).alias("job_id"),
        "profile",
        F.element_at("settings", "cron").alias("cron"),
        decode_tables(F.element_at("settings", "tables")).alias("tables"),
        true("encrypt").alias("encrypt"),
        F.element_at("settings", "passphrase").alias("passphrase"),
        F.when(ruled, F.when(keep > 0, keep).otherwise(F.lit(1))).alias("keep_last"),
        F.when(ruled, days).alias("retention_days"),
        decode_tables(F.element_at("settings", "notifications")).alias("notifications"),
        F.when(kind.isin(*BACKUP_TYPES), kind).otherwise(F.lit("FULL")).alias("backup_type"),
        F.upper(F.coalesce(setting("on-overlap", "onOverlap"), F.lit("SKIP"))).alias("on_overlap"),
        truth.alias("single_transaction"),
        setting("misfire-instruction", "misfireInstruction").alias("misfire_instruction"),
        first_given(
            F.element_at("settings", "output"), F.concat(F.lit("file:///backups/"), F.col("database"), F.lit(".sql.gz"))
        ).alias("output"),
    )


def connection_defaults(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Explicit value, else the named profile's, else the built-in one. ``profiles`` holds one row per profile."""
    found = requests.join(
        profiles.select(
            "profile",
            *[F.col(c).alias(f"p_{c}") for c in ("db_type", "host", "port", "username", "password", "database")],
        ),
        "profile",
        "left",
    )

    def pick(name: str, fallback: str) -> Column:
        return F.coalesce(blank_to_null(name), F.col(f"p_{name}"), F.lit(fallback))

    db_type = pick("db_type", "mysql")
    default_port = F.when(F.lower(db_type).isin("postgresql", "postgres"), F.lit(5432)).otherwise(F.lit(3306))
    return found.select(
        "request_id",
        db_type.alias("db_type"),
        pick("host", "localhost").alias("host"),
        F.coalesce(F.when(F.col("port") > 0, F.col("port")), F.when(F.col("p_port") > 0, F.col("p_port")), default_port).cast("int").alias("port"),
        pick("username", "root").alias("username"),
        pick("password", "").alias("password"),
        pick("database", "mydb").alias("database"),
    )


def database_kind(dump_format: str = "dump_format") -> Column:
    """Database kind a dump format is restored with."""
    form = F.col(dump_format)
    return (
        F.when(form.isin("CUSTOM_FC", "WAL"), F.lit("postgresql"))
        .when(form == "OPLOG", F.lit("mongodb"))
        .otherwise(F.lit("mysql"))
    )


def dump_format(db_type: str = "db_type", asked: str = "asked_format", tables: str = "target_tables") -> Column:
    """Format a backup is written in: selected tables of PostgreSQL use CUSTOM_FC, else what was asked, else PLAIN_SQL."""
    postgres = F.lower(F.col(db_type)).isin("postgresql", "postgres")
    selected = F.size(F.coalesce(F.col(tables), F.array().cast("array<string>"))) > 0
    return F.when(postgres & selected, F.lit("CUSTOM_FC")).otherwise(F.coalesce(F.col(asked), F.lit("PLAIN_SQL")))


def codec_for(compressed: str = "compressed", form: str = "dump_format") -> Column:
    """gzip unless the run asks for none or its format compresses itself."""
    squeeze = F.col(compressed) & F.coalesce(F.col(form) != "CUSTOM_FC", F.lit(True))
    return F.when(squeeze, F.lit("gzip")).otherwise(F.lit("none"))


def backup_id(started: str, *keys: str) -> Column:
    """``b-`` + epoch milliseconds + 8 hex digits taken from a hash of the keys, so a retried task repeats the id."""
    millis = F.unix_millis(F.col(started).cast("timestamp"))
    digits = F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 8)
    return F.concat(F.lit("b-"), millis.cast("string"), F.lit("-"), digits)


def random_backup_id(started: str) -> Column:
    millis = F.unix_millis(F.col(started).cast("timestamp"))
    return F.concat(F.lit("b-"), millis.cast("string"), F.lit("-"), F.substring(F.uuid(), 1, 8))


def state_by_database(records: DataFrame) -> DataFrame:
    """Last FULL, last backup, chain and time per database over successful runs."""
    newest = F.struct("start_time", "id")
    return records.filter("status = 'SUCCESS'").groupBy("profile_name").agg(
        F.max_by("id", F.when(F.col("backup_type") == "FULL", newest)).alias("last_full_backup_id"),
        F.max_by("id", newest).alias("last_backup_id"),
        F.max_by("backup_chain_id", newest).alias("current_chain_id"),
        F.max("start_time").alias("last_backup_time"),
    )


def upsert_state(states: DataFrame, key: str = "profile_name", order: Sequence[str] = ("seq",)) -> DataFrame:
    """One whole state record per database, the last one written; blank names are refused by dropping them."""
    return latest_per_key(states.filter(blank_to_null(key).isNotNull()), [key], list(order))


def roll_up(records: DataFrame, how: str = "rollup") -> DataFrame:
    """Counts, bytes and mean duration per database, type and status: plain, rollup or cube."""
    keys = ["profile_name", "backup_type", "status"]
    grouped = {"plain": records.groupBy, "rollup": records.rollup, "cube": records.cube}[how](*keys)
    extra = [] if how == "plain" else [F.grouping_id().cast("bigint").alias("level")]
    return grouped.agg(*extra, *_measures())


def _measures() -> list[Column]:
    total_ms = F.sum("duration_ms")
    return [
        F.count(F.lit(1)).alias("runs"),
        F.sum("file_size_bytes").cast("bigint").alias("bytes"),
        F.round(total_ms.cast("double") / F.count("duration_ms"), 3).alias("avg_ms"),
    ]


def grouping_sets(records: DataFrame) -> DataFrame:
    """The same measures for the sets (database), (type, status) and the whole."""
    sets = [[F.col("profile_name")], [F.col("backup_type"), F.col("status")], []]
    grouped = records.groupingSets(sets, "profile_name", "backup_type", "status")
    return grouped.agg(F.grouping_id().cast("bigint").alias("level"), *_measures())


def decode_records(raw: DataFrame) -> DataFrame:
    """Catalog rows whose table list is still comma text."""
    return raw.withColumn("target_tables", decode_tables("target_tables"))
