"""A backup run and a restore, end to end: snapshot files, catalog rows, chains and replay."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import crypto
from keelson.operators import catalog as C
from keelson.operators import chains as K
from keelson.operators.replay import replay
from keelson.operators.retention import cleanup_set, object_delete_plan
from keelson.plans.chain_index import ChainIndex
from keelson.plans.scans import latest_per_key
from keelson.sources import sealed as S
from keelson.sources.listing import list_objects
from keelson.sources.snapshots import TrackedTable, full_rows, read_snapshots, rows_between, segment_name, write_snapshot

LOG_SCHEMA = T.StructType(
    [*C.CATALOG_SCHEMA.fields, T.StructField("seq", T.LongType()), T.StructField("last_position", T.StringType()), T.StructField("sealed", T.BooleanType())]
)


class ChainError(ValueError):
    """A backup that cannot be made or restored as part of its chain."""


class Catalog:
    """An append-only Parquet log of run records. Writers append; readers see the last row per id.

    With ``indexed`` an index of parent links is kept beside the log and extended by each append, so that resolving one target reads its
    own lineage and not the whole catalog.
    """

    def __init__(self, spark: SparkSession, path: str, indexed: bool = False):
        self.spark = spark
        self.path = path
        spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").parquet(path)
        self.index = ChainIndex(spark, f"{path.rstrip('/')}@index") if indexed else None

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def append(self, records: DataFrame) -> None:
        missing = {"seq": F.lit(time.time_ns()).cast("bigint"), "last_position": F.lit(None).cast("string"), "sealed": F.lit(None).cast("boolean")}
        for name, value in missing.items():
            if name not in records.columns:
                records = records.withColumn(name, value)
        records.select(*LOG_SCHEMA.fieldNames()).write.mode("append").parquet(self.path)
        if self.index:
            self.index.extend(self.log())

    def resolve_target(self, target_id: str) -> tuple[str | None, str | None, DataFrame]:
        """(verdict, id the walk ends at, lineage) of one target."""
        return (self.index or K).resolve_target(self.current(), target_id)

    def restore_steps(self, target_id: str, any_status: bool = False) -> DataFrame:
        """(target_id, step, id) of one target, or an error that says why it cannot be restored."""
        return restorable(*self.resolve_target(target_id), target_id, any_status)

    def current(self) -> DataFrame:
        return C.current(self.log())

    def with_positions(self) -> DataFrame:
        return latest_per_key(self.log(), ["id"], ["seq"]).drop("seq")

    def compact(self, path: str) -> Catalog:
        """The current view as a new log at another path; the old log stays as it is."""
        latest_per_key(self.log(), ["id"], ["seq"]).write.mode("overwrite").parquet(path)
        return Catalog(self.spark, path)


@dataclass(frozen=True)
class BackupRequest:
    database: str
    tables: Sequence[TrackedTable]
    cut: Any
    root: str
    backup_type: str = "FULL"
    parent_id: str | None = None
    chain_id: str | None = None
    dump_format: str | None = None
    compressed: bool = True
    backup_id: str | None = None
    selected: tuple[str, ...] = ()
    #: With a passphrase the run is sealed: only cipher text is written.
    passphrase: str | None = field(default=None, repr=False)
    segment_bytes: int = crypto.SEGMENT_BYTES

    @property
    def sealed(self) -> bool:
        return bool(self.passphrase and self.passphrase.strip())


def run_backup(catalog: Catalog, request: BackupRequest, read: Callable[[str], DataFrame]) -> dict[str, Any]:
    """Write one snapshot step of every table and log the run as IN_PROGRESS, then SUCCESS or FAILED."""
    spark = catalog.spark
    known = catalog.with_positions()
    started = datetime.now()
    backup_id = request.backup_id or f"b-{int(started.timestamp() * 1000)}-{uuid.uuid4().hex[:8]}"
    record = dict.fromkeys(LOG_SCHEMA.fieldNames())
    record.update(
        id=backup_id,
        profile_name=request.database or "default",
        backup_type=request.backup_type or "FULL",
        dump_format=request.dump_format or "PLAIN_SQL",
        parent_backup_id=request.parent_id,
        backup_chain_id=request.chain_id,
        target_tables=list(request.selected),
        start_time=started,
        duration_ms=0,
        file_size_bytes=0,
        destination_uri=run_uri(request.root, request.database, backup_id),
        status="IN_PROGRESS",
        last_position=str(request.cut),
        sealed=request.sealed,
    )
    asked = spark.createDataFrame([_log_row(record)], LOG_SCHEMA)
    looked = K.with_parent(asked, known, "id", "backup_chain_id", "target_tables", "last_position", "status")
    admitted = looked.select(
        K.inherited_chain().alias("chain"), K.scope_differs().alias("differs"), "parent_target_tables", "parent_last_position",
        "parent_found", "parent_status",
    ).first()
    if admitted["differs"]:
        raise ChainError(f"tables {record['target_tables']} differ from the parent's {admitted['parent_target_tables']}")
    record["backup_chain_id"] = admitted["chain"]
    tables = chosen_tables(request)
    position = admitted["parent_last_position"]
    if request.backup_type in CHILDREN and admitted["parent_found"] and admitted["parent_status"] != "SUCCESS":
        # what a failed parent did not store must not be skipped: go on from the last good step
        good = last_good_step(known, admitted["chain"])
        request = replace(request, parent_id=good["id"])
        record["parent_backup_id"], position = good["id"], good["last_position"]
    after = start_position(catalog, known, request, position)
    catalog.append(spark.createDataFrame([_log_row(record)], LOG_SCHEMA))
    try:
        packed = request.compressed and record["dump_format"] != "CUSTOM_FC"
        slices = {}
        for table in tables:
            source = read(table.name)
            slices[table.name] = full_rows(source, table, request.cut) if after is None else rows_between(source, table, after, request.cut)
        if request.sealed:
            seal_tables(spark, request, backup_id, slices, "zstd" if packed else None)
        else:
            for name, rows in slices.items():
                write_snapshot(rows, request.root, request.database, name, backup_id, "gzip" if packed else "none")
        record["status"] = "SUCCESS"
        return record
    except Exception as error:
        record["status"], record["error_message"] = "FAILED", str(error)
        raise
    finally:
        record["end_time"] = datetime.now()
        record["duration_ms"] = int((record["end_time"] - started).total_seconds() * 1000)
        record["file_size_bytes"] = stored_bytes(spark, record["destination_uri"])
        catalog.append(spark.createDataFrame([_log_row(record)], LOG_SCHEMA))


def stream_parent(catalog: Catalog, name: str) -> Any:
    """(id, chain, number) of the newest successful step of a stream; None before its first one."""
    number = F.substring_index("id", "-", -1).cast("bigint")
    mine = catalog.log().filter(F.col("id").rlike(f"^{re.escape(name)}-[0-9]+$") & (F.col("status") == "SUCCESS"))
    return mine.select("id", F.col("backup_chain_id").alias("chain"), number.alias("number")).orderBy(F.desc("number")).first()


def commit_step(catalog: Catalog, name: str, number: int, table: TrackedTable, root: str, database: str, rows: DataFrame) -> bool:
    """Write one batch of a stream as a snapshot step of the chain ``<name>-*`` and log it, once: a batch whose record is there is left alone.

    The record comes last, so a batch that failed before it is written anew in the same folder, and one that failed after it is
    known to be stored. Returns whether anything was written.
    """
    before = stream_parent(catalog, name)
    if before is not None and before["number"] >= number:
        return False
    spark, started, backup_id = catalog.spark, datetime.now(), f"{name}-{number}"
    seen = Observation()
    observed = rows.observe(seen, F.max(table.position).cast("string").alias("last"))
    write_snapshot(observed, root, database, table.name, backup_id)
    ended = datetime.now()
    record = dict.fromkeys(LOG_SCHEMA.fieldNames())
    record.update(
        id=backup_id,
        profile_name=database,
        backup_type="INCREMENTAL" if before else "FULL",
        dump_format="PLAIN_SQL",
        parent_backup_id=before["id"] if before else None,
        backup_chain_id=before["chain"] if before else backup_id,
        target_tables=[table.name],
        start_time=started,
        end_time=ended,
        duration_ms=int((ended - started).total_seconds() * 1000),
        destination_uri=run_uri(root, database, backup_id),
        status="SUCCESS",
        last_position=seen.get["last"],
        sealed=False,
    )
    record["file_size_bytes"] = stored_bytes(spark, record["destination_uri"])
    catalog.append(spark.createDataFrame([_log_row(record)], LOG_SCHEMA))
    return True


def seal_tables(spark: SparkSession, request: BackupRequest, backup_id: str, slices: dict[str, DataFrame], codec: str | None) -> None:
    """Write every table of a run as sealed segments under the run's own key, then the manifest."""
    keys = crypto.backup_keys(spark, request.passphrase, {backup_id: crypto.new_salt()})
    listed = [
        S.write_sealed(rows, keys, request.root, request.database, name, backup_id, request.segment_bytes, codec) for name, rows in slices.items()
    ]
    if listed:
        manifest = listed[0]
        for more in listed[1:]:
            manifest = manifest.unionByName(more)
        S.write_manifest(manifest, keys, request.root, request.database, backup_id)


def _log_row(record: dict[str, Any]) -> tuple:
    values = {**record, "seq": time.time_ns()}
    return tuple(values[name] for name in LOG_SCHEMA.fieldNames())


def run_uri(root: str, database: str, backup_id: str) -> str:
    """The folders of one run, of all its tables, as one path pattern. No two runs share it."""
    return f"{root.rstrip('/')}/{segment_name(database)}/*/backup_id={backup_id}"


def stored_bytes(spark: SparkSession, uri: str) -> int:
    """Bytes of a run's files as stored, after compression. Only the run's own folders are listed."""
    listing = list_objects(spark, uri, missing_ok=True)
    return 0 if listing is None else int(listing.agg(F.sum("length").alias("n")).first()["n"] or 0)


def cleanup_plan(catalog: Catalog, database: str, asof: datetime) -> DataFrame:
    """(uri, scheme) of what the automatic cleanup after a successful run of the database may remove."""
    records = catalog.current()
    doomed = cleanup_set(C.only_database(records, database), F.lit(asof).cast("timestamp_ntz"))
    return object_delete_plan(doomed, records)


CHILDREN = ("INCREMENTAL", "DIFFERENTIAL")


def named_tables(tables: Sequence[TrackedTable], names: Sequence[str]) -> list[TrackedTable]:
    """The named tables, or all when none is named; an unknown name is an error."""
    unknown = sorted(set(names) - {t.name for t in tables})
    if unknown:
        raise ChainError(f"unknown tables: {', '.join(unknown)}")
    return [t for t in tables if not names or t.name in names]


def chosen_tables(request: BackupRequest) -> list[TrackedTable]:
    return named_tables(request.tables, request.selected)


def last_good_step(known: DataFrame, chain: str) -> Any:
    """The newest successful record of a chain."""
    good = known.filter((F.col("backup_chain_id") == chain) & (F.col("status") == "SUCCESS"))
    row = good.orderBy(F.desc_nulls_last("start_time"), F.desc("id")).select("id", "last_position").first()
    if row is None:
        raise ChainError(f"chain {chain} has no successful step to go on from")
    return row


def start_position(catalog: Catalog, known: DataFrame, request: BackupRequest, parent_position: str | None) -> str | None:
    """Where a step begins: nowhere for FULL, at the parent for INCREMENTAL, at the chain's base for DIFFERENTIAL."""
    if request.backup_type not in CHILDREN:
        return None
    if parent_position is None:
        raise ChainError(f"parent backup not found: {request.parent_id}")
    if request.backup_type == "INCREMENTAL":
        return parent_position
    verdict, base, _ = catalog.resolve_target(request.parent_id)
    if verdict in (K.CYCLE, "MISSING_PARENT"):
        raise ChainError(f"chain of {request.parent_id} has no base: {verdict}")
    return known.filter(F.col("id") == base).select("last_position").first()["last_position"]


def restore_steps(records: DataFrame, target_id: str, any_status: bool = False) -> DataFrame:
    """``Catalog.restore_steps`` of records that are in no catalog."""
    return restorable(*K.resolve_target(records, target_id), target_id, any_status)


def restorable(verdict: str | None, end_id: str | None, lineage: DataFrame, target_id: str, any_status: bool) -> DataFrame:
    if verdict is None:
        raise ChainError(f"target backup not found: {target_id}")
    if verdict == "MISSING_PARENT":
        raise ChainError(f"parent backup not found in chain: {end_id}")
    if verdict == "CYCLE" or (verdict == "NOT_SUCCESSFUL" and not any_status):
        raise ChainError(f"chain of {target_id} cannot be restored: {verdict}")
    return lineage


def restore_table(
    catalog: Catalog,
    target_id: str,
    table: TrackedTable,
    root: str,
    database: str,
    any_status: bool = False,
    schema: T.StructType | None = None,
    passphrase: str | None = None,
) -> DataFrame:
    """One table as it was at the target backup. All steps are read and replayed in a single job.

    The lineage is joined to the snapshots' folder column, so folders of other backups are pruned while running.
    With a ``schema`` no file footers are read to find the columns. A chain may mix plain and sealed steps; sealed ones need the
    passphrase, and their manifests are checked for lost and changed pieces before anything is replayed.
    """
    known = catalog.with_positions()
    lineage = catalog.restore_steps(target_id, any_status).select(F.col("id").alias("backup_id"), "step")
    marks = lineage.join(known.select(F.col("id").alias("backup_id"), F.coalesce("sealed", F.lit(False)).alias("sealed")), "backup_id")
    # one short row per step of one chain
    sealed = {(r["backup_id"], r["step"]): r["sealed"] for r in marks.collect()}
    steps = []
    if not all(sealed.values()):
        plain = read_snapshots(catalog.spark, root, database, table.name, schema)
        steps.append(plain.join(lineage, "backup_id").drop("backup_id"))
    if any(sealed.values()):
        opened = [place for place, hidden in sealed.items() if hidden]
        steps.append(open_sealed(catalog.spark, root, database, table.name, opened, passphrase))
    rows = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1], allowMissingColumns=True)
    return replay(rows, table)


def open_sealed(spark: SparkSession, root: str, database: str, table: str, steps: list[tuple[str, int]], passphrase: str | None) -> DataFrame:
    """Rows of sealed steps, (backup id, step) each, after their manifests have been checked. Only those backups' folders are listed."""
    if not (passphrase and passphrase.strip()):
        raise S.SealError(f"backups are sealed and need a passphrase: {', '.join(sorted(i for i, _ in steps))}")
    ids = [backup_id for backup_id, _ in steps]
    manifest = S.read_manifest(spark, root, database).filter(F.col("backup_id").isin(ids))
    segments = S.read_segments(spark, root, database, table).filter(F.col("backup_id").isin(ids))
    keys = S.open_keys(spark, manifest, ids, passphrase)
    S.check_sealed(manifest, segments, keys, table)
    order = spark.createDataFrame(steps, "backup_id string, step bigint")
    return S.open_segments(segments.join(F.broadcast(order), "backup_id"), keys, table, S.manifest_columns(manifest, table))


def damage_report(catalog: Catalog, target_id: str, table: str, root: str, database: str, passphrase: str) -> DataFrame:
    """(backup_id, part, segment_index) of the sealed segments in a target's lineage that do not open. No plain byte leaves the tasks."""
    lineage = catalog.restore_steps(target_id, any_status=True)
    ids = [r["id"] for r in lineage.select("id").collect()]
    manifest = S.read_manifest(catalog.spark, root, database).filter(F.col("backup_id").isin(ids))
    held = [r["backup_id"] for r in manifest.select("backup_id").distinct().collect()]
    keys = S.open_keys(catalog.spark, manifest, held, passphrase)
    segments = S.read_segments(catalog.spark, root, database, table).filter(F.col("backup_id").isin(held))
    return S.damaged_segments(segments, keys, table)


def restore_database(
    catalog: Catalog,
    target_id: str,
    tables: Sequence[TrackedTable],
    root: str,
    database: str,
    write: Callable[[DataFrame, str], None],
    selected: Sequence[str] = (),
    passphrase: str | None = None,
) -> list[str]:
    """Restore the selected tables (all when none is named) through ``write(rows, table_name)``; folders of others are not opened."""
    wanted = named_tables(tables, selected)
    for table in wanted:
        write(restore_table(catalog, target_id, table, root, database, passphrase=passphrase), table.name)
    return [t.name for t in wanted]
