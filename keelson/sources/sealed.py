"""Sealed snapshots: tables as authenticated encrypted segments, with a manifest that says what must be there.

A sealed snapshot of a table is a folder of segments (``pack_table``), each encrypted under a new IV and bound to its backup,
table and place. Rows go from the source into cipher text within one task: nothing plain is ever written. The manifest of a backup holds

* per table and part a trailer, the number of its segments and rows;
* per table a closing row with the number of its parts and its schema;
* one row without a table name that counts the tables.

Every manifest row carries a seal, an authentication tag over what the row says, made with the backup's key, so a lost segment, a
lost part and a changed manifest are all found before anything is restored. The manifest is written last: a run without one
never finished.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import crypto
from keelson.operators.segments import SEGMENT_SCHEMA, STORED, pack_table, truncation_report, with_keys
from keelson.sources.snapshots import segment_name, table_root

#: ``@`` is in no table's folder name, so sealed folders and manifests share no name with plain snapshots.
SEALED, MANIFEST = "@sealed", "@manifest"
#: The part number of a table's closing row.
CLOSING = -1
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("segments", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("table_schema", T.StringType()),
        T.StructField("salt", T.BinaryType()),
        T.StructField("seal", T.BinaryType()),
    ]
)


class SealError(ValueError):
    """Sealed data that is missing, changed, or not opened by the passphrase."""


def sealed_root(root: str, database: str, table: str) -> str:
    return f"{table_root(root, database, table)}{SEALED}"


def manifest_root(root: str, database: str) -> str:
    return f"{root.rstrip('/')}/{segment_name(database)}/{MANIFEST}"


def place_text(table: Column) -> Column:
    """What a segment is bound to."""
    return F.concat_ws("/", "backup_id", table, F.col("part").cast("string"), F.col("segment_index").cast("string"))


def manifest_text() -> Column:
    """What the seal of a manifest row speaks for."""
    said = [F.col(c).cast("string") for c in ("backup_id", "table_name", "part", "segments", "row_count")]
    return F.to_json(F.array(*said, F.coalesce("table_schema", F.lit(""))))


def write_sealed(rows: DataFrame, keys: DataFrame, root: str, database: str, table: str, backup_id: str, size: int, codec: str | None) -> DataFrame:
    """Encrypt the rows into the backup's folder; returns the table's manifest rows, not yet written.

    A repeated write of the same backup id replaces the first one.
    """
    spark, path = rows.sparkSession, f"{sealed_root(root, database, table)}/backup_id={backup_id}"
    keyed = with_keys(pack_table(rows, backup_id, size, codec), keys, "key")
    sealed = keyed.withColumn("payload", crypto.encrypt_fresh("payload", F.col("_key"), place_text(F.lit(table))))
    sealed.select("part", "segment_index", "row_count", "payload").write.mode("overwrite").options(**STORED).option("compression", "none").parquet(path)
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    trailers = stored.groupBy("part").agg(F.count(F.lit(1)).alias("segments"), F.sum("row_count").alias("row_count"))
    parts = trailers.withColumn("table_schema", F.lit(None).cast("string"))
    # a table without rows has a closing row too
    closing = trailers.agg(F.lit(CLOSING).cast("bigint").alias("part"), F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
    return parts.unionByName(closing.withColumn("table_schema", F.lit(rows.schema.json()))).withColumn("table_name", F.lit(table))


def write_manifest(rows: DataFrame, keys: DataFrame, root: str, database: str, backup_id: str) -> None:
    """Seal and write the manifest rows of all tables of a backup: the run's last step."""
    tables = rows.filter(F.col("part") == CLOSING).agg(
        F.lit("").alias("table_name"), F.lit(CLOSING).cast("bigint").alias("part"), F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")
    )
    listed = rows.unionByName(tables.withColumn("table_schema", F.lit(None).cast("string")))
    keyed = with_keys(listed.withColumn("backup_id", F.lit(backup_id)), keys, "key", "salt")
    sealed = keyed.withColumn("seal", crypto.encrypt_fresh(F.lit(b""), F.col("_key"), manifest_text()))
    out = sealed.withColumn("salt", F.col("_salt")).select(*MANIFEST_SCHEMA.fieldNames())
    out.write.mode("overwrite").parquet(f"{manifest_root(root, database)}/backup_id={backup_id}")


def read_manifest(spark: SparkSession, root: str, database: str) -> DataFrame:
    """Manifest rows of all backups; a filter on ``backup_id`` prunes folders."""
    base = manifest_root(root, database)
    schema = T.StructType([*MANIFEST_SCHEMA.fields, T.StructField("backup_id", T.StringType())])
    return spark.read.schema(schema).option("basePath", base).parquet(base)


def read_segments(spark: SparkSession, root: str, database: str, table: str) -> DataFrame:
    base = sealed_root(root, database, table)
    fields = [f for f in SEGMENT_SCHEMA.fields if f.name != "backup_id"]
    schema = T.StructType([*fields, T.StructField("backup_id", T.StringType())])
    return spark.read.schema(schema).option("basePath", base).parquet(base)


def open_keys(spark: SparkSession, manifest: DataFrame, backup_ids: list[str], passphrase: str) -> DataFrame:
    """Keys of the backups of one chain, from the salts in their manifests. One row a step comes to the driver."""
    salts = {r["backup_id"]: bytes(r["salt"]) for r in manifest.filter(F.col("part") == CLOSING).groupBy("backup_id").agg(F.first("salt").alias("salt")).collect()}
    lost = sorted(set(backup_ids) - set(salts))
    if lost:
        raise SealError(f"no manifest for backups: {', '.join(lost)}")
    return crypto.backup_keys(spark, passphrase, salts)


def broken_seals(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(backup_id, table_name, part) of manifest rows whose seal does not hold: changed, moved, or another passphrase."""
    opened = crypto.try_decrypt("seal", F.col("_key"), manifest_text())
    keyed = with_keys(manifest, keys, "key").withColumn("_said", opened)
    return keyed.filter("_said is null").select("backup_id", "table_name", "part")


def lost_parts(manifest: DataFrame, table: str) -> DataFrame:
    """(backup_id, said, found) where the trailers of a table are not as many as its closing row says; said is null without one."""
    mine = manifest.filter(F.col("table_name") == table)
    counted = mine.groupBy("backup_id").agg(
        F.max(F.when(F.col("part") == CLOSING, F.col("segments"))).alias("said"), F.count_distinct(F.when(F.col("part") != CLOSING, F.col("part"))).alias("found")
    )
    return counted.filter(~F.col("said").eqNullSafe(F.col("found")))


def lost_tables(manifest: DataFrame) -> DataFrame:
    """(backup_id, said, found) where the closing rows are not as many as the manifest says."""
    closing = F.col("part") == CLOSING
    counted = manifest.groupBy("backup_id").agg(
        F.max(F.when(F.col("table_name") == "", F.col("segments"))).alias("said"), F.count_if(closing & (F.col("table_name") != "")).alias("found")
    )
    return counted.filter(~F.col("said").eqNullSafe(F.col("found")))


def lost_segments(manifest: DataFrame, segments: DataFrame, table: str) -> DataFrame:
    """Places (backup_id, part, segment_index) that the trailers of a table name and the folder lacks. Payloads are not read."""
    expected = manifest.filter((F.col("table_name") == table) & (F.col("part") != CLOSING))
    return truncation_report(expected.select("backup_id", "part", "segments"), segments.select("backup_id", "part", "segment_index"))


def damaged_segments(segments: DataFrame, keys: DataFrame, table: str) -> DataFrame:
    """Places whose bytes do not open: a full check of the cipher text that hands on no plain byte."""
    opened = crypto.try_decrypt("payload", F.col("_key"), place_text(F.lit(table)))
    return with_keys(segments, keys, "key").filter(opened.isNull()).select("backup_id", "part", "segment_index")


def check_sealed(manifest: DataFrame, segments: DataFrame, keys: DataFrame, table: str, named: int = 20) -> None:
    """Raise an error that names what is missing or changed; up to ``named`` places are spelled out."""
    for found, what in (
        (broken_seals(manifest, keys), "seals that do not hold (wrong passphrase or changed manifest)"),
        (lost_tables(manifest), "tables that the manifest counts but does not list"),
        (lost_parts(manifest, table), "parts that the manifest counts but does not list"),
        (lost_segments(manifest, segments, table), "missing segments"),
    ):
        rows = found.limit(named + 1).collect()
        if rows:
            places = sorted("/".join(str(v) for v in r) for r in rows[:named])
            raise SealError(f"{table}: {what}: {', '.join(places)}{' and more' if len(rows) > named else ''}")


def manifest_columns(manifest: DataFrame, table: str) -> T.StructType:
    """Columns of a table over the steps of a chain, by name; later steps may add some. One row a step is read."""
    closing = manifest.filter((F.col("table_name") == table) & (F.col("part") == CLOSING))
    seen: dict[str, T.StructField] = {}
    for row in closing.select("backup_id", "table_schema").orderBy("backup_id").collect():
        for field in T.StructType.fromJson(json.loads(row["table_schema"])).fields:
            seen.setdefault(field.name, T.StructField(field.name, field.dataType, True))
    return T.StructType(list(seen.values()))


def open_segments(segments: DataFrame, keys: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Rows of the segments (with a ``step`` each) in the columns of ``schema``; a segment that does not open ends the job with its place."""
    opened = crypto.try_decrypt("payload", F.col("_key"), place_text(F.lit(table)))
    lost = F.raise_error(F.concat(F.lit("segment does not open: "), place_text(F.lit(table)))).cast("binary")
    plain = with_keys(segments, keys, "key").select("step", F.coalesce(opened, lost).alias("payload"))
    whole = T.StructType([*schema.fields, T.StructField("step", T.LongType())])

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(whole)
        for batch in batches:
            for step, payload in zip(batch.column("step").to_pylist(), batch.column("payload")):
                with pa.ipc.open_stream(payload.as_buffer()) as reader:
                    for found in reader:
                        held = dict(zip(found.schema.names, found.columns))
                        # a column that came later is null here
                        columns = [held[f.name].cast(f.type) if f.name in held else pa.nulls(found.num_rows, f.type) for f in list(target)[:-1]]
                        steps = pa.repeat(pa.scalar(step, pa.int64()), found.num_rows)
                        yield pa.RecordBatch.from_arrays([*columns, steps], schema=target)

    return plain.mapInArrow(unpack, whole)
