"""Table snapshots: full, incremental and differential slices written under one backup id, and their readers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_FORMATS = ("parquet", "orc", "json", "csv")
#: Text formats keep all six digits of a second.
TEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class TrackedTable:
    """What a table needs to be backed up in steps.

    ``position`` is monotone and not null. ``deleted`` is a SQL predicate that marks a tombstone row.
    ``versioned`` says that one snapshot may itself hold several versions of a key.
    """

    name: str
    keys: tuple[str, ...]
    position: str
    deleted: str | None = None
    versioned: bool = False
    options: dict[str, str] = field(default_factory=dict, hash=False)


def at_position(df: DataFrame, table: TrackedTable, position: Any) -> Column:
    """A position (stored as text in the log) as a literal of the position column's type."""
    return F.lit(str(position) if position is not None else None).cast(df.schema[table.position].dataType)


def full_rows(df: DataFrame, table: TrackedTable, cut: Any) -> DataFrame:
    """Rows up to the cut. The bound is a plain comparison, so it reaches the scan."""
    return df.filter(F.col(table.position) <= at_position(df, table, cut))


def rows_between(df: DataFrame, table: TrackedTable, after: Any, cut: Any) -> DataFrame:
    """Rows after one position and up to the cut: half-open, so no row is in two steps of one lineage."""
    position = F.col(table.position)
    return df.filter((position > at_position(df, table, after)) & (position <= at_position(df, table, cut)))


def segment_name(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]", "_", text)


def table_root(root: str, database: str, table: str) -> str:
    return f"{root.rstrip('/')}/{segment_name(database)}/{segment_name(table)}"


def snapshot_path(root: str, database: str, table: str, backup_id: str) -> str:
    return f"{table_root(root, database, table)}/backup_id={backup_id}"


def write_snapshot(
    df: DataFrame, root: str, database: str, table: str, backup_id: str, compression: str = "gzip"
) -> int:
    """Write the rows under their backup id and return how many there were, counted while writing.

    A repeated write of the same backup id replaces the first one.
    """
    counted = Observation()
    path = snapshot_path(root, database, table, backup_id)
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression).parquet(path)
    return int(counted.get["rows"])


def read_snapshots(spark: SparkSession, root: str, database: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All snapshots of a table with their ``backup_id``; a filter or join on it prunes folders.

    Without a schema the steps are merged by name, so columns added later are null in older steps.
    """
    base = table_root(root, database, table)
    reader = spark.read.option("basePath", base)
    if schema is not None:
        fields = [f for f in schema.fields if f.name != "backup_id"]
        reader = reader.schema(T.StructType([*fields, T.StructField("backup_id", T.StringType())]))
    else:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(base)


def store_table(df: DataFrame, path: str, fmt: str = "parquet", compressed: bool = True) -> str:
    """Write a table to any Hadoop file system, replacing what is there."""
    if fmt not in STORE_FORMATS:
        raise ValueError(f"unknown store format {fmt}")
    codec = {"orc": "zlib"}.get(fmt, "gzip") if compressed else "none"
    writer = df.write.mode("overwrite").option("compression", codec)
    if fmt == "csv":
        # null has its own mark, so that it stays apart from the empty text
        writer = writer.option("header", "true").option("nullValue", "\\N").option("escape", '"')
    writer.option("timestampNTZFormat", TEXT_TIME).format(fmt).save(path)
    return path


def load_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("nullValue", "\\N").option("emptyValue", "").option("escape", '"')
    return reader.option("timestampNTZFormat", TEXT_TIME).format(fmt).load(path)
