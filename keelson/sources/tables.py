"""Tables of a database: selection, consistent reads, and JDBC scans and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.snapshots import TrackedTable, full_rows

#: Ports and drivers of the two supported database kinds.
DATABASE_KINDS = {
    "mysql": ("mysql", 3306, "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("postgresql", 5432, "org.postgresql.Driver"),
    "postgres": ("postgresql", 5432, "org.postgresql.Driver"),
}


def select_tables(wanted: Iterable[str] | None, all_tables: Iterable[str]) -> list[str]:
    """The asked tables, or the whole database when the list is empty. Unknown names are an error."""
    names = list(dict.fromkeys(wanted or []))
    known = list(all_tables)
    if not names:
        return known
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"no such table: {', '.join(unknown)}")
    return names


def consistent_read(read: Callable[[str], DataFrame], tables: Iterable[TrackedTable], cut: Any) -> dict[str, DataFrame]:
    """Every table as of the same position; the bound is pushed into each scan."""
    return {t.name: full_rows(read(t.name), t, cut) for t in tables}


def jdbc_url(db_type: str, host: str, port: int | None, database: str) -> str:
    kind, default_port, _ = DATABASE_KINDS[db_type.lower()]
    return f"jdbc:{kind}://{host}:{port or default_port}/{database}"


def jdbc_options(db_type: str, host: str, port: int | None, database: str, user: str, password: str) -> dict[str, str]:
    return {
        "url": jdbc_url(db_type, host, port, database),
        "driver": DATABASE_KINDS[db_type.lower()][2],
        "user": user,
        "password": password,
    }


def scan_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    partition_column: str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A JDBC table as a partitioned scan: each task reads its own range of ``partition_column``.

    The bounds come from one min/max row. Filters on the result are sent to the database.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.load()
    bounds = reader.load().agg(F.min(partition_column).alias("lo"), F.max(partition_column).alias("hi")).first()
    if bounds["lo"] is None:
        return reader.load()
    count = partitions or spark.sparkContext.defaultParallelism
    return (
        reader.option("partitionColumn", partition_column)
        .option("lowerBound", str(bounds["lo"]))
        .option("upperBound", str(bounds["hi"]))
        .option("numPartitions", count)
        .load()
    )


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, mode: str = "overwrite", batch_size: int = 10_000) -> None:
    """Restored rows into a database table; ``truncate`` keeps the target's own definition."""
    writer = df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch_size)
    writer.option("truncate", "true").mode(mode).save()
