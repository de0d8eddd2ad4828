"""Replaying the steps of a chain, comparing snapshots and verifying restores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources.snapshots import TrackedTable


def union_steps(steps: list[DataFrame]) -> DataFrame:
    """Steps one below the other by column name with their ``step`` number; columns a step lacks are null."""
    numbered = [df.withColumn("step", F.lit(n).cast("bigint")) for n, df in enumerate(steps)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def _comparable(kind: T.DataType) -> bool:
    """Whether values can be ordered; a map on the outside can, by its entries."""
    if isinstance(kind, T.MapType):
        return not isinstance(kind.valueType, T.MapType) and _comparable(kind.valueType) and _comparable(kind.keyType)
    if isinstance(kind, T.ArrayType):
        return not isinstance(kind.elementType, T.MapType) and _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(not isinstance(f.dataType, T.MapType) and _comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.VariantType)


def newest_versions(rows: DataFrame, table: TrackedTable) -> DataFrame:
    """One row per key: greatest step, then position, then every remaining column (a total order).

    An aggregate, so versions of one key are reduced before the shuffle however many there are.
    """
    keys = list(table.keys)
    rest = [c for c in rows.columns if c not in (*keys, "step", table.position)]
    # maps cannot be ordered: their entries, sorted, are compared in their place
    rank = [F.array_sort(F.map_entries(c)) if isinstance(rows.schema[c].dataType, T.MapType) else F.col(c) for c in rest if _comparable(rows.schema[c].dataType)]
    best = F.max_by(F.struct("step", table.position, *rest), F.struct("step", table.position, *rank)).alias("_row")
    picked = rows.groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def drop_deleted(rows: DataFrame, table: TrackedTable) -> DataFrame:
    """Tombstones go only after the newest version of each key is known."""
    if table.deleted is None:
        return rows
    return rows.filter(~F.coalesce(F.expr(table.deleted), F.lit(False)))


def replay(rows: DataFrame, table: TrackedTable) -> DataFrame:
    """The table as the steps leave it. ``rows`` carries a ``step`` number.

    When the base holds one row per key, only the later steps are aggregated; base rows are kept unless
    a later step names their key, so the large base is not regrouped (and not moved at all when the keys of the
    increments are small enough for Catalyst to broadcast).
    """
    if table.versioned:
        return drop_deleted(newest_versions(rows, table), table).drop("step")
    later = newest_versions(rows.filter("step > 0"), table)
    base = rows.filter("step = 0").join(later.select(*table.keys), list(table.keys), "left_anti")
    return drop_deleted(base.select(*rows.columns).unionAll(later.select(*rows.columns)), table).drop("step")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows from ``old`` to ``new``: inserted, updated, and deleted keys as tombstones with null values.

    Null keys are keys like any other. A column only one side has is null on the other.
    """
    rest = [c for c in new.columns if c not in keys] + [c for c in old.columns if c not in new.columns]
    kinds = {**dict(old.dtypes), **dict(new.dtypes)}
    whole = lambda df: F.struct(*[F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    before = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], whole(old).alias("_old"))
    after = new.select(*keys, whole(new).alias("_new"))
    same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    both = before.join(after, same_key, "full")
    change = (
        F.when(F.col("_old").isNull(), F.lit("INSERT"))
        .when(F.col("_new").isNull(), F.lit("DELETE"))
        .when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("UPDATE"))
    )
    return both.withColumn("change", change).filter("change is not null").select(
        *[F.coalesce(k, f"_o_{k}").alias(k) for k in keys],
        "change",
        *[F.col(f"_new.`{c}`").alias(c) for c in rest],
    )


def fingerprint(df: DataFrame, label: str) -> DataFrame:
    """Row count and order-free checksum. A sum, not an xor: equal rows must not cancel."""
    row_hash = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_hash).alias("checksum")).select(
        F.lit(label).alias("table_name"), "rows", "checksum"
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the surplus on the left (negative: on the right).

    Both directions in one aggregate; copies are counted before the shuffle.
    """
    columns = left.columns
    signed = left.select(*columns, F.lit(1).cast("bigint").alias("_n")).unionAll(
        right.select(*columns, F.lit(-1).cast("bigint").alias("_n"))
    )
    return signed.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")
