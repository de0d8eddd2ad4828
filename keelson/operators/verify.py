"""Whether two tables hold the same rows, by a tree of row-hash sums, and which rows differ.

A row is two 64-bit hashes of all its columns. Level 1 deals rows by ten bits of the first and adds up the hashes of a node, left rows
plus and right rows minus: one narrow scan of each side, combined before the shuffle, and at most 1,024 rows after it. If all sums
are zero the tables are equal and that was all. Otherwise only the rows of nodes that differ go on to level 2, by the next ten
bits, and only those of differing nodes there are counted hash by hash. Whole rows are shuffled only where they differ.

Equal sums of both hashes in every node are taken as equality. Copies count: a row that is there twice on one side and once on
the other is a difference. Nulls, their places, nested nulls and maps are part of a row's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.session import materialise, materialise_counted

#: Bits of a level: a node has 1,024 children.
BITS = 10


def canonical(c: Column, kind: T.DataType) -> list[Column]:
    """Columns whose hash tells apart what a plain hash takes as equal: hashes skip nulls and refuse maps."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return canonical(F.transform(entries, lambda e: e["key"]), T.ArrayType(kind.keyType)) + canonical(F.transform(entries, lambda e: e["value"]), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.MapType, T.ArrayType, T.StructType)):
            return [F.size(c), F.transform(c, lambda x: F.xxhash64(*canonical(x, kind.elementType)))]
        return [F.size(c), F.transform(c, lambda x: x.isNull()), c]
    if isinstance(kind, T.StructType):
        return [c.isNull()] + [x for f in kind.fields for x in canonical(c[f.name], f.dataType)]
    return [c.isNull(), c]


def row_hashes(df: DataFrame) -> list[Column]:
    """``h`` and ``g``, two hashes of a row. Columns are taken by name."""
    parts = [x for name in sorted(df.columns) for x in canonical(F.col(f"`{name}`"), df.schema[name].dataType)]
    return [F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("second"), *parts).alias("g")]


def hashed(df: DataFrame, side: int) -> DataFrame:
    return df.select(*row_hashes(df), F.lit(side).alias("side"))


def node(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(f"n{level}")


def differing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes whose sums do not cancel, with the rows that the left side has there."""
    signed = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * F.col("side"))
    sums = rows.groupBy(*keys).agg(F.sum("side").alias("n"), signed("h").alias("sh"), signed("g").alias("sg"), F.count_if(F.col("side") > 0).alias("rows"))
    return sums.withColumn("differs", (F.col("n") != 0) | (F.col("sh") != 0) | (F.col("sg") != 0)).select(*keys, "rows", "differs")


@dataclass(frozen=True)
class Verdict:
    """Rows of the left side, and the rows that differ: the left side's columns and ``surplus``, the copies it has more (less, if negative)."""

    row_count: int
    same: bool
    rows: DataFrame


def verify(left: DataFrame, right: DataFrame) -> Verdict:
    """Compare two tables with the same columns."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    both = hashed(left, 1).unionAll(hashed(right, -1))
    top, seen = materialise_counted(differing(both.withColumn("n1", node(1)), ["n1"]), "verify", rows=F.sum("rows"), bad=F.count_if("differs"))
    nothing = left.limit(0).withColumn("surplus", F.lit(0).cast("bigint"))
    if not seen["bad"]:
        return Verdict(seen["rows"], True, nothing)
    # at most 1,024 nodes
    low = both.withColumn("n1", node(1)).join(F.broadcast(top.filter("differs").select("n1")), "n1").withColumn("n2", node(2))
    nodes = materialise(differing(low, ["n1", "n2"]).filter("differs").select("n1", "n2"), "verify")
    leaves = low.join(nodes, ["n1", "n2"]).groupBy("h", "g").agg(F.sum("side").alias("surplus")).filter("surplus <> 0")
    damaged = materialise(leaves, "verify")
    return Verdict(seen["rows"], False, _named(left, damaged.filter("surplus > 0")).unionByName(_named(right, damaged.filter("surplus < 0"))))


def _named(df: DataFrame, damaged: DataFrame) -> DataFrame:
    """One whole row for each of the hashes."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    hit = df.select(whole, *row_hashes(df)).join(damaged, ["h", "g"]).groupBy("h", "g").agg(F.first("_row").alias("_row"), F.first("surplus").alias("surplus"))
    return hit.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns], "surplus")
