"""Plans for ordered work per key that hold when one key owns a large part of the rows.

* ``latest_per_key`` - newest row per key by aggregation, so map-side combining absorbs a hot key.
* ``top_per_key``    - first n rows per key with a literal n; Spark limits each input partition before the shuffle.
* ``Sliced``         - running scans (count, sum, max, next, last seen) over a key of any size. A key
  with few rows is one window. A key above the limit is cut into consecutive ranges, each range is scanned
  by its own task, and what earlier ranges contribute is carried over. A range boundary splits at
  most one key, so the carry table has at most one row per range and is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from keelson.session import materialise, rows_per_key

SLICE = "_slice"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, every column kept (nulls included)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    rank = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order`` with their ``rank``. ``n`` is a literal, so each input partition is limited first.

    What is left of a hot key is n rows per input partition. With ``salts`` these are first limited in that
    many groups of the key, which leaves n rows per salt for the last task.
    """
    rows = df
    if salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = salted.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= F.lit(n)).drop("_salt", "rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= F.lit(n))


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Row count of the biggest key, and of all rows; a partial aggregate, one row back."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return int(row["most"] or 0), int(row["all"] or 0)


@dataclass
class Sliced:
    """Rows with a ``_slice`` number; rows of one key are ordered across slices."""

    rows: DataFrame
    keys: list[str]
    order: list[Column]
    cut: bool

    def window(self) -> WindowSpec:
        """The window for work inside one slice of one key."""
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def ahead(self, *order: Column) -> WindowSpec:
        """The frame from the end of the slice back to the current row; ``order`` is the reverse of the slice's order.

        A frame that reaches forward to the end is recomputed for every row; read backwards it is one pass, and
        the nearest row ahead is the last one seen.
        """
        window = Window.partitionBy(*self.keys, SLICE).orderBy(*order)
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_carry(
        self,
        rows: DataFrame,
        partials: dict[str, Column],
        carries: dict[str, Callable[[WindowSpec], Column]],
        backward: bool = False,
    ) -> DataFrame:
        """Add to ``rows`` what the earlier slices (later ones if ``backward``) of the key contribute.

        ``partials`` are aggregates per (key, slice); each ``carries`` entry folds them over the given
        frame. Columns are null where the key has no other slice on that side.
        """
        if not self.cut:
            types = dict(self._carried(rows.limit(0), partials, carries, backward).dtypes)
            return rows.select("*", *[F.lit(None).cast(types[name]).alias(name) for name in carries])
        carried = self._carried(rows, partials, carries, backward)
        names = {c: f"_carry{n}" for n, c in enumerate([*self.keys, SLICE])}
        # a null key is a key like any other
        same = [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()]
        return rows.join(F.broadcast(carried.withColumnsRenamed(names)), same, "left").drop(*names.values())

    def _carried(self, rows, partials, carries, backward) -> DataFrame:
        summary = rows.groupBy(*self.keys, SLICE).agg(*[c.alias(n) for n, c in partials.items()])
        by_slice = F.col(SLICE).desc() if backward else F.col(SLICE).asc()
        order = Window.partitionBy(*self.keys).orderBy(by_slice)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        folded = summary.select(
            *self.keys,
            SLICE,
            F.count(F.lit(1)).over(before).alias("_others"),
            *[fold(before).alias(name) for name, fold in carries.items()],
        )
        return folded.filter("_others > 0").drop("_others")


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None = None) -> Sliced:
    """Prepare a running scan. ``order`` must be total within a key.

    A size check decides: below ``limit`` rows per key one window per key is enough and nothing is written.
    """
    spark = df.sparkSession
    keys = list(keys)
    order = list(order)
    limit = rows_per_key(spark) if limit is None else limit
    most, rows = key_sizes(df, keys)
    if most <= limit:
        return Sliced(df.withColumn(SLICE, F.lit(0)), keys, order, cut=False)
    # no slice is meant to hold more rows than one key may
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // limit))
    ranged = df.repartitionByRange(slices, *[F.col(k).asc() for k in keys], *order)
    return Sliced(materialise(ranged.withColumn(SLICE, F.spark_partition_id()), "slices"), keys, order, cut=True)


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``row_number`` per key that also works for a key too big for one task."""
    cut = slice_rows(df, keys, order)
    ranked = cut.rows.withColumn("_local", F.row_number().over(cut.window()).cast("bigint"))
    ranked = cut.with_carry(
        ranked, {"_n": F.count(F.lit(1))}, {"_before": lambda w: F.sum("_n").over(w)}
    )
    return ranked.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_local", "_before", SLICE)
