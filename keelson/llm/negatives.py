"""Hard negatives: for an anchor and one of its nearest rows of the same label, the best rows of other labels within a share of that score.

Vectors become integers, floor(scale * x). Anchors meet rows in tiles, a bounded number of anchors with a bounded number of rows;
scores are exact products in a residue number system (``residues``). First each anchor meets the rows of its own label, and
its best ``positives`` are kept; then it meets all rows, and for each positive the best ``negatives`` rows of another label
with low * positive <= 100 * negative <= high * positive are kept. Tiles give their best, a window over them the final ranks.
A label of any size is many tiles.

Rows with a null label, a null vector, or a null or non-finite component take no part. Every finite vector does: rows with a component
of 2**26 or more are multiplied as Python integers. Scores beyond 38 digits count as 38 nines, and leave as the largest long.
A row meets only rows of its own dimension; empty vectors score 0. Repeated rows are rows of their own, so a copy of an
anchor is one of its candidates, and a repeated anchor gives its result once per row. Ties go to the smaller id, null ids
last; rows with a null id are no anchors. A negative positive score admits nothing. An empty table gives an empty result. Only
the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.residues import products
from keelson.llm.store import kept
from keelson.llm.text import tidy
from keelson.plans.scans import top_per_key

#: Components from here on are Python integers.
WIDE = float(1 << 26)
MOST = 10**38 - 1
SCORE = pa.decimal128(38, 0)
LONGEST = 2**63 - 1


def prepared(rows: DataFrame, anchors: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``key`` (one per row), ``id``, ``label``, ``anchor``, ``dim`` and the integers of the rows that take part: ``v`` as 64-bit integers, or
    ``wide`` as text."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, out = [], []
            for n, vector in enumerate(batch.column(4)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                places.append(n)
                if np.abs(x).max(initial=0) * scale < WIDE:
                    out.append((len(x), np.floor(scale * x).astype(np.int64).tobytes(), None))
                else:
                    # a large double is a whole number
                    whole = [int(c) * scale if abs(c) > 2.0**60 else int(np.floor(scale * c)) for c in x.tolist()]
                    out.append((len(x), b"", " ".join(map(str, whole))))
            head = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(4)]
            tail = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*head, *tail], ["key", "id", "label", "anchor", "dim", "v", "wide"])

    named = rows.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"),
    ).where("label is not null and v is not null")
    return named.mapInArrow(tidy(convert), "key long, id long, label string, anchor boolean, dim int, v binary, wide string")


class Side:
    """Rows of a tile in the order of their ids, null ids last."""

    def __init__(self, rows: pa.Table):
        self.rows = rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])
        self.key = rows.column("key").to_numpy()
        dim = rows.column("dim")[0].as_py()
        self.wide = {n: list(map(int, w.split())) for n, w in enumerate(rows.column("wide").to_pylist()) if w is not None}
        self.v = np.zeros((len(rows), dim), np.int64)
        for n, raw in enumerate(rows.column("v").to_pylist()):
            if n not in self.wide:
                self.v[n] = np.frombuffer(raw, np.int64)

    def row(self, n: int) -> list[int]:
        return self.wide[n] if n in self.wide else self.v[n].tolist()

    def scores(self, low: int, high: int, other: Side) -> np.ndarray:
        """Scores of the rows from ``low`` to ``high`` with all rows of ``other``."""
        found = products(self.v[low:high], other.v)
        mine = [n for n in self.wide if low <= n < high]
        if mine or other.wide:
            dot = lambda a, b: sum(x * y for x, y in zip(a, b))
            found = found.astype(object)
            for n in mine:
                found[n - low] = [dot(self.wide[n], other.row(k)) for k in range(len(other.key))]
            for k, w in other.wide.items():
                found[:, k] = [dot(w, self.row(n)) for n in range(low, high)]
        return found


def best(score: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``places`` with the highest scores, ties to the earlier."""
    own = score[places]
    if own.dtype != object and len(own) > 4 * k:
        places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
        own = score[places]
    if own.dtype == object:
        return places[sorted(range(len(own)), key=lambda n: -own[n])[:k]]
    return places[np.argsort(-own, kind="stable")[:k]]


def score_column(values: list[int]) -> pa.Array:
    return pa.array([Decimal(max(-MOST, min(MOST, v))) for v in values], SCORE)


def dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], tile_rows: int, tile_anchors: int):
    """Anchors and rows cogrouped by ``keys`` and tile: every anchor meets every row of equal keys once."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).where("anchors > 0")
    sizes = sizes.select(*keys, F.ceil(F.col("rows") / tile_rows).alias("row_tiles"), F.ceil(F.col("anchors") / tile_anchors).alias("anchor_tiles"))
    zero, dealing = F.lit(0).cast("long"), F.xxhash64("key")
    left = anchors.join(sizes, keys).withColumn("at", F.pmod(dealing, F.col("anchor_tiles")))
    left = left.withColumn("ct", F.explode(F.sequence(zero, F.col("row_tiles") - 1)))
    right = rows.join(sizes, keys).withColumn("ct", F.pmod(dealing, F.col("row_tiles")))
    right = right.withColumn("at", F.explode(F.sequence(zero, F.col("anchor_tiles") - 1)))
    # both sides come from one table: new names keep them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys, "at", "ct").cogroup(right.groupBy(*keys, "at", "ct"))


def hard_negatives(
    rows: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile_rows: int = 16384, tile_anchors: int = 1024, step: int = 128,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` for the rows for which ``anchors``, a
    condition on the input's columns, holds."""
    table = kept(prepared(rows, anchors, label, id_col, vector_col, scale), "vectors")
    asked = table.where("anchor")

    def nearest(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(c):
            left, right = Side(a), Side(c)
            ids = right.rows.column("id").to_pylist()
            for begin in range(0, len(left.key), step):
                end = min(begin + step, len(left.key))
                score = left.scores(begin, end, right)
                for n in range(begin, end):
                    for k in best(score[n - begin], np.flatnonzero(right.key != left.key[n]), positives).tolist():
                        out.append((int(left.key[n]), int(right.key[k]), ids[k], int(score[n - begin][k])))
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
        return pa.table([*columns, score_column([r[3] for r in out])], ["key", "positive_key", "positive_id", "score"])

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    same = dealt(table, asked, ["label", "dim"], tile_rows, tile_anchors).applyInArrow(nearest, "key long, positive_key long, positive_id long, score decimal(38,0)")
    near = top_per_key(same.withColumnsRenamed({"positive_id": "id", "positive_key": "row"}), ["key"], order, positives)
    # at most ``positives`` per anchor
    held = kept(near.groupBy("key").agg(F.collect_list(F.struct("row", "id", "score")).alias("near")), "positives")

    def windowed(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(c):
            left, right = Side(a), Side(c)
            ids, labels = right.rows.column("id").to_pylist(), np.array(right.rows.column("label").to_pylist(), object)
            near, own, names = (left.rows.column(k).to_pylist() for k in ("near", "label", "id"))
            for begin in range(0, len(left.key), step):
                end = min(begin + step, len(left.key))
                score = left.scores(begin, end, right)
                for n in range(begin, end):
                    line, other = score[n - begin], labels != own[n]
                    for p in near[n]:
                        value = int(p["score"])
                        # ceil and floor of the exact bounds
                        least, most = -(-low * value // 100), high * value // 100
                        # beyond a long nothing is found in 64-bit scores
                        fits = line.dtype == object or (least <= LONGEST and most >= -LONGEST)
                        if least > most or not fits:
                            continue
                        if line.dtype != object:
                            least, most = max(least, -LONGEST), min(most, LONGEST)
                        inside = np.flatnonzero(other & (line >= least) & (line <= most))
                        for k in best(line, inside, negatives).tolist():
                            out.append((int(left.key[n]), names[n], p["row"], p["id"], int(right.key[k]), ids[k], value, int(line[k])))
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(6)]
        scores = [score_column([r[k] for r in out]) for k in (6, 7)]
        return pa.table([*columns, *scores], ["key", "anchor_id", "positive_key", "positive_id", "row", "id", "positive_score", "score"])

    found = dealt(table, asked.join(held, "key"), ["dim"], tile_rows, tile_anchors).applyInArrow(
        windowed, "key long, anchor_id long, positive_key long, positive_id long, row long, id long, positive_score decimal(38,0), score decimal(38,0)"
    )
    ranked = top_per_key(found, ["key", "positive_key"], order, negatives)
    long = lambda c: F.least(F.greatest(F.col(c), F.lit(-LONGEST)), F.lit(LONGEST)).cast("long")
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        long("positive_score").alias("positive_score"), long("score").alias("negative_score"),
    )
