"""Exact top-k by inner product, with norm buckets.

Vectors are integers: floor(scale * x). Rows are ordered by length and cut into blocks of similar length.
A query is seeded with the products of the ``seed_rows`` longest vectors, a bounded set that every task gets; its k-th
best product is a lower bound from the start. A task meets a tile: some query blocks and some candidate blocks, longest
first. For a block whose longest vector has length L, a query of length |q| with bound b needs a cosine of at least
b / (|q| L), the local threshold:

* above 1, the block is skipped for the query;
* from ``coordinate_from`` on, candidates must have, in the query's largest coordinates, normalised values in the interval
  that this cosine allows (coordinate pruning);
* below, candidates need a length of at least b / |q| (length pruning).

What is left is verified by exact integer products, and raises the bound. Tiles give the k best of each query; the final
rank takes the best of all tiles.

Vectors that are null, empty, or hold null or non-finite components take no part; every other one does, integers beyond 2**62
counting as that and scores beyond a long as the largest long. A query meets only vectors of its own dimension. Repeated rows are vectors of their own: only the query's own row is
left out, and each repeated query row gets its own k results. Ties go to the smaller id, null ids last. An empty table
gives an empty result. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.store import kept_counted

LIMIT = float(1 << 62)
LAST = np.iinfo(np.int64).max


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``key`` (one per row), ``id``, ``dim``, ``norm`` and ``v`` (64-bit integers) of the rows that take part."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, column = (batch.column(k) for k in range(3))
            out = []
            for key, vec_id, vector in zip(keys.to_pylist(), ids.to_pylist(), column):
                if not vector.is_valid or not len(vector.values) or vector.values.null_count:
                    continue
                v = vector.values.to_numpy().astype(np.float64)
                if np.isfinite(v).all():
                    v = np.clip(np.floor(scale * np.clip(v, -LIMIT, LIMIT)), -LIMIT, LIMIT)
                    out.append((key, vec_id, len(v), float(np.sqrt(v @ v)), v.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()))],
                ["key", "id", "dim", "norm", "v"],
            )

    named = rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return named.mapInArrow(convert, "key long, id long, dim int, norm double, v binary")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in floating point where every sum fits into 53 bits, as Python integers where 63 may not do."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < LIMIT:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -LAST, LAST).astype(np.int64)


def below(score: np.integer) -> float:
    """A bound no larger than ``score``, which may have more digits than a float."""
    return float(np.nextafter(np.float64(score), -np.inf))


class Best:
    """The k best (score, id) of one query so far, and the bound they give."""

    def __init__(self, k: int, bound: float):
        self.k, self.bound = k, bound
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.bound
        if not good.any():
            return
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.bound = max(self.bound, below(self.score[-1]))


def survivors(q: np.ndarray, q_norm: float, bound: float, c: np.ndarray, norms: np.ndarray, coordinate_from: float, focus: int) -> np.ndarray | None:
    """Places in a block (longest vector first) that may reach ``bound``; None if all may."""
    if bound <= 0 or not q_norm:
        return None
    slack = 1 - 1e-9
    local = bound * slack / (q_norm * norms[0]) if norms[0] else np.inf
    if local > 1:
        return np.zeros(0, np.int64)
    long_enough = int(np.searchsorted(-norms, -(bound * slack / q_norm), "right"))
    left = np.arange(long_enough)
    if local >= coordinate_from:
        for f in np.argsort(-np.abs(q))[:focus]:
            x = q[f] / q_norm
            room = np.sqrt((1 - local * local) * max(0.0, 1 - x * x)) + 1e-9
            part = c[left, f] / norms[left]
            # the interval of a unit vector's coordinate, given its cosine with the query; open towards the query's own value
            high = 1.0 if x >= local else min(1.0, x * local + room)
            low = -1.0 if -x >= local else max(-1.0, x * local - room)
            left = left[(part >= low - 1e-9) & (part <= high + 1e-9)]
    return left


def top_k(
    rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024,
    seed_rows: int = 2048, block_rows: int = 1024, tile_queries: int = 1024, tile_rows: int = 16384, coordinate_from: float = 0.8, focus: int = 3,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best other rows of each row for which ``queries``, a
    condition on ``id``, holds."""
    spark = rows.sparkSession
    table, count = kept_counted(
        quantised(rows, id_col, vector_col, scale), "vectors", rows=F.count(F.lit(1)), queries=F.count_if(queries)
    )
    asked = table.where(queries)
    seeds: dict[int, tuple] = {}
    longest = table.orderBy(F.desc("norm"), "key").limit(seed_rows).collect()
    for dim in {r["dim"] for r in longest}:
        some = [r for r in longest if r["dim"] == dim]
        seeds[dim] = (np.array([r["key"] for r in some]), np.stack([np.frombuffer(r["v"], np.int64) for r in some]))
    seeds = spark.sparkContext.broadcast(seeds)
    query_tiles = max(1, -(-count["queries"] // tile_queries))
    row_tiles = max(1, -(-count["rows"] // tile_rows))

    def bounded(batches):
        for batch in batches:
            key, dim = batch.column("key").to_pylist(), batch.column("dim").to_pylist()
            bound = []
            for x, d, v in zip(key, dim, batch.column("v").to_pylist()):
                keys, seed = seeds.value.get(d, (None, None))
                score = products(np.frombuffer(v, np.int64)[None], seed)[0][keys != x] if keys is not None else []
                bound.append(below(np.partition(score, -k)[-k]) if len(score) >= k else float("-inf"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound, pa.float64())], [*batch.schema.names, "bound"])

    sides = "key long, id long, dim int, norm double, v binary, bound double"
    # queries are dealt by key, candidates by length: a tile is a run of similar lengths
    seeded = asked.mapInArrow(bounded, sides).withColumn("qt", F.pmod(F.xxhash64("key"), F.lit(query_tiles)).cast("int"))
    cuts = _length_cuts(table, row_tiles)
    tile = F.lit(0)
    for cut in cuts:
        tile = tile + (F.col("norm") < F.lit(cut)).cast("int")
    # equal lengths in one tile are dealt on, so that a common length is many tiles
    spread = max(1, -(-row_tiles // (len(cuts) + 1)))
    ranged = table.withColumn("ct", tile * spread + F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int"))
    left = seeded.withColumn("ct", F.explode(F.sequence(F.lit(0), F.lit((len(cuts) + 1) * spread - 1))))
    right = ranged.withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        c_norm = c.column("norm").to_numpy()
        order = np.argsort(-c_norm, kind="stable")
        c_norm, c_dim = c_norm[order], c.column("dim").to_numpy()[order]
        c_key = c.column("key").to_numpy()[order]
        ids = c.column("id").fill_null(LAST).to_numpy()[order]
        raw = c.column("v").take(pa.array(order)).to_pylist()
        blocks = []
        for dim in np.unique(c_dim):
            of = np.flatnonzero(c_dim == dim)
            for low in range(0, len(of), block_rows):
                part = of[low : low + block_rows]
                blocks.append((dim, part, np.stack([np.frombuffer(raw[i], np.int64) for i in part])))
        for key, query, dim, norm, v, bound in zip(*(q.column(n).to_pylist() for n in ("key", "id", "dim", "norm", "v", "bound"))):
            best, v = Best(k, bound), np.frombuffer(v, np.int64)
            for block_dim, part, c_v in blocks:
                if block_dim != dim:
                    continue
                left = survivors(v, norm, best.bound, c_v, c_norm[part], coordinate_from, focus)
                chosen, vectors = (part, c_v) if left is None else (part[left], c_v[left])
                if len(chosen):
                    score = products(v[None], vectors)[0]
                    other = c_key[chosen] != key
                    best.add(score[other], ids[chosen][other])
            out += [(key, query, i, s) for i, s in zip(best.id.tolist(), best.score.tolist())]
        return pa.table({n: pa.array([r[m] for r in out], pa.int64()) for m, n in enumerate(("key", "query_id", "vec_id", "score"))})

    scored = left.groupBy("qt", "ct").cogroup(right.groupBy("qt", "ct")).applyInArrow(meet, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(k))
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")


def _length_cuts(table: DataFrame, tiles: int) -> list[float]:
    """At most 63 lengths that cut the rows into runs of about equal size."""
    steps = min(tiles, 64)
    if steps < 2:
        return []
    found = table.approxQuantile("norm", [n / steps for n in range(1, steps)], 0.001)
    return sorted(set(found), reverse=True)
