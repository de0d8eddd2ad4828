"""Connected components of an edge table by random contraction: rounds grow with the logarithm of the vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.store import kept, kept_counted


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` for every vertex of ``edges`` (``a``, ``b``); vertices of a component share a root.

    In each round a vertex moves to the neighbour, or itself, of least priority; priorities are hashes that change with the
    round, so a path shrinks by a constant factor. A hub's edges are aggregated before the shuffle. Null ends are left out.
    """
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, seen = kept_counted(left, "edges", n=F.count(F.lit(1)))
    moves: list[DataFrame] = []
    while seen["n"] or not moves:
        turn = len(moves)
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("v"))  # noqa: E731, B023
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        move = kept(near.select(F.col("a").alias("id"), F.least(rank("a"), F.col("least"))["v"].alias("to")), "moves")
        moves.append(move)
        ends = left.join(move.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(move.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        left, seen = kept_counted(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", n=F.count(F.lit(1)))
    found = moves[0].withColumnRenamed("to", "root")
    for move in moves[1:]:
        further = move.select(F.col("id").alias("root"), F.col("to").alias("_to"))
        found = found.join(further, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return found
