"""Packing documents into fixed windows by non-negative least squares over the histogram of lengths.

1. Each document is tokenised and cut into full windows and one rest. Lengths are put into classes of ``grain`` tokens,
   rounded up, so there are ``window / grain`` classes, whatever the input.
2. Strategies are all combinations of at most ``depth`` classes that fill a window exactly. Non-negative least squares finds
   repeat counts whose total use of the classes comes closest to the histogram.
3. Counts are rounded down, largest first, as far as the pieces reach; strategies that still fit are then added greedily.
4. Pieces get places by their running number in their class: one prefix sum over (task, class) counts, no sort of a class.
   What no strategy takes is laid end to end and cut at window borders; the end is cut into powers of two.

Only class counts reach the driver. Padding is what rounding up to ``grain`` leaves, and none in the last part.

A null or empty text is the end token alone. Repeated rows are packed once each; a null ``doc_id`` stays null. A long
document becomes many rows of at most one window. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.store import kept
from keelson.llm.text import tidy
from keelson.llm.tokens import encoded


def strategies(present: np.ndarray, units: int, depth: int) -> list[tuple[int, ...]]:
    """All combinations of at most ``depth`` classes, largest first, that add up to ``units``."""
    there = set(present.tolist())

    def extend(left: int, most: int, more: int) -> list[tuple[int, ...]]:
        if more == 1:
            return [(left,)] if left <= most and left in there else []
        out = [(left,)] if left <= most and left in there else []
        for size in sorted(there, reverse=True):
            if size <= most and size < left and size * more >= left:
                out += [(size, *rest) for rest in extend(left - size, size, more - 1)]
        return out

    return extend(units, units, depth)


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Least squares of ``a x = b`` with ``x >= 0``: the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    gradient = a.T @ b
    for _ in range(rounds):
        gradient[used] = -np.inf
        if not len(gradient) or gradient.max() <= 1e-9 * scale:
            break
        used[int(gradient.argmax())] = True
        while True:
            at = np.flatnonzero(used)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if solved.min() > 0:
                break
            down = solved <= 0
            step = (x[at] / np.where(down, x[at] - solved, 1))[down].min()
            x[at] += step * (solved - x[at])
            used[at[x[at] <= 1e-12 * scale]] = False
            x[~used] = 0
            if not used.any():
                break
        x[:] = 0
        x[at] = np.maximum(solved, 0) if used.any() else 0
        gradient = a.T @ (b - a @ x)
    return x


def plan(counts: dict[int, int], units: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Strategies and how often to use each; no class is used more often than ``counts`` has it."""
    left = {c: n for c, n in counts.items() if n > 0}
    chosen = [((units,), left.pop(units))] if left.get(units) else []
    classes = np.array(sorted(left), np.int64)
    found = [s for s in strategies(classes, units, depth) if len(s) > 1]
    if not found:
        return chosen
    row = {c: k for k, c in enumerate(classes.tolist())}
    a = np.zeros((len(classes), len(found)))
    for k, s in enumerate(found):
        for c in s:
            a[row[c], k] += 1
    x = non_negative(a, np.array([float(left[c]) for c in classes.tolist()]), 2 * len(classes))

    def take(s: tuple[int, ...], most: int | None) -> None:
        times = min(left[c] // s.count(c) for c in set(s))
        times = times if most is None else min(times, most)
        if times > 0:
            chosen.append((s, times))
            for c in s:
                left[c] -= times

    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] < 1:
            break
        take(found[k], int(x[k]))
    for s in found:
        take(s, None)
    return chosen


def _places(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, tuple], int]:
    """For each class, runs of its pieces in order: (first number, first sequence, pieces per sequence, first slot)."""
    runs: dict[int, list] = {}
    total, taken = 0, {}
    for s, times in chosen:
        for c in sorted(set(s)):
            runs.setdefault(c, []).append((taken.get(c, 0), total, s.count(c), s.index(c)))
            taken[c] = taken.get(c, 0) + s.count(c) * times
        total += times
    return {c: (tuple(np.array(v) for v in zip(*r)), taken[c]) for c, r in runs.items()}, total


def tail_borders(total: int, window: int) -> np.ndarray:
    """Where sequences of the last part begin: every ``window`` tokens, then powers of two for what is left."""
    rest, at, out = total % window, total - total % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return np.array(out, np.int64)


def tokenised(docs: DataFrame, tokenizer_path: str, end: int, window: int, grain: int) -> DataFrame:
    """Rows of at most one window: where they are (``pid``, ``row``), their class and number in it within the task."""

    def cut(batches):
        pid, row, seen = TaskContext.get().partitionId(), 0, np.zeros(window // grain + 1, np.int64)
        names = ["pid", "row", "doc_id", "start", "n", "doc_tokens", "cls", "nth", "ids"]
        for batch in batches:
            doc_ids = batch.column(0)
            out, size = [], 0
            for at, ids in encoded(batch.column(1), tokenizer_path, end):
                for low in range(0, len(ids), window):
                    part = ids[low : low + window]
                    cls = -(-len(part) // grain)
                    out.append((row, at, low, len(part), len(ids), cls, int(seen[cls]), part.tobytes()))
                    seen[cls] += 1
                    row += 1
                    size += len(part)
                if size > 1 << 21:
                    yield _batch(out, pid, doc_ids, names)
                    out, size = [], 0
            if out:
                yield _batch(out, pid, doc_ids, names)

    def _batch(out, pid, doc_ids, names):
        rows, at, low, n, total, cls, nth, ids = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(rows), pa.int64()), pa.array(rows, pa.int64()), doc_ids.take(pa.array(at)), pa.array(low, pa.int64()),
             pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(cls, pa.int32()), pa.array(nth, pa.int64()), pa.array(ids, pa.binary())], names
        )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        tidy(cut), f"pid long, row long, doc_id {kind}, start long, n long, doc_tokens long, cls int, nth long, ids binary"
    )


def pack(docs: DataFrame, tokenizer_path: str, end: int = 2, window: int = 4096, grain: int = 16, depth: int = 3) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (little-endian 32 bits)."""
    tokens = kept(tokenised(docs, tokenizer_path, end, window, grain), "tokens")
    counts = tokens.groupBy("pid", "cls").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))), "offsets")
    histogram = {r["cls"]: r["c"] for r in offsets.groupBy("cls").agg(F.sum("c").alias("c")).collect()}
    places, planned = _places(plan(histogram, window // grain, depth))

    def place(batches):
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.full(len(cls), -1, np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                if c in places:
                    (first, base, each, start), taken = places[c]
                    at = np.flatnonzero((cls == c) & (rank < taken))
                    run = np.searchsorted(first, rank[at], "right") - 1
                    sequence[at] = base[run] + (rank[at] - first[run]) // each[run]
                    slot[at] = start[run] + (rank[at] - first[run]) % each[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("pid", "row", "n")), pa.array(sequence), pa.array(slot)], ["pid", "row", "n", "sequence_id", "slot"]
            )

    ranked = tokens.select("pid", "row", "n", "cls", "nth").join(offsets.select("pid", "cls", "before"), ["pid", "cls"])
    ranked = ranked.select("pid", "row", "n", "cls", (F.col("before") + F.col("nth")).alias("rank"))
    placed = kept(ranked.mapInArrow(place, "pid long, row long, n long, sequence_id long, slot long"), "places")

    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    exact = placed.where("sequence_id >= 0").select(
        "pid", "row", F.lit(0).cast("long").alias("skip"), F.col("n").alias("length"), "sequence_id",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )

    rest = placed.where("sequence_id < 0")
    sums = rest.groupBy("pid").agg(F.sum("n").alias("tokens"))
    base = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pid", F.coalesce(F.sum("tokens").over(base), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    laid = rest.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "pid").withColumn("at", F.col("at") + F.col("base"))
    total = rest.agg(F.sum("n").alias("n")).first()["n"] or 0
    ends = tail_borders(total, window)
    full = total // window

    def cut(batches):
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()

            def sequence(x):
                tail = np.searchsorted(ends, x, "right") - 1
                inner = np.minimum(x // window, full)
                return np.where(tail >= 0, full + tail, inner), np.where(tail >= 0, ends[tail] if len(ends) else 0, inner * window)

            first, last = sequence(at)[0], sequence(at + n - 1)[0]
            pieces = last - first + 1
            which = np.repeat(np.arange(len(n)), pieces)
            number = np.repeat(first - np.cumsum(pieces) + pieces, pieces) + np.arange(int(pieces.sum()))
            begin = np.where(number < full, number * window, ends[np.clip(number - full, 0, max(len(ends) - 1, 0))] if len(ends) else 0)
            after = np.where(number + 1 <= full, (number + 1) * window, total)
            if len(ends):
                borders = np.append(ends, total)
                after = np.where(number >= full, borders[np.clip(number - full + 1, 0, len(ends))], after)
            low, high = np.maximum(at[which], begin), np.minimum((at + n)[which], after)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid").take(pa.array(which)), batch.column("row").take(pa.array(which)), pa.array(low - at[which]),
                 pa.array(high - low), pa.array(number + planned), pa.array(low - begin)],
                ["pid", "row", "skip", "length", "sequence_id", "offset"],
            )

    schema = "pid long, row long, skip long, length long, sequence_id long, offset long"
    loose = laid.select("pid", "row", "n", "at").mapInArrow(cut, schema)
    pieces = exact.union(loose)
    whole = tokens.select("pid", "row", "doc_id", "start", "doc_tokens", "ids")
    return whole.join(pieces, ["pid", "row"]).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", "doc_tokens", "sequence_id", "offset",
        F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * length as int))").alias("ids"),
    )
