"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. The model of a category sees the words of the text and the log-odds of all
earlier categories. When a later model is trained, those come from models that have not seen the row: the training rows are
dealt into folds, and each fold is predicted by models of the others. Models for the whole table are fit on all rows.

Features are whether a text holds a word, a word's beginning (4 to 7 bytes) or its end (2 or 3 bytes), A-Z lowered, hashed
into ``2**18`` places. The places kept for a category are those whose shares of texts in its two classes differ most,
by a z-score over the training rows.

Bounds: ``max_rows`` labelled rows are used for fitting in expectation, chosen by a hash of ``doc_id``; ``max_features``
places per category. Texts are scored whole, all of them.

A null or empty text has no features and gets the base rates. Rows with a null label of a category, or without labels, train
nothing; repeated label rows count once. A category with one class only gets a constant model. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keelson.llm.store import kept
from keelson.llm.text import LOWER, U64, Rolling, byte_values, chunks, mix, tidy, words

BITS = 18
SIZE = 1 << BITS
#: Places worked on at once while fitting, to bound what the driver holds beside the sample.
BLOCK = 1 << 18


def features(column: pa.Array):
    """Row and places (sorted, each once) of each document of a string column."""
    for chunk in chunks(column):
        data = LOWER[chunk.data]
        found = words(data, chunk.offsets)
        roll = Rolling(byte_values(data))
        length = found.end - found.begin
        doc = np.searchsorted(found.first, np.arange(len(length)), "right") - 1
        parts, owner = [roll.spans(found.begin, found.end)], [doc]
        for size in (4, 5, 6, 7):
            at = np.flatnonzero(length > size)
            parts.append(mix(roll.spans(found.begin[at], found.begin[at] + size) + U64(1)))
            owner.append(doc[at])
        for size in (2, 3):
            at = np.flatnonzero(length > size)
            parts.append(mix(roll.spans(found.end[at] - size, found.end[at]) + U64(2)))
            owner.append(doc[at])
        n = chunk.high - chunk.low
        both = np.unique(np.concatenate(owner).astype(np.int64) << BITS | (np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64))
        cuts = np.searchsorted(both >> BITS, np.arange(n + 1))
        place = both & (SIZE - 1)
        for k in range(n):
            yield chunk.low + k, place[cuts[k] : cuts[k + 1]]


@dataclass
class Linear:
    """A linear model over places and earlier log-odds."""

    weight: np.ndarray
    earlier: np.ndarray
    bias: float

    def logit(self, rows: np.ndarray, cols: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weight[cols], n) + before @ self.earlier + self.bias


def blocks(starts: np.ndarray):
    """Ranges of rows of about ``BLOCK`` places: first row and row behind."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + BLOCK, "right")) - 1)
        yield low, high
        low = high


def sums(weight: np.ndarray, starts: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Per row, the weights of its places added up."""
    out = np.zeros(len(starts) - 1)
    for low, high in blocks(starts):
        begin = starts[low:high]
        some = begin < starts[low + 1 : high + 1]
        if some.any():
            out[low:high][some] = np.add.reduceat(weight[cols[starts[low] : starts[high]]], begin[some] - begin[0])
    return out


def spread(value: np.ndarray, starts: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """Per place, the values of the rows that hold it added up."""
    out = np.zeros(size)
    for low, high in blocks(starts):
        out += np.bincount(cols[starts[low] : starts[high]], np.repeat(value[low:high], np.diff(starts[low : high + 1])), size)
    return out


def chosen_rows(chosen: np.ndarray, starts: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``cols`` of some rows."""
    size = np.diff(starts)
    return np.append(0, np.cumsum(size[chosen])), cols[np.repeat(chosen, size)]


def fit(starts: np.ndarray, cols: np.ndarray, places: np.ndarray, before: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 300) -> Linear:
    """Logistic regression with an L2 penalty, by accelerated gradient steps scaled per feature. Row k holds the places
    ``cols[starts[k]:starts[k + 1]]``."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    out = Linear(np.zeros(SIZE), np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return out
    useful = np.zeros(SIZE, bool)
    useful[places] = True
    on = useful[cols]
    number = (np.cumsum(useful) - 1).astype(np.int32)  # ``places`` ascend
    size, extra = sums(useful.astype(float), starts, cols).astype(np.int64), before.shape[1]
    starts, at = np.append(0, np.cumsum(size)), number[cols[on]]
    # the curvature of each feature, and how many features share a row, bound the step
    crowd = size + np.abs(before).sum(axis=1) + 1
    curve = 0.25 * np.concatenate([spread(crowd, starts, at, len(places)), (np.abs(before) * crowd[:, None]).sum(axis=0), [crowd.sum()]]) + penalty
    w = np.concatenate([np.zeros(len(places) + extra), [out.bias]])
    look, momentum = w.copy(), 1.0
    for _ in range(steps):
        z = sums(look, starts, at) + before @ look[len(places) : len(places) + extra] + look[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.concatenate([spread(error, starts, at, len(places)), error @ before, [error.sum()]]) + penalty * look
        gradient[-1] -= penalty * look[-1]
        new = look - gradient / curve
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    out.weight[places] = w[: len(places)]
    out.earlier = w[len(places) : len(places) + extra]
    out.bias = float(w[-1])
    return out


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def logits(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, np.clip(model.logit(rows, cols, n, out), -8, 8)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = 20_000, max_features: int = 3000, folds: int = 3) -> Chain:
    """Fit a chain on labelled rows: ``labels`` has ``doc_id`` and one 0/1 column per category, in chain order."""
    spark = docs.sparkSession
    names = [f"y{k}" for k in range(len(categories))]
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names)]).dropna()
    # of several label rows of a document a category counts if any names it
    known = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # about max_rows short rows, whatever the input
    sample = kept(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")

    def seen(batches):
        counts = np.zeros((2 * len(names), SIZE), np.int64)
        rows = np.zeros(2 * len(names), np.int64)
        for batch in batches:
            y = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            for row, place in features(batch.column("text")):
                for k in range(len(names)):
                    counts[2 * k + y[row, k], place] += 1
                    rows[2 * k + y[row, k]] += 1
        for k in range(2 * len(names)):
            at = np.flatnonzero(counts[k])
            at = np.append(at, SIZE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.append(counts[k][at[:-1]], rows[k]))], ["k", "place", "n"]
            )

    totals = np.zeros((2 * len(names), SIZE + 1))
    # 2 * categories * 2**18 counts at most
    got = sample.mapInArrow(tidy(seen), "k int, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
    totals[got.column("k").to_numpy(), got.column("place").to_numpy()] = got.column("n").to_numpy()
    kept_places = []
    for k in range(len(names)):
        no, yes = totals[2 * k], totals[2 * k + 1]
        a, b = max(no[-1], 1), max(yes[-1], 1)
        p, q = no[:-1] / a, yes[:-1] / b
        both = (no[:-1] + yes[:-1]) / (a + b)
        z = np.abs(p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / a + 1 / b) + 1e-12)
        best = np.argsort(-z, kind="stable")[:max_features]
        kept_places.append(np.sort(best[z[best] > 3]))
    useful = np.zeros(SIZE, bool)
    for p in kept_places:
        useful[p] = True
    shared = spark.sparkContext.broadcast(useful)

    def chosen_features(batches):
        for batch in batches:
            got = [place[shared.value[place]].astype(np.int32).tobytes() for _, place in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(batch.column(n) for n in names), pa.array(got, pa.binary())], ["doc_id", *names, "places"])

    schema = "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", places binary"
    table = sample.mapInArrow(tidy(chosen_features), schema).orderBy("doc_id").toArrow()
    held = table.column("places").to_pylist()
    n = len(held)
    starts = np.append(0, np.cumsum([len(p) // 4 for p in held], dtype=np.int64))
    cols = np.frombuffer(b"".join(held), np.int32)
    del held
    table = table.drop(["places"])
    fold = np.arange(n) % folds
    chain, before = Chain(list(categories)), np.zeros((n, 0))
    for k, name in enumerate(names):
        y = table.column(name).to_numpy().astype(float)
        chain.models.append(fit(starts, cols, kept_places[k], before, y))
        if k + 1 < len(names):
            unseen = np.zeros(n)
            for f in range(folds):
                inside = fold != f
                model = fit(*chosen_rows(inside, starts, cols), kept_places[k], before[inside], y[inside])
                some = before[~inside] @ model.earlier + model.bias + sums(model.weight, *chosen_rows(~inside, starts, cols))
                unseen[~inside] = np.clip(some, -8, 8)
            before = np.column_stack([before, unseen])
    return chain


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows of ``docs`` with ``p_<category>``; other columns pass through (a column of such a name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.categories]
    rows = docs.drop(*[c for c in docs.columns if c in added])
    text = rows.columns.index("text")

    def predict(batches):
        for batch in batches:
            got = [place for _, place in features(batch.column(text))]
            n = len(got)
            index = np.repeat(np.arange(n), [len(p) for p in got])
            logits = shared.value.logits(index, np.concatenate([*got, np.zeros(0, np.int64)]), n)
            p = 1 / (1 + np.exp(-logits))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], [*batch.schema.names, *added])

    schema = StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name in added)])
    return rows.mapInArrow(tidy(predict), schema)
