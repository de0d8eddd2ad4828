"""Suffix-array dedup by the difference-cover algorithm, over UTF-8 bytes.

The suffixes to sort are dealt to shards: candidate segments (see ``winnow``) with one anchor hash go to one shard, so that
all places of an equal 400-byte string meet there, whatever documents they are in. Each shard sorts its suffixes by the
difference cover modulo 3: triples of the sampled places are sorted and named, the algorithm recurses on the names, the
remaining suffixes are sorted by their first byte and the rank behind it, and both are merged. Adjacent suffixes of the
order are then compared over their first ``size`` bytes; a string that starts in two places is removed from both.

Rows of ``repeated_bytes``: one per input row, in no order. A null text is empty; texts shorter than ``size`` lose nothing.
Repeated rows repeat each other's strings, so both lose them. A null ``doc_id`` stays null. Only ``doc_id`` and ``text``
are read. What is left need not be valid UTF-8, as a string may begin inside a character: it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm.text import chunks, tidy
from keelson.llm.winnow import Windows, covered, with_spans

BYTES = Windows("bytes", 400, 32, window_bits=0, shard_bytes=1_200_000)


def _named(keys: list[np.ndarray], wide: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of numbers, ``keys[k]`` below ``2**wide[k]``, and their dense ranks from 1."""
    packed, used = keys[0], wide[0]
    for key, bits in zip(keys[1:], wide[1:]):
        if used + bits > 63:
            packed = _named([packed], [used])[1]
            used = len(packed).bit_length()
        packed, used = (packed << bits) | key, used + bits
    order = np.argsort(packed)
    ranked = packed[order]
    names = np.empty(len(packed), np.int64)
    names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    return order, names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, integers from 1."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    wide, deep = int(s.max()).bit_length(), n.bit_length()
    cover = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    order, names = _named([t[cover], t[cover + 1], t[cover + 2]], [wide] * 3)
    if names[order[-1]] < len(names):
        order = suffix_array(names)
    sampled = cover[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    key = (t[rest] << deep) | rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[first] << deep) | rank[first + 1], key)
    # against places 2 modulo 3, two values and the rank behind them decide
    both = np.concatenate([rest, second])
    if 2 * wide + deep <= 63:
        key = (t[both] << wide + deep) | (t[both + 1] << deep) | rank[both + 2]
    else:
        key = (_named([t[both], t[both + 1]], [wide, wide])[1] << deep) | rank[both + 2]
    place = np.arange(len(rest)) + before + np.searchsorted(key[len(rest) :], key[: len(rest)])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sampled
    return out


def equal_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` are equal; eight are compared at once."""
    out = np.ones(len(a), bool)
    step = min(8, size)
    words = np.lib.stride_tricks.sliding_window_view(data, step)
    words = np.ascontiguousarray(words).view(np.uint64).ravel() if step == 8 else words
    left = np.arange(len(a))
    for k in [*range(0, size - step, step), size - step]:
        same = words[a[left] + k] == words[b[left] + k]
        same = same if same.ndim == 1 else same.all(axis=1)
        out[left[~same]] = False
        left = left[same]
    return out


def suffix_ranges(size: int):
    def repeated(bodies: list[bytes], weights: list[int]) -> list[np.ndarray]:
        # a mark below all bytes ends each body, so that no string runs on into the next
        lengths = np.array([len(b) for b in bodies], np.int64)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        end = np.cumsum(lengths)
        begin = end - lengths
        owner = np.repeat(np.arange(len(bodies)), lengths)
        s = np.ones(len(data) + len(bodies), np.int64)
        s[np.arange(len(data)) + owner] = data.astype(np.int64) + 2
        order = suffix_array(s)
        # back to places in data, without the marks
        mark = s[order] == 1
        body = np.searchsorted(end + np.arange(len(bodies)), order, "left")
        order = (order - body)[~mark]
        order = order[order + size <= end[owner[order]]]
        if not len(order):
            return [np.zeros((0, 2), np.int64)] * len(bodies)
        new = np.r_[True, ~equal_prefixes(data, order[:-1], order[1:], size)]
        group = np.cumsum(new) - 1
        twice = np.bincount(group, np.array(weights)[owner[order]])[group] > 1
        at = np.sort(order[twice])
        if not len(at):
            return [np.zeros((0, 2), np.int64)] * len(bodies)
        own = owner[at]
        new = np.r_[True, (at[1:] > at[:-1] + size) | (own[1:] != own[:-1])]
        low, high, own = at[new], at[np.r_[new[1:], True]] + size, own[new]
        pairs = np.stack([low - begin[own], high - begin[own]], axis=1)
        cuts = np.searchsorted(own, np.arange(len(bodies) + 1))
        return [pairs[cuts[k] : cuts[k + 1]] for k in range(len(bodies))]

    return repeated


def repeated_bytes(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges, in order) and ``kept`` (bytes left) of every document."""

    def remove(batches):
        for batch in batches:
            ids, text, found = (batch.column(k) for k in range(3))
            founds = found.to_pylist()
            n_bytes, spans, out = [], [], []
            for chunk in chunks(text):
                raw = chunk.data.tobytes()
                for k in range(chunk.high - chunk.low):
                    a, b = int(chunk.offsets[k]), int(chunk.offsets[k + 1])
                    have = founds[chunk.low + k]
                    n_bytes.append(b - a)
                    if not have:
                        spans.append([])
                        out.append(raw[a:b])
                        continue
                    gone = covered([(f["at"], f["spans"]) for f in have], b - a)
                    cut = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in cut.reshape(-1, 2)])
                    edges = np.r_[0, cut, b - a] + a
                    out.append(b"".join(raw[x:y] for x, y in edges.reshape(-1, 2)))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    return with_spans(docs, w, suffix_ranges(w.size)).mapInArrow(tidy(remove), schema)
