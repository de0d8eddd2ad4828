"""Where long runs of tokens repeat: the candidate search of the substring operators, over all documents.

A window is ``size`` consecutive tokens (words or bytes) of one document. Each window has an anchor: the leftmost of its
``gram``-token grams with the least hash. Equal windows have equal anchors at equal places, so a window can only repeat
if its anchor does. Every window belongs to exactly one anchor place, so the runs of windows with one anchor ("segments")
hold each window of the corpus exactly once, and all equal windows lie in segments with one anchor hash.

1. ``seen_twice`` over anchors, then over the windows of repeated anchors: bitmaps of hash buckets met at least twice.
   Their size is fixed, whatever the input; a full bitmap only lets more candidates pass, none is lost.
2. ``segments`` writes the occurrences of the segments of windows that passed, and each distinct segment once per task.
3. ``matched`` deals distinct segments by anchor hash to shards; a shard sees every occurrence of its windows and decides
   exactly. Copies of a segment come as one row with a count, however many documents hold it.
   An anchor whose segments are more than a shard is cut further: windows are counted by what the windows of a few
   neighbouring places of the anchor share, only those counted twice go on, and these are dealt by that key; keys that are
   still too large, by whole windows, of which a key has one content.
4. ``document_spans`` brings the spans back to their documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.store import kept, kept_counted
from keelson.llm.text import U64, Chunk, Rolling, byte_values, chunks, inside_one, mix, release, sliding_min, tidy, words

PART_BITS = 16
TIE = U64((1 << 24) - 1)
SLICE = 1 << 22
FLUSH_BYTES = 16 << 20
#: Buckets of the keys of documents with spans: 1 MB of bits, whatever the input; when they are full, more texts are shuffled.
KEY_BITS = 23


@dataclass(frozen=True)
class Windows:
    """What is searched: windows of ``size`` tokens, anchored by grams of ``gram`` tokens."""

    unit: str
    size: int
    gram: int
    anchor_bits: int = 27
    #: 0: windows are not tested before they are sent.
    window_bits: int = 28
    #: Bytes of distinct segments (before copies from other tasks are merged) for one shard.
    shard_bytes: int = 1_000_000


class Tokens:
    """Tokens of a chunk with their byte ranges."""

    def __init__(self, chunk: Chunk, unit: str):
        self.data = chunk.data
        if unit == "words":
            found = words(chunk.data, chunk.offsets)
            self.begin, self.end, self.first = found.begin, found.end, found.first
            self.values = found.hashes(chunk.data)
        else:
            self.begin = self.end = None
            self.first = chunk.offsets
            self.values = byte_values(chunk.data)

    def text(self, low: int, high: int) -> bytes:
        """The bytes of tokens ``low`` to ``high - 1``."""
        if self.begin is None:
            return self.data[low:high].tobytes()
        return self.data[self.begin[low] : self.end[high - 1]].tobytes()


def anchors(tokens: Tokens, w: Windows) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a chunk: the place of its anchor, the anchor's hash, and whether it lies in one document."""
    roll, n = Rolling(tokens.values), len(tokens.values)
    count = max(n - w.size + 1, 0)
    grams = roll.windows(w.gram)
    place = np.zeros(count, np.int64)
    for low in range(0, count, SLICE):
        high = min(count, low + SLICE)
        part = grams[low : high + w.size - w.gram]
        tagged = (part & ~TIE) | np.arange(len(part), dtype=np.uint64)
        place[low:high] = (sliding_min(tagged, w.size - w.gram + 1) & TIE).astype(np.int64) + low
    return roll, place, grams[place] if count else grams[:0], inside_one(n, w.size, tokens.first)


def test(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return ((bits[bucket >> U64(3)] >> (bucket & U64(7)).astype(np.uint8)) & 1).astype(bool)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of 16-bit values between ``cuts`` as binary cells."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.uint16))]
    )


def seen_twice(docs: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Bitmap of the ``2**bits`` buckets that got at least two of all hashes. ``docs`` has one column ``text``.

    Tasks send sorted bucket numbers; one compressed row per range of buckets comes back to the driver, ``2**bits / 8`` bytes
    in all at most. They are opened one by one, so the driver holds one bitmap and what is compressed.
    """
    mask = U64((1 << bits) - 1)

    def send(batches):
        def flush(got):
            bucket, count = np.unique(np.concatenate(got), return_counts=True)
            part = (bucket >> PART_BITS).astype(np.int64)
            parts = np.unique(part)
            more = bucket[count > 1]
            cuts = np.append(np.searchsorted(part, parts), len(part))
            cuts2 = np.searchsorted(more >> PART_BITS, np.append(parts, parts[-1] + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), _binary(bucket & 0xFFFF, cuts), _binary(more & 0xFFFF, cuts2)], ["part", "ones", "twos"]
            )

        got, size = [], 0
        for batch in batches:
            for found in hashes(batch.column(0)):
                if len(found):
                    got.append((found & mask).astype(np.uint32))
                    size += len(found)
            if size > 1 << 21:
                yield flush(got)
                got, size = [], 0
        if size:
            yield flush(got)

    def merge(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, ones, twos in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if part not in seen:
                    seen[part] = [np.zeros(1 << PART_BITS, bool), np.zeros(1 << PART_BITS, bool)]
                once, twice = seen[part]
                ones = np.frombuffer(ones, np.uint16)
                twice[ones[once[ones]]] = True
                twice[np.frombuffer(twos, np.uint16)] = True
                once[ones] = True
        rows = [(part, zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)) for part, (_, twice) in seen.items() if twice.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "bits"]
        )

    sent = docs.select("text").mapInArrow(tidy(send), "part int, ones binary, twos binary")
    merged = sent.repartition("part").mapInArrow(tidy(merge), "part int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (PART_BITS - 3)
    rows = merged.toArrow()
    for part, found in zip(rows.column("part").to_pylist(), rows.column("bits")):
        out[part * step : (part + 1) * step] = np.frombuffer(zlib.decompress(found.as_buffer()), np.uint8)
    del rows
    release()
    return out


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and a key made of both: equal rows share it, and get equal results. With ``carry``,
    all columns as they are in ``row``."""
    return docs.select(
        *([F.struct(*docs.columns).alias("row")] if carry else []),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(-1)).cast("long").alias("k1"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("k2"),
    )


def segments(docs: DataFrame, w: Windows) -> tuple[DataFrame, int]:
    """Occurrences (``body`` null) and distinct contents per task (``cnt`` occurrences) of all candidate segments, written
    once; and the bytes of the contents. ``docs`` is ``keyed``."""

    def anchor_hashes(column):
        for chunk in chunks(column):
            _, place, found, ok = anchors(Tokens(chunk, w.unit), w)
            new = ok.copy()
            new[1:] &= ~(ok[:-1] & (place[1:] == place[:-1]))
            yield found[new]

    spark = docs.sparkSession
    anchor_bitmap = spark.sparkContext.broadcast(seen_twice(docs, anchor_hashes, w.anchor_bits))
    anchor_mask, window_mask = U64((1 << w.anchor_bits) - 1), U64((1 << w.window_bits) - 1)

    def window_hashes(column):
        bits = anchor_bitmap.value
        for chunk in chunks(column):
            roll, _, found, ok = anchors(Tokens(chunk, w.unit), w)
            at = np.flatnonzero(ok)
            at = at[test(bits, found[at] & anchor_mask)]
            yield roll.spans(at, at + w.size)

    window_bitmap = spark.sparkContext.broadcast(seen_twice(docs, window_hashes, w.window_bits) if w.window_bits else None)

    names = ["h", "sh", "k1", "k2", "at", "n", "cnt", "body"]

    def cut(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0

        def contents():
            rows = [(a, b, c, t) for (a, b), (c, t) in held.items()]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), none, none, none, none,
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names
            )

        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            k1 = batch.column(batch.schema.get_field_index("k1")).to_numpy()
            k2 = batch.column(batch.schema.get_field_index("k2")).to_numpy()
            for chunk in chunks(text):
                tokens = Tokens(chunk, w.unit)
                roll, place, found, ok = anchors(tokens, w)
                at = np.flatnonzero(ok)
                at = at[test(anchor_bitmap.value, found[at] & anchor_mask)]
                if w.window_bits:
                    at = at[test(window_bitmap.value, roll.spans(at, at + w.size) & window_mask)]
                if not len(at):
                    continue
                start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])])
                low = at[start]
                n = np.diff(np.append(start, len(at)))
                high = low + n + w.size - 1
                h, sh = found[low].view(np.int64), roll.spans(low, high).view(np.int64)
                doc = np.searchsorted(tokens.first, low, "right") - 1
                row = chunk.low + doc
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(sh), pa.array(k1[row]), pa.array(k2[row]), pa.array((low - tokens.first[doc]).astype(np.int64)),
                     pa.array(n.astype(np.int64)), pa.array(np.zeros(len(low), np.int64)), pa.nulls(len(low), pa.binary())], names
                )
                for a, b, x, y in zip(h.tolist(), sh.tolist(), low.tolist(), high.tolist()):
                    have = held.get((a, b))
                    if have is None:
                        body = tokens.text(x, y)
                        held[a, b] = [1, body]
                        size += len(body) + 200
                    else:
                        have[0] += 1
                if size > FLUSH_BYTES:
                    yield contents()
                    held.clear()
                    size = 0
        if held:
            yield contents()

    found = docs.select("text", "k1", "k2").mapInArrow(tidy(cut), "h long, sh long, k1 long, k2 long, at long, n long, cnt long, body binary")
    table, counts = kept_counted(found, "segments", size=F.sum(F.length("body")))
    return table, counts["size"]


def trimmed(bodies: list[bytes], weights: np.ndarray, w: Windows, repeated: Callable[[list[bytes], list[int]], list[np.ndarray]]) -> list[np.ndarray]:
    """``repeated`` over the runs of windows whose hash is met twice in the shard, each distinct run once.

    Contexts of one passage differ around it; without what differs, thousands of them are one run.
    """
    offsets = np.zeros(len(bodies) + 1, np.int64)
    np.cumsum([len(b) for b in bodies], out=offsets[1:])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    tokens = Tokens(Chunk(0, len(bodies), data, offsets), w.unit)
    roll = Rolling(tokens.values)
    at = np.flatnonzero(inside_one(len(tokens.values), w.size, tokens.first))
    owner = np.searchsorted(tokens.first, at, "right") - 1
    _, which = np.unique(roll.spans(at, at + w.size), return_inverse=True)
    twice = np.bincount(which, weights[owner])[which] > 1
    at, owner = at[twice], owner[twice]
    out = [np.zeros((0, 2), np.int64)] * len(bodies)
    if not len(at):
        return out
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]
    low, owner = at[new], owner[new]
    high = at[np.r_[new[1:], True]] + w.size
    hashes = roll.spans(low, high)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    runs = [tokens.text(low[k], high[k]) for k in first]
    spans = repeated(runs, np.bincount(which, weights[owner]).astype(np.int64).tolist())
    found: dict[int, list[np.ndarray]] = {}
    for k, doc, start in zip(which.tolist(), owner.tolist(), (low - tokens.first[owner]).tolist()):
        if len(spans[k]):
            found.setdefault(doc, []).append(spans[k] + start)
    for doc, parts in found.items():
        out[doc] = np.concatenate(parts)
    return out


def matched(table: DataFrame, size: int, w: Windows, repeated: Callable[[list[bytes], list[int]], list[np.ndarray]]) -> DataFrame:
    """Per distinct segment, the token ranges covered by repeated windows: ``h``, ``sh``, ``shift``, ``spans`` (pairs of 32-bit
    integers, counted from token ``shift``). A segment may have several rows.

    ``repeated`` gets the distinct segments of one shard and how often each occurs, and returns an array of ranges for each.
    """
    widths = sorted({max(1, w.size // 24), 1}, reverse=True)
    return _matched(table.where("cnt > 0").select("h", "sh", "cnt", "body"), size, w, repeated, widths)


def _matched(contents: DataFrame, size: int, w: Windows, repeated, widths: list[int]) -> DataFrame:
    """``matched`` for ``h``, ``sh``, ``cnt`` and ``body``. Segments of an anchor with more than a shard's bytes are cut into
    pieces (see ``pieces``) of ``widths[0]`` windows each, and those go on under their own keys."""
    if not widths:
        return _dealt(contents, size, w, repeated)
    hot = contents.groupBy("h").agg(F.sum(F.length("body")).alias("bytes")).where(F.col("bytes") > w.shard_bytes)
    hot, seen = kept_counted(hot, "hot", n=F.count(F.lit(1)), bytes=F.sum("bytes"))
    if not seen["n"]:
        return _dealt(contents, size, w, repeated)
    whole = contents.join(hot, "h", "left_semi").groupBy("h", "sh").agg(F.sum("cnt").alias("cnt"), F.first("body").alias("body"))
    whole = kept(whole, "whole")
    cut = kept(pieces(whole, w, widths[0]), "pieces")
    # an equal window elsewhere lies in a piece with the same key
    twice = cut.groupBy("ph").agg(F.sum("cnt").alias("places")).where("places > 1").select("ph")
    cut = kept(cut.join(twice, "ph", "left_semi"), "pieces")
    one = cut.groupBy("ph", "psh").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("h", "sh", "begin", "length")).alias("one"))
    one = one.select("ph", "psh", F.col("cnt").alias("places"), "one.*").join(whole.select("h", "sh", "body"), ["h", "sh"])
    one = one.select(F.col("ph").alias("h"), F.col("psh").alias("sh"), F.col("places").alias("cnt"), F.expr("substring(body, begin + 1, length)").alias("body"))
    one, further = kept_counted(one, "contents", size=F.sum(F.length("body")))
    found = _matched(one, further["size"], w, repeated, widths[1:]).withColumnsRenamed({"h": "ph", "sh": "psh", "shift": "inner"})
    back = cut.join(found, ["ph", "psh"]).select("h", "sh", (F.col("shift") + F.col("inner")).alias("shift"), "spans")
    cool = _dealt(contents.join(hot, "h", "left_anti"), max(0, size - seen["bytes"]), w, repeated)
    return cool.union(back)


def pieces(whole: DataFrame, w: Windows, width: int) -> DataFrame:
    """Runs of windows of each segment by the place of the anchor in them: ``ph``, ``psh``, ``h``, ``sh``, ``cnt``, ``begin`` and
    ``length`` (bytes of the body), ``shift`` (its first token).

    The windows with the anchor at places ``k * width`` to ``k * width + width - 1`` share ``size - width + 1`` tokens; ``ph``
    is their hash. Equal windows have equal keys, and windows differ from others of their key in ``width - 1`` tokens at most.
    """

    def cut(batches):
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(3)]
            for chunk in chunks(batch.column(3)):
                tokens = Tokens(chunk, w.unit)
                roll, place, _, ok = anchors(tokens, w)
                at = np.flatnonzero(ok)
                zone = (place[at] - at) // width
                owner = np.searchsorted(tokens.first, at, "right") - 1
                start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (zone[1:] != zone[:-1])][: len(at)])
                low, zone, owner = at[start], zone[start], owner[start]
                high = low + np.diff(np.append(start, len(at))) + w.size - 1
                key = place[low] - zone * width
                ph = mix(roll.spans(key, key + w.size - width + 1) ^ mix(zone.astype(np.uint64) + U64(width << 32)))
                psh = roll.spans(low, high)
                base = chunk.offsets[owner]
                first, last = (low, high) if tokens.begin is None else (tokens.begin[low], tokens.end[high - 1])
                row = chunk.low + owner
                arrays = [ph.view(np.int64), psh.view(np.int64), *(c[row] for c in cols), first - base, last - first, low - tokens.first[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(a).astype(np.int64)) for a in arrays], names)

    names = ["ph", "psh", "h", "sh", "cnt", "begin", "length", "shift"]
    return whole.select("h", "sh", "cnt", "body").mapInArrow(
        tidy(cut), "ph long, psh long, h long, sh long, cnt long, begin long, length long, shift long"
    )


def _dealt(contents: DataFrame, size: int, w: Windows, repeated) -> DataFrame:
    """``matched`` by shards of anchors."""
    shards = max(1, -(-size // w.shard_bytes))

    def shard(group: pa.Table) -> pa.Table:
        h, sh, cnt = (group.column(c).to_numpy() for c in ("h", "sh", "cnt"))
        order = np.lexsort((sh, h))
        h, sh, cnt = h[order], sh[order], cnt[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])]
        first = np.flatnonzero(new)
        total = np.add.reduceat(cnt, first)
        anchor = np.cumsum(np.r_[True, h[first][1:] != h[first][:-1]]) - 1
        keep = first[np.bincount(anchor, total)[anchor] > 1]
        total = total[np.bincount(anchor, total)[anchor] > 1]
        bodies = group.column("body").take(pa.array(order[keep])).to_pylist()
        spans = trimmed(bodies, total, w, repeated) if bodies else []
        release()
        rows = [(a, b, s.astype(np.int32).tobytes()) for a, b, s in zip(h[keep].tolist(), sh[keep].tolist(), spans) if len(s)]
        return pa.table(
            {"h": pa.array([r[0] for r in rows], pa.int64()), "sh": pa.array([r[1] for r in rows], pa.int64()), "spans": pa.array([r[2] for r in rows], pa.binary())}
        )

    sharded = contents.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    found = sharded.groupBy("shard").applyInArrow(shard, "h long, sh long, spans binary")
    return found.select("h", "sh", F.lit(0).cast("long").alias("shift"), "spans")


def document_spans(table: DataFrame, spans: DataFrame) -> DataFrame:
    """``k1``, ``k2`` and ``found``: the (place, ranges) pairs of each document that has any."""
    occurrences = table.where("cnt = 0").select("h", "sh", "k1", "k2", "at")
    return occurrences.join(spans, ["h", "sh"]).groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("at") + F.col("shift")).alias("at"), "spans")).alias("found"))


def covered(found, n: int) -> np.ndarray:
    """Which of a document's ``n`` tokens lie in one of its ranges."""
    steps = np.zeros(n + 1, np.int32)
    for place, spans in found:
        pairs = np.frombuffer(spans, np.int32).reshape(-1, 2)
        np.add.at(steps, pairs[:, 0] + place, 1)
        np.add.at(steps, pairs[:, 1] + place, -1)
    return np.cumsum(steps[:-1]) > 0


def parted(docs: DataFrame, keys: DataFrame, bits: int = KEY_BITS, by: Column | str = "k2") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``by`` may be one of ``keys``, and those whose ``by`` is none, by a broadcast bitmap of hash buckets."""
    bucket = F.pmod(by, F.lit(1 << bits))
    table = keys.groupBy(F.bitmap_bucket_number(bucket).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("_bits"))
    place = F.bitmap_bit_position(bucket)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tested = docs.withColumn("_part", F.bitmap_bucket_number(bucket)).join(F.broadcast(table), "_part", "left")
    tested = tested.withColumn("_there", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    return tuple(tested.where(c).drop("_part", "_bits", "_there") for c in (F.col("_there"), ~F.col("_there")))


def with_spans(docs: DataFrame, w: Windows, repeated: Callable[[list[bytes], list[int]], list[np.ndarray]], carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` and ``found`` (null where nothing repeats) of every document, and ``row`` with ``carry``.

    Only texts that may have spans are shuffled to them; the others go on from where they were read.
    """
    rows = keyed(docs)
    table, size = segments(rows, w)
    spans = kept(document_spans(table, matched(table, size, w, repeated)), "spans")
    there, other = parted(keyed(docs, carry), spans.select("k2"))
    columns = ["doc_id", "text", "found", *(["row"] if carry else [])]
    return there.join(spans, ["k1", "k2"], "left").select(columns).union(other.withColumn("found", F.lit(None).cast(spans.schema["found"].dataType)).select(columns))
