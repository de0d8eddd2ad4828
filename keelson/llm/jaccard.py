"""Exact Jaccard join of word-shingle sets as a metric-space join.

The Jaccard distance d = 1 - J is a metric; documents link at d <= r = 1 - J0.

1. Documents with equal sets are one vertex, named by a 64-bit digest of the set; copies are not compared.
2. Voronoi regions. Order each set by a fixed order of all shingles, rarest first. Two linked sets share at least c of
   their first n - ceil(J0 n) + c shingles. So, with c of ``slack`` hundredths of n, a document of whose first shingles too
   few are held by another vertex is farther than r from all others and is left out. One document of each vertex sends its
   first shingles, 12 bytes each, dealt by hash: who else holds one is decided where all holders meet, and not by a table of
   fixed size, which a large corpus would fill. And, with c of 1, a document belongs to the regions of the pivots it shares
   a first shingle with: each such shingle that two vertices hold names a pivot, its vertex of least digest, and a document
   near several pivots is replicated into all their regions. Two linked documents share such a shingle, so they meet in a
   region. Only vertices of a region of two or more send their sets. Rarity is read from a count of fixed size over hash
   buckets of all shingles: common passages sink to the end of every set, and any order is a right one.
3. A large region is cut into rings by set size, each document being in its ring and the next: linked sizes differ by at
   most a factor 1 / J0.
4. A region joins recursively: the smallest set is the pivot, distances to it are exact. Documents within r are linked. By
   the triangle inequality a document beyond 2 r has no link into that ball; one between r and 2 r is compared with the
   ball's documents whose distance to the pivot is at least its own less r. All beyond r are joined among themselves.
5. A region or ring too large for one task is joined by ``rounds``: some of its members go to all tasks, its members stay
   where they are and are compared with those, until only pairs in one component are left. Memory of a task is bounded;
   work is quadratic in members that are in a region and link with few of it.
6. Links found span the components of each region; ``components`` joins regions.

Words are lower-cased in A-Z. With fewer words than a shingle has, the whole sequence is the one shingle; without words or
text the set is empty and linked with nothing. Equal rows get equal results; a null ``doc_id`` can link others, and is a
component's id only if the component has no other. An empty table gives an empty result. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.components import components
from keelson.llm.store import kept, kept_counted
from keelson.llm.text import LOWER, U64, Rolling, chunks, mix, tidy, words
from keelson.llm.winnow import keyed, parted

COUNT_BITS = 23
PART = 1 << 16
#: First shingles of a part, by hash, that meet in one task at a time; they are sent when a task has so many.
MEET, SEND = 1 << 18, 1 << 21
#: Buckets of the keys of documents that a scan wants: 8 MB of bits at most; when they are full, more documents are read.
DOC_BITS = 26


@dataclass(frozen=True)
class Similar:
    """Shingles of ``shingle`` words, linked when ``den * intersection >= num * union``."""

    shingle: int = 4
    num: int = 85
    den: int = 100
    #: Hundredths of a set by which its first shingles are more than the least number, for the first test.
    slack: int = 20
    #: Members from which a region is cut into rings.
    ring_from: int = 512
    #: Shingles of its members from which a group is joined by ``rounds`` over all tasks, and those sent to all in a round.
    group_shingles: int = 1 << 20
    round_shingles: int = 1 << 20
    #: Members of a group sent in the first round.
    sub_pivots: int = 16

    def overlap(self, n: int) -> int:
        """Least intersection of a set of ``n`` with a linked one; also the least size of that one."""
        return -(-self.num * n // self.den)

    def extra(self, n: int) -> int:
        return max(1, self.slack * n // 100)

    def tested(self, n: int) -> int:
        """How many first shingles are looked at in the first test."""
        return min(n, n - self.overlap(n) + self.extra(n))

    def least(self, n: int) -> int:
        """How many of them a linked set shares, whatever its size."""
        return min(self.extra(self.overlap(n)), self.overlap(n))

    def least_column(self, n: str) -> Column:
        """``least`` of a column."""
        over = f"({self.num} * {n} + {self.den - 1}) div {self.den}"
        return F.expr(f"least(greatest(1, {self.slack} * ({over}) div 100), {over})")

    def first(self, n: int) -> int:
        """How many first shingles name regions."""
        return min(n, n - self.overlap(n) + 1)

    def parts(self, shingles: int) -> int:
        """Into how many parts the first shingles of sets of ``shingles`` in all are dealt; a power of two."""
        sent = shingles * (100 * (self.den - self.num) + self.slack * self.den) // (100 * self.den)
        return 1 << min(16, max(6, (sent // MEET).bit_length()))


def sets(column: pa.Array, w: Similar) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted shingle hashes of each document of a string column."""
    for chunk in chunks(column):
        data = LOWER[chunk.data]
        found = words(data, chunk.offsets)
        roll = Rolling(found.hashes(data))
        whole = roll.windows(w.shingle)
        for k in range(chunk.high - chunk.low):
            low, high = int(found.first[k]), int(found.first[k + 1])
            if high - low >= w.shingle:
                yield chunk.low + k, np.unique(whole[low : high - w.shingle + 1])
            elif high > low:
                yield chunk.low + k, roll.spans(np.array([low]), np.array([high]))
            else:
                yield chunk.low + k, whole[:0]


def digest(found: np.ndarray) -> int:
    """A number for a set, in no order of its elements."""
    if not len(found):
        return 0
    parts = np.array([mix(found).sum(), np.bitwise_xor.reduce(mix(found ^ U64(0xA5A5A5A5A5A5A5A5))), len(found)], np.uint64)
    parts = mix(parts * np.array([3, 5, 7], np.uint64) + np.arange(3, dtype=np.uint64))
    return int(mix(np.array([parts.sum()])).view(np.int64)[0])


def narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold the largest."""
    return counts.astype(np.min_scalar_type(counts.max()))


def vertices(docs: DataFrame, w: Similar) -> tuple[DataFrame, np.ndarray]:
    """``k1``, ``k2``, ``vid`` and ``n`` of each document, and how many shingles fall into each of ``2**22`` buckets."""
    names = ["k1", "k2", "vid", "n", "part", "counts"]

    def scan(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            vid, n = [], []
            for _, found in sets(batch.column("text"), w):
                vid.append(digest(found))
                n.append(len(found))
                np.add.at(counts, (found & U64((1 << COUNT_BITS) - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(vid, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names
            )
        parts = [k for k in range(len(counts) // PART) if counts[k * PART : (k + 1) * PART].any()]
        none = pa.nulls(len(parts), pa.int64())
        packed = [zlib.compress(narrow(counts[k * PART : (k + 1) * PART]).tobytes(), 1) for k in parts]
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(packed)
                counts = np.frombuffer(raw, f"u{len(raw) // PART}")
                total[part] = total[part] + counts if part in total else counts.astype(np.uint64)
        # only the order of the counts matters: a few steps per doubling are enough
        packed = [zlib.compress(np.minimum(8 * np.log2(1 + c.astype(float)), 255).astype(np.uint8).tobytes(), 1) for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    scanned = kept(docs.select("text", "k1", "k2").mapInArrow(tidy(scan), "k1 long, k2 long, vid long, n long, part int, counts binary"), "sets")
    parts = scanned.where("part is not null").select("part", "counts").repartition("part").mapInArrow(tidy(add), "part int, counts binary")
    common = np.zeros(1 << COUNT_BITS, np.uint8)
    rows = parts.toArrow()
    for part, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        common[part * PART : (part + 1) * PART] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return scanned.where("part is null").select("k1", "k2", "vid", "n"), common


def first_shingles(found: np.ndarray, common: np.ndarray, w: Similar) -> np.ndarray:
    """The rarest shingles of a set, rarest first, ties by hash."""
    order = np.argsort(common[(found & U64((1 << COUNT_BITS) - 1)).astype(np.int64)], kind="stable")
    return found[order[: w.tested(len(found))]]


def one_document(found: DataFrame) -> tuple[DataFrame, int]:
    """``vid``, ``n`` and the key (``k1``, ``k2``) of one document of each vertex, from ``vertices``; and all their shingles."""
    one = found.where("n > 0").groupBy("vid").agg(F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("one"))
    one, seen = kept_counted(one.select("vid", "n", "one.k1", "one.k2"), "one", shingles=F.sum("n"))
    return one, seen["shingles"]


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``text`` of the documents with one of the keys (``k1``, ``k2``), and of a few others."""
    return parted(docs.select("text", "k1", "k2"), keys, DOC_BITS, F.xxhash64("k1", "k2"))[0].select("text")


def _cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of numbers between ``cuts`` as binary cells."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def meeting(code: np.ndarray, vid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of one part (the hash and, in the lowest bit, whether it names a region; and the vertex), those hashes that
    two vertices hold: vertex, hash, how many entries these two have, and whether one of them names a region."""
    order = np.argsort(code >> 1, kind="stable")
    cell = code[order] >> 1
    same = cell[1:] == cell[:-1]
    # most hashes occur once
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]
    order = order[np.lexsort((vid[order], code[order] >> 1))]
    code, vid = code[order], vid[order]
    cell = code >> 1
    first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (vid[1:] != vid[:-1])][: len(cell)])
    if not len(first):
        return vid, cell, cell, cell > 0
    places, route = np.diff(np.append(first, len(cell))), np.maximum.reduceat(code & 1, first) > 0
    vid, cell = vid[first], cell[first]
    group = np.cumsum(np.r_[True, cell[1:] != cell[:-1]]) - 1
    two = np.bincount(group)[group] > 1
    return vid[two], cell[two], places[two], route[two]


def near(docs: DataFrame, w: Similar, common: np.ndarray, one: DataFrame, shingles: int) -> DataFrame:
    """``vid``, ``n``, ``k1``, ``k2`` and ``cells`` (hashes of the first shingles other vertices hold) of the vertices that may have
    links. ``one`` and ``shingles`` are those of ``one_document``."""
    common = docs.sparkSession.sparkContext.broadcast(common)
    parts = w.parts(shingles)

    def send(batches):
        def flush():
            first, which = np.concatenate(hashes), np.repeat(np.array(vids, np.int64), sizes)
            part = ((first >> U64(24)) & U64(parts - 1)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            there, cuts = np.unique(part[order], return_index=True)
            cuts = np.append(cuts, len(order))
            code = ((first >> U64(32)) & U64(0xFFFFFFFE)).astype(np.uint32) | np.concatenate(routes)
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), _cells(code[order], cuts), _cells(which[order], cuts)], ["part", "codes", "vids"])

        known: set[int] = set()
        hashes, vids, sizes, routes, size = [], [], [], [], 0
        for batch in batches:
            for _, found in sets(batch.column(0), w):
                if not len(found) or (name := digest(found)) in known:
                    continue
                known.add(name)
                hashes.append(first_shingles(found, common.value, w))
                vids.append(name)
                sizes.append(len(hashes[-1]))
                routes.append((np.arange(sizes[-1]) < w.first(len(found))).astype(np.uint32))
                size += sizes[-1]
                if size > SEND:
                    yield flush()
                    hashes, vids, sizes, routes, size = [], [], [], [], 0
        if size:
            yield flush()

    def meet(batches):
        part, codes, vids = None, [], []

        def close():
            vid, cell, places, route = meeting(np.concatenate(codes), np.concatenate(vids))
            cell = cell.astype(np.int64) | part << 31
            return pa.RecordBatch.from_arrays([pa.array(vid), pa.array(cell), pa.array(places.astype(np.int32)), pa.array(route)], ["vid", "cell", "places", "route"])

        for batch in batches:
            for row, next_ in enumerate(batch.column(0).to_pylist()):
                if next_ != part:
                    if codes:
                        yield close()
                    part, codes, vids = next_, [], []
                codes.append(np.frombuffer(batch.column(1)[row].as_py(), np.uint32))
                vids.append(np.frombuffer(batch.column(2)[row].as_py(), np.int64))
        if codes:
            yield close()

    sent = texts_of(docs, one).mapInArrow(tidy(send), "part int, codes binary, vids binary")
    met = sent.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(meet), "vid long, cell long, places int, route boolean")
    held = met.groupBy("vid").agg(F.sum("places").alias("shared"), F.collect_list(F.when(F.col("route"), F.col("cell"))).alias("cells"))
    held = held.join(one, "vid").where((F.col("shared") >= w.least_column("n")) & (F.size("cells") > 0))
    return kept(held.select("vid", "n", "k1", "k2", "cells"), "near")


def regions(held: DataFrame) -> DataFrame:
    """``pivot``, ``vid`` and ``n`` of the members of every region, from ``near``."""
    cells = held.select(F.explode("cells").alias("cell"), "vid", "n")
    pivots = cells.groupBy("cell").agg(F.min("vid").alias("pivot"), F.max("vid").alias("other")).where("pivot < other").select("cell", "pivot")
    return kept(cells.join(pivots, "cell").select("pivot", "vid", "n").distinct(), "regions")


def whole_sets(docs: DataFrame, held: DataFrame, members: DataFrame, w: Similar) -> DataFrame:
    """``vid`` and ``hashes`` of the members of regions."""

    def send(batches):
        known: set[int] = set()
        for batch in batches:
            vid, whole, size = [], [], 0
            for _, found in sets(batch.column(0), w):
                if len(found) and (name := digest(found)) not in known:
                    known.add(name)
                    vid.append(name)
                    whole.append(found.tobytes())
                    size += len(found)
                    if size > 1 << 20:
                        yield rows(vid, whole)
                        vid, whole, size = [], [], 0
            if vid:
                yield rows(vid, whole)

    def rows(vid, whole):
        return pa.RecordBatch.from_arrays([pa.array(vid, pa.int64()), pa.array(whole, pa.binary())], ["vid", "hashes"])

    wanted = held.join(members.select("vid").distinct(), "vid", "left_semi")
    return texts_of(docs, wanted.select("k1", "k2")).mapInArrow(tidy(send), "vid long, hashes binary").dropDuplicates(["vid"])


def _shared(all_: np.ndarray, starts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Size of the intersection of ``one`` with each set of a run of non-empty sets."""
    at = np.searchsorted(one, all_)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == all_).astype(np.int64), starts)


def join_region(members: list[np.ndarray], w: Similar) -> list[tuple[int, int]]:
    """Links that span the components of some sets."""
    size = np.array([len(m) for m in members])
    radius = 1 - w.num / w.den
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j))

    def against(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether ``i`` links with each of ``others``, and its distance to them."""
        starts = np.append(0, np.cumsum(size[others])[:-1])
        common = _shared(np.concatenate([members[k] for k in others]), starts, members[i])
        union = size[others] + size[i] - common
        return w.den * common >= w.num * union, 1 - common / union

    left = np.argsort(size, kind="stable")
    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        # beyond this size the distance exceeds 2 r
        reach = len(left) if 2 * radius >= 1 else int(np.searchsorted(size[left], size[pivot] / (1 - 2 * radius) * (1 + 1e-9), "right"))
        if not reach:
            continue
        around = left[:reach]
        linked, distance = against(pivot, around)
        ball, ball_distance = around[linked], distance[linked]
        for i in ball.tolist():
            link(pivot, i)
        rest = ~linked
        for i, d in zip(around[rest].tolist(), distance[rest].tolist()):
            if d > 2 * radius + 1e-9 or not len(ball):
                continue
            window = ball[ball_distance >= d - radius - 1e-9]
            for low in range(0, len(window), 64):
                if root(i) == root(pivot):
                    break
                some = window[low : low + 64]
                hit = some[against(i, some)[0]]
                if len(hit):
                    link(int(hit[0]), i)
        left = np.concatenate([around[rest], left[reach:]])
    return out


class Block:
    """Sets that others are compared with all at once."""

    def __init__(self, vids: list[int], sets_: list[np.ndarray]):
        self.vids, self.size = np.array(vids, np.int64), np.array([len(s) for s in sets_], np.int64)
        all_ = np.concatenate(sets_)
        order = np.argsort(all_, kind="stable")
        self.owner = np.repeat(np.arange(len(sets_)), self.size)[order]
        self.keys, first = np.unique(all_[order], return_index=True)
        self.cuts = np.append(first, len(all_))

    def linked(self, one: np.ndarray, w: Similar) -> np.ndarray:
        """Places of the sets that link with ``one``."""
        at = np.searchsorted(self.keys, one)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == one]
        n = self.cuts[at + 1] - self.cuts[at]
        holders = np.repeat(self.cuts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[holders], minlength=len(self.size))
        return np.flatnonzero((common > 0) & (w.den * common >= w.num * (self.size + len(one) - common)))


def rounds(rows: DataFrame, edges: DataFrame, w: Similar) -> DataFrame:
    """``edges`` and those that join the components of the groups of ``rows`` (``pivot``, ``ring``, ``vid``, ``n``, ``hashes``).

    In each round a bounded number of members of each group goes to all tasks, and every member is compared with those of
    its group. A pair is left out only if its two ends are known to be in one component: members that have had their round, or
    are in the component that holds most of their group, are not sent. It ends when no group has others.
    """
    spark = rows.sparkSession
    ids = kept(rows.select("pivot", "ring", "vid", "n"), "members")
    sent: DataFrame | None = None
    width = w.sub_pivots
    while True:
        named = ids.join(components(edges).withColumnRenamed("id", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
        named = kept(named, "named")
        parts = named.groupBy("pivot", "ring", "root").agg(F.count(F.lit(1)).alias("members"))
        most = parts.groupBy("pivot", "ring").agg(F.max(F.struct("members", "root"))["root"].alias("most"))
        left = named.join(most, ["pivot", "ring"]).where("root <> most")
        if sent is not None:
            left = left.join(sent, ["pivot", "ring", "vid"], "left_anti")
        left, seen = kept_counted(left.select("pivot", "ring", "vid", "n"), "left", n=F.count(F.lit(1)), shingles=F.sum("n"))
        if not seen["n"]:
            return edges
        groups = left.select("pivot", "ring").distinct().count()
        # as many as the bytes of a round allow, few at first: most members are near one of them
        salt = max(1, min(width, w.round_shingles * seen["n"] // (seen["shingles"] * groups)))
        width *= 8
        turn = F.xxhash64("vid", F.lit(width))
        some = left.groupBy("pivot", "ring", F.pmod(turn, F.lit(salt)).alias("salt")).agg(F.min(F.struct(turn.alias("turn"), "vid"))["vid"].alias("vid"))
        some = kept(some.select("pivot", "ring", "vid"), "sent")
        sent = some if sent is None else sent.union(some)
        chosen = rows.join(some, ["pivot", "ring", "vid"], "left_semi").select("pivot", "ring", "vid", "hashes").toArrow()
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for pivot, ring, vid, found in zip(*(chosen.column(k).to_pylist() for k in range(4))):
            vids, sets_ = held.setdefault((pivot, ring), ([], []))
            vids.append(vid)
            sets_.append(np.frombuffer(found, np.uint64))
        blocks = spark.sparkContext.broadcast({key: Block(*have) for key, have in held.items()})

        def compare(batches, blocks=blocks):
            same: dict[int, int] = {}

            def root(v: int) -> int:
                while same.setdefault(v, v) != v:
                    same[v] = v = same[same[v]]
                return v

            for batch in batches:
                a, b = [], []
                for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    block = blocks.value.get(key)
                    if block is None:
                        continue
                    vid = batch.column(2)[row].as_py()
                    near_ = [v for v in block.vids[block.linked(np.frombuffer(batch.column(3)[row].as_buffer(), np.uint64), w)].tolist() if v != vid]
                    # one edge for the member, and those between sets sent that the task has not joined yet
                    for k, v in enumerate(near_):
                        if k and root(v) == root(near_[0]):
                            continue
                        if k:
                            same[root(v)] = root(near_[0])
                        a.append(vid)
                        b.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        got = rows.select("pivot", "ring", "vid", "hashes").mapInArrow(tidy(compare), "a long, b long")
        edges = kept(edges.union(got).distinct(), "edges")
        blocks.unpersist()


def links(wanted: DataFrame, members: DataFrame, w: Similar) -> DataFrame:
    """``a``, ``b``: links between vertices that span every component of every region. ``wanted`` are the ``whole_sets``."""
    wide = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > w.ring_from).select("pivot", F.lit(True).alias("wide"))
    ring = F.floor(F.log(F.col("n").cast("double")) / math.log(w.den / w.num) + F.lit(1e-9)).cast("int") if w.num < w.den else F.col("n").cast("int")
    dealt = members.join(wide, "pivot", "left").select(
        "pivot", "vid", "n", F.explode(F.when(F.col("wide"), F.array(ring, ring + 1)).otherwise(F.array(F.lit(-1)))).alias("ring")
    )
    dealt = kept(dealt, "dealt")
    large = dealt.groupBy("pivot", "ring").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > w.group_shingles).select("pivot", "ring")
    large, seen = kept_counted(large, "large", n=F.count(F.lit(1)))
    if seen["n"]:
        wanted = kept(wanted, "wanted")
        big = kept(dealt.join(large, ["pivot", "ring"], "left_semi").join(wanted, "vid").select("pivot", "ring", "vid", "n", "hashes"), "big")
        dealt = dealt.join(large, ["pivot", "ring"], "left_anti")
    rows = dealt.join(wanted, "vid").select("pivot", "ring", "vid", "hashes")

    def join(batches):
        key, vids, held = None, [], []

        def close():
            got = join_region([np.frombuffer(h, np.uint64) for h in held], w)
            return pa.RecordBatch.from_arrays([pa.array([vids[p[k]] for p in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row, (pivot, ring, vid) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if (pivot, ring) != key:
                    if len(vids) > 1:
                        yield close()
                    key, vids, held = (pivot, ring), [], []
                vids.append(vid)
                held.append(batch.column(3)[row].as_py())
        if len(vids) > 1:
            yield close()

    dealt_out = rows.repartition("pivot", "ring").sortWithinPartitions("pivot", "ring")
    edges = dealt_out.mapInArrow(tidy(join), "a long, b long")
    return rounds(big, kept(edges, "links"), w) if seen["n"] else edges


def similar(docs: DataFrame, w: Similar = Similar()) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (see ``keyed``), ``n_shingles``, ``root`` (the component, null for empty sets) and
    ``component_id`` of every document."""
    rows = keyed(docs)
    found, common = vertices(rows, w)
    one, shingles = one_document(found)
    held = near(rows, w, common, one, shingles)
    members = regions(held)
    edges = links(whole_sets(rows, held, members, w), members, w)
    roots = kept(components(edges), "roots")
    # an empty set is a vertex of its own for every document
    named = rows.select("doc_id", "k1", "k2").join(found.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    named = named.join(roots.withColumnRenamed("id", "vid"), "vid", "left")
    named = named.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.coalesce("root", "vid")).alias("root"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, w: Similar) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: one of each component, of least ``doc_id``; and all rows
    without words."""
    named = kept(similar(docs, w).where("root is not null").select("doc_id", "k1", "k2", "root"), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2"))
    chosen = kept(named.groupBy("root").agg(first.alias("one")).select("one.k1", "one.k2"), "chosen")
    again = named.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k1", "k2")
    asked = kept(named.select("k1", "k2").join(chosen, ["k1", "k2"], "left_anti").union(again), "asked")
    rows = keyed(docs, carry=True).select("row", "k1", "k2", "text")
    wordless = F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == ""
    # only rows that may go, or come again, are shuffled
    there, other = parted(rows.where(~wordless), asked, DOC_BITS, F.xxhash64("k1", "k2"))
    stays = there.join(chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return stays.select("row.*").union(other.select("row.*")).union(rows.where(wordless).select("row.*"))
