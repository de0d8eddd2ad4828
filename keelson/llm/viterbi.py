"""Subword encoding and decoding with a sentencepiece vocabulary: best segmentation by max-plus algebra, in parallel.

The encoding of a text is the segmentation into pieces with the greatest sum of piece scores. A space is the mark ``▁``, one
mark is put before the text, and a character outside the vocabulary costs ten less than the worst piece and becomes byte
pieces. Paths are compared by 64-bit integers: the vocabulary's score times 2**20 plus a number below 2**12 made from the piece, so
that sums are exact and equal scores are told apart the same way everywhere. In a unit (below) of 256 pieces these numbers
sum to less than one point of score. The score handed on is the sum of the vocabulary's scores alone.

A long text is cut into chunks of ``chunk_chars``. A piece belongs to the chunk it starts in and can reach at most
``longest - 1`` characters into the next, which is the state at a border.

1. ``transfers``: each chunk gives its matrix, the best score from each state at its begin to each state at its end.
2. ``borders``: per text, max-plus products of the matrices from the right give the best rest from every state; going from
   the left, the best state at each border follows. Only matrices meet, one per chunk, never the text.
3. ``encode``: with its two states known, each chunk is backtraced by itself.

Pieces never hold a mark after another character, and never a line break, so a text falls into units that are segmented
apart and remembered. Inside a chunk only what lies before the first and behind the last unit border depends on the states.

A null or empty text has no pieces. Repeated rows are encoded once each. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.lattice import MARK, vocabulary
from keelson.llm.store import kept
from keelson.llm.text import tidy
from keelson.llm.tokens import WordIds

STEP = 1 << 20
#: Tie parts are below this.
TIE = 1 << 12
NEVER = -(1 << 62)
UNSCORED = -1e8
UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Units up to this length are searched many at a time, of so many characters together.
TOGETHER, TOGETHER_CHARS = 64, 1 << 17
#: Texts of so many characters meet their units together.
GROUP_CHARS = 1 << 16
#: Units a worker remembers; learning some anew costs little.
UNITS_KEPT = 300_000


class Best(WordIds):
    """Best segmentations of units, remembered."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        model = self.vocab.model
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.vocab.id):
            raise ValueError("a piece of this vocabulary reaches over a unit border")
        self.longest = self.vocab.longest
        # the file marks pieces that are not for scoring (runs of marks) with a score far below all others
        plain = {p: round(model.get_score(i)) for p, i in self.vocab.id.items() if model.get_score(i) > UNSCORED}
        self.score = {p: s * STEP + zlib.crc32(p.encode()) % TIE for p, s in plain.items()}
        #: Beginnings of pieces: a search ends where none goes on.
        self.begins = {p[:n] for p in plain for n in range(1, len(p))}
        worst = min(plain.values())
        self.unknown = (worst - 10) * STEP
        #: Characters that have an id, if only an unscored one; a unit of these never needs byte pieces.
        self.single = {p for p in self.vocab.id if len(p) == 1}
        # the same beginnings as a tree for whole arrays: node 0 is the root, an edge is a node and the next character; in this
        # order of nodes the edges ascend
        gain = {p: self.unknown for p in self.single} | {p: s * STEP for p, s in plain.items()}
        nodes = {p: n for n, p in enumerate(sorted(self.begins | set(gain), key=lambda p: (len(p), p)), 1)}
        self.edge = np.array([*(nodes.get(p[:-1], 0) << 21 | ord(p[-1]) for p in nodes), 1 << 62])
        self.gain = np.array([NEVER, *(gain.get(p, NEVER) for p in nodes)])
        self.own = np.array([0, *(self.score.get(p, 0) & (TIE - 1) for p in nodes)])
        self.piece = np.array([0, *(self.vocab.id.get(p, 0) for p in nodes)], np.uint32)
        #: Per id: its score (an unknown character's is on its first byte piece), and the bytes it stands for.
        pieces: list[bytes] = [b""] * self.vocab.size
        for p, i in self.vocab.id.items():
            pieces[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.vocab.byte):
            pieces[i] = bytes([b])
        #: An unknown character's score is on its first byte; the other bytes of a character are 0x80 to 0xBF.
        self.points = np.full(self.vocab.size, worst - 10, np.int64)
        self.points[[self.vocab.byte[b] for b in range(0x80, 0xC0)]] = 0
        for p, score in plain.items():
            self.points[self.vocab.id[p]] = score
        self.width = np.array([len(p) for p in pieces], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        super().__init__()

    def forward(self, text: str, low: int, high: int, over: int, place: list[int]) -> tuple[list[int], list[int]]:
        """Best score from ``low`` to each place up to ``high + over``, by pieces that start before ``high``; and where the
        last piece of it starts. Results count from ``low``; ``place`` has each character's place in its unit."""
        end = min(len(text), high + over)
        best, last = [NEVER] * (end - low + 1), [-1] * (end - low + 1)
        best[0] = 0
        get, begins, longest = self.score.get, self.begins, self.longest
        for i in range(low, high):
            here = best[i - low]
            if here == NEVER:
                continue
            odd = 2 * place[i] + 1
            for j in range(i + 1, min(end, i + longest) + 1):
                piece = text[i:j]
                s = get(piece)
                if s is None:
                    if j > i + 1:
                        if piece in begins:
                            continue
                        break
                    s = self.unknown
                own = s & (TIE - 1)
                s += here - own + (own * odd & (TIE - 1))
                if s > best[j - low]:
                    best[j - low], last[j - low] = s, i - low
        return best, last

    def segment(self, text: str, place: list[int] | range) -> list[int]:
        """Ids of the best segmentation of ``text``, marks for spaces."""
        best, last = self.forward(text, 0, len(text), 0, place)
        ids: list[int] = []
        at = len(text)
        while at:
            piece = text[last[at] : at]
            known = self.vocab.id.get(piece)
            ids += [known] if known is not None else [self.vocab.byte[b] for b in reversed(piece.encode())]
            at = last[at]
        return ids[::-1]

    def ids_of(self, word: bytes) -> list[int]:
        text = word.decode()
        return self.segment(text, range(len(text)))

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``segment`` gives for each of some units of ``single`` characters: all ids, and how many each unit has.

        Units lie one behind another with a zero between. Places are taken by their distance from the unit's begin, for all
        units at once.
        """
        flat = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size + 1) - size - 1
        odd = 2 * (np.arange(len(flat)) - np.repeat(begin, size + 1)) + 1
        # by length less one and end: the score of the piece, and its id
        gain = np.full((self.longest, len(flat)), NEVER)
        piece = np.zeros((self.longest, len(flat)), np.uint32)
        at, node = np.arange(len(flat)), np.zeros(len(flat), np.int64)
        for n in range(self.longest):
            edge = node << 21 | flat[at + n]
            node = np.searchsorted(self.edge, edge)
            on = self.edge[node] == edge
            at, node = at[on], node[on] + 1
            gain[n, at + n + 1] = self.gain[node] + (self.own[node] * odd[at] & (TIE - 1))
            piece[n, at + n + 1] = self.piece[node]
        best, back = np.full(len(flat), NEVER), np.zeros(len(flat), np.int64)
        best[begin] = 0
        order = np.argsort(-size, kind="stable")
        reach = np.searchsorted(-size[order], -np.arange(size.max() + 1), side="right")
        for j in range(1, len(reach)):
            to = begin[order[: reach[j]]] + j
            # longest first: of equal scores the one from the earliest begin stays, as in ``forward``
            n = np.arange(min(j, self.longest), 0, -1)[:, None]
            score = best[to - n] + gain[n - 1, to]
            pick = score.argmax(axis=0)
            best[to], back[to] = score[pick, np.arange(len(to))], n[pick, 0]
        found, used = np.zeros(len(flat), np.uint32), np.zeros(len(flat), bool)
        low, at = begin, begin + size
        while len(at):
            n = back[at]
            found[at - n], used[at - n] = piece[n - 1, at], True
            at = at - n
            on = at > low
            low, at = low[on], at[on]
        return found[used], np.add.reduceat(used.astype(np.int64), begin)

    def learn_all(self, units: list[str]) -> None:
        """Remember the segmentations of units not met before."""
        for low in range(0, len(units), TOGETHER_CHARS // TOGETHER):
            some = units[low : low + TOGETHER_CHARS // TOGETHER]
            ids, count = self.together(some)
            first, end = len(self.code), self.size + len(ids)
            while first + len(some) + 1 > len(self.start):
                self.start = np.resize(self.start, 2 * len(self.start))
            while end > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.code.update(zip(map(str.encode, some), range(first, first + len(some))))
            self.flat[self.size : end] = ids
            self.start[first : first + len(some) + 1] = self.size + np.append(0, np.cumsum(count))
            self.size = end

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = {u for u in found if u not in self.code}
        if len(self.code) + len(new) > UNITS_KEPT:
            self.clear()
            new = set(found)
        some = [u for u in map(bytes.decode, new) if len(u) <= TOGETHER and self.single.issuperset(u)]
        self.learn_all(some)
        return super().encode(found)

    def many(self, texts: list[str]):
        """The ids of each text; begins and ends are unit borders."""
        found: list[str] = []
        cuts, held = [0], 0
        for k, text in enumerate(texts, 1):
            found += UNIT.findall(text)
            cuts.append(len(found))
            held += len(text)
            if held > GROUP_CHARS or k == len(texts):
                ids, count = self.encode([u.encode() for u in found])
                ends = np.append(0, np.cumsum(count))[cuts]
                yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:]))
                found, cuts, held = [], [0], 0

    def units(self, text: str) -> np.ndarray:
        """Ids of a text whose begin and end are unit borders."""
        return self.encode([u.encode() for u in UNIT.findall(text)])[0]

    def total(self, ids: np.ndarray) -> int:
        """The sum of the vocabulary's scores."""
        return int(self.points[ids].sum())

    def matrix(self, text: str, size: int, origin: int) -> np.ndarray:
        """Best scores from each state at the begin to each state at the end of the first ``size`` characters; ``text`` goes
        on with what a piece can reach, and begins ``origin`` characters into a unit."""
        k, states = self.longest, min(self.longest, len(text) - size + 1)
        out = np.full((k, k), NEVER, np.int64)
        place = places(text, origin)
        cuts = [m.start() for m in UNIT.finditer(text) if k <= m.start() <= size]
        if not cuts:
            for a in range(min(k, size + 1)):
                best, _ = self.forward(text, a, size, k - 1, place)
                for b in range(states):
                    if 0 <= size + b - a < len(best):
                        out[a, b] = best[size + b - a]
            for a in range(size, k):  # the text before reaches over the whole chunk
                if a - size < states:
                    out[a, a - size] = 0
            return out
        low, high = cuts[0], cuts[-1]
        # the same for all states, so its tie parts decide nothing
        middle = self.total(self.units(text[low:high])) * STEP
        tail, _ = self.forward(text, high, size, k - 1, place)
        for a in range(k):
            head = self.forward(text, a, low, 0, place)[0][low - a]
            if head != NEVER:
                for b in range(states):
                    if size + b - high < len(tail) and tail[size + b - high] != NEVER:
                        out[a, b] = head + middle + tail[size + b - high]
        return out

    def between(self, text: str, low: int, high: int, origin: int) -> np.ndarray:
        """Ids of the best segmentation of ``text[low:high]``, borders anywhere."""
        place = places(text, origin)
        cuts = [m.start() for m in UNIT.finditer(text) if low < m.start() < high]
        if not cuts:
            return np.array(self.segment(text[low:high], place[low:high]), np.uint32)
        first, last = cuts[0], cuts[-1]
        head, tail = (np.array(self.segment(text[x:y], place[x:y]), np.uint32) for x, y in ((low, first), (last, high)))
        return np.concatenate([head, self.units(text[first:last]), tail])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some pieces, marks as spaces."""
        width, place = self.width[ids], self.place[ids]
        before = np.cumsum(width) - width
        return self.bytes[np.repeat(place - before, width) + np.arange(int(width.sum()))].tobytes()


def places(text: str, origin: int) -> list[int]:
    """Each character's place in its unit; the first unit began ``origin`` characters before ``text``."""
    out: list[int] = []
    for m in UNIT.finditer(text):
        begin = origin if m.start() == 0 else 0
        out += range(begin, begin + m.end() - m.start())
    return out


def unit_begin(text: str, at: int) -> int:
    """Where the unit that holds place ``at`` begins."""
    if text[at] == "\n":
        return at
    if text[at] != MARK:
        at = max(text.rfind(MARK, 0, at), text.rfind("\n", 0, at)) + 1
    while at and text[at - 1] == MARK:
        at -= 1
    return at


_loaded: dict[str, Best] = {}


def segmenter(path: str) -> Best:
    if path not in _loaded:
        _loaded[path] = Best(path)
    return _loaded[path]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def chunked(docs: DataFrame, chunk_chars: int, longest: int) -> DataFrame:
    """``pid``, ``row`` (a document), ``part``, ``parts``, ``size``, ``origin`` and ``text`` of each chunk, marks for spaces."""

    def cut(batches):
        pid, row = TaskContext.get().partitionId(), 0
        names = ["pid", "row", "doc_id", "part", "parts", "size", "origin", "text"]
        for batch in batches:
            out, held = [], 0
            for at, text in enumerate(batch.column(1).to_pylist()):
                text = MARK + text.replace(" ", MARK) if text else ""
                parts = max(1, -(-len(text) // chunk_chars))
                for part in range(parts):
                    low = part * chunk_chars
                    size = min(chunk_chars, len(text) - low)
                    origin = low - unit_begin(text, low) if low else 0
                    out.append((row, at, part, parts, size, origin, text[low : low + size + longest - 1]))
                row += 1
                held += len(text)
                if held > 1 << 22:
                    yield batch_of(out, pid, batch.column(0), names)
                    out, held = [], 0
            if out:
                yield batch_of(out, pid, batch.column(0), names)

    def batch_of(out, pid, doc_ids, names):
        row, at, part, parts, size, origin, text = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(row), pa.int64()), pa.array(row, pa.int64()), doc_ids.take(pa.array(at)), pa.array(part, pa.int32()),
             pa.array(parts, pa.int32()), pa.array(size, pa.int64()), pa.array(origin, pa.int64()), pa.array(text, pa.string())], names
        )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(cut), f"pid long, row long, doc_id {kind}, part int, parts int, size long, origin long, text string")


def transfers(chunks: DataFrame, path: str) -> DataFrame:
    """The matrix of each chunk of the texts that have several."""

    def make(batches):
        best = segmenter(path)
        for batch in batches:
            got = [best.matrix(t, n, o).tobytes() for t, n, o in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "origin")))]
            yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("row"), batch.column("part"), pa.array(got, pa.binary())], ["pid", "row", "part", "matrix"])

    return chunks.where("parts > 1").select("pid", "row", "part", "size", "origin", "text").mapInArrow(tidy(make), "pid long, row long, part int, matrix binary")


def borders(matrices: DataFrame, longest: int) -> DataFrame:
    """``enter`` and ``leave``: the states of the best path at the borders of each chunk."""

    def scan(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        order = np.argsort(part)
        raw = table.column("matrix").to_pylist()
        found = [np.frombuffer(raw[k], np.int64).reshape(longest, longest) for k in order]
        rest = np.full((longest, 1), NEVER, np.int64)
        rest[0] = 0
        behind = [rest]
        for m in reversed(found):
            rest = product(m, rest)
            behind.append(rest)
        behind = behind[::-1]
        states = [0]
        for k, m in enumerate(found):
            total = m[states[-1]] + behind[k + 1][:, 0]
            states.append(int(total.argmax()))
        n = len(order)
        return pa.table(
            {"pid": table.column("pid").slice(0, n), "row": table.column("row").slice(0, n), "part": pa.array(part[order]),
             "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())}
        )

    return matrices.groupBy("pid", "row").applyInArrow(scan, "pid long, row long, part int, enter int, leave int")


def encode_apart(docs: DataFrame, path: str, chunk_chars: int = 32_768) -> tuple[DataFrame, DataFrame]:
    """``pid``, ``row``, ``doc_id``, ``part``, ``parts``, ``ids`` (little-endian 32 bits) and ``score`` of each chunk: of the
    texts that are one chunk, and of the longer ones."""
    longest = vocabulary(path).longest
    size = F.length(F.coalesce("text", F.lit("")))
    # with the mark before it, a text of chunk_chars characters has two chunks
    short = chunked(docs.where(size < chunk_chars), chunk_chars, longest)
    # few rows with much work each: dealt out by a number, or small files would be one task
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = kept(chunked(docs.where(size >= chunk_chars), chunk_chars, longest), "chunks").repartition(tasks, "pid", "row", "part")
    states = borders(transfers(long, path), longest)

    def segment(batches):
        best = segmenter(path)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "size", "origin", "enter", "leave"))))
            apart = [bool(origin or enter or leave or size < len(text)) for text, size, origin, enter, leave in rows]
            alone = best.many([r[0] for r, cut in zip(rows, apart) if not cut])
            ids, score = [], []
            for (text, size, origin, enter, leave), cut in zip(rows, apart):
                own = best.between(text, enter, size + leave, origin) if cut else next(alone)
                ids.append(own.tobytes())
                score.append(best.total(own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("pid", "row", "doc_id", "part", "parts")), pa.array(ids, pa.binary()), pa.array(score, pa.int64())],
                ["pid", "row", "doc_id", "part", "parts", "ids", "score"],
            )

    columns = ["pid", "row", "doc_id", "part", "parts", "size", "origin", "text", "enter", "leave"]
    zero = F.lit(0).cast("int")
    short = short.select("*", zero.alias("enter"), zero.alias("leave")).select(*columns)
    schema = f"pid long, row long, doc_id {dict(docs.dtypes)['doc_id']}, part int, parts int, ids binary, score long"
    # short texts are not joined with anything
    return short.mapInArrow(tidy(segment), schema), long.join(states, ["pid", "row", "part"]).select(*columns).mapInArrow(tidy(segment), schema)


def encode(docs: DataFrame, path: str, chunk_chars: int = 32_768) -> DataFrame:
    """Both tables of ``encode_apart``; ``pid`` and ``row`` tell documents apart where ``parts`` is above 1."""
    short, long = encode_apart(docs, path, chunk_chars)
    return short.union(long)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of each chunk; the mark put before the text is taken off the first."""

    def turn(batches):
        best = segmenter(path)
        at = columns.index("ids")
        first = columns.index("part")
        for batch in batches:
            got = [best.decode(np.frombuffer(i, np.uint32))[0 if p else 1 :] for i, p in zip(batch.column(at).to_pylist(), batch.column(first).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*columns, "decoded"])

    columns = encoded.columns
    return encoded.mapInArrow(tidy(turn), ", ".join(f"{c} {t}" for c, t in encoded.dtypes) + ", decoded binary")


def whole(short: DataFrame, long: DataFrame) -> DataFrame:
    """One row per document from the two decoded tables: ``doc_id``, ``ids``, ``score`` and ``text``."""
    one = short.select("doc_id", "ids", "score", F.col("decoded").cast("string").alias("text"))
    order = F.sort_array(F.collect_list(F.struct("part", "ids", "decoded")))
    many = long.groupBy("pid", "row").agg(F.first("doc_id").alias("doc_id"), order.alias("c"), F.sum("score").alias("score"))
    join = lambda name: F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x[name]))
    return one.union(many.select("doc_id", join("ids").alias("ids"), "score", join("decoded").cast("string").alias("text")))
