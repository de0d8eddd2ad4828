import random
import uuid
from collections import Counter

import numpy as np
from cases import documents, texts, words
from pyspark.sql import functions as F

from keelson.llm import winnow
from keelson.llm.substrings import automaton_ranges, repeated_substrings
from keelson.llm.suffixes import repeated_bytes, suffix_array, suffix_ranges
from keelson.llm.winnow import Windows, document_spans, keyed, matched, parted, segments


def gone(sequences, size):
    """Which items lie in a window that starts in two places."""
    count = Counter(tuple(s[i : i + size]) for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - size + 1):
            if count[tuple(s[i : i + size])] > 1:
                mask[i : i + size] = [True] * size
        out.append(mask)
    return out


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(200):
        s = np.array([rnd.randint(1, rnd.choice([1, 2, 4, 1 << 40])) for _ in range(rnd.randint(0, 50))], np.int64)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_ranges_in_a_shard():
    rnd = random.Random(2)
    for _ in range(100):
        bodies = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(5)})
        weights = [rnd.choice([1, 1, 2]) for _ in bodies]
        copies = [b for b, w in zip(bodies, weights) for _ in range(w)]
        want = dict(zip(copies, gone(copies, 9)))
        for found in (suffix_ranges(9)(bodies, weights), automaton_ranges(9)([b" ".join(bytes([c]) for c in b) for b in bodies], weights)):
            for body, spans in zip(bodies, found):
                mask = [False] * len(body)
                for a, b in spans:
                    mask[a:b] = [True] * (b - a)
                assert mask == want[body]


def check_words(spark, w):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    masks = gone([words(t) for _, t in rows], w.size)
    want = Counter((i, len(m), sum(m), b" ".join(x for x, g in zip(words(t), m) if not g).decode()) for (i, t), m in zip(rows, masks))
    got = repeated_substrings(docs, w).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == want


def test_words(spark):
    check_words(spark, Windows("words", 6, 2, 16, 16, 300))


def test_words_with_full_bitmaps(spark):
    check_words(spark, Windows("words", 5, 1, 16, 0, 50))


def test_text_keeps_its_white_space(spark):
    rows = [(1, "a b  c\n d e f g\nend"), (2, "x b c d e f y"), (3, None), (4, "q\t r")]
    out = repeated_substrings(documents(spark, rows), Windows("words", 5, 2, 16, 16), separator=None, carry=True)
    got = {r["doc_id"]: (r["kept_text"], r["row"]["text"], r["row"]["vid"]) for r in out.collect()}
    assert got == {1: ("a g\nend", rows[0][1], "h"), 2: ("x y", rows[1][1], "h"), 3: ("", None, "h"), 4: ("q\t r", "q\t r", "h")}


def test_bytes(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    masks = gone([b for _, b in rows], 30)
    want = Counter(
        (i, len(b), bytes(c for c, g in zip(b, m) if not g), sum(x and not y for x, y in zip(m, [False, *m]))) for (i, b), m in zip(rows, masks)
    )
    got = repeated_bytes(docs, Windows("bytes", 30, 6, 16, 0, 400)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got) == want


def test_hot_anchor_is_dealt_out(spark, tmp_path, monkeypatch):
    """A line shorter than a window in every document, between different text; some windows over it are repeated."""
    rnd = random.Random(9)
    line = "".join(rnd.choice("abcdefgh") for _ in range(50))
    text = lambda n: "".join(rnd.choice("mnopqrstuvwéßñ漢字") for _ in range(n))
    rows = [(i, text(80) + line + text(80)) for i in range(60)]
    rows += [(100 + i, text(40) + rows[i][1][60:150] + text(40)) for i in range(6)]
    rows += [(200 + i, text(40) + line + "the end" + text(40)) for i in range(6)]
    folder = str(tmp_path)

    w = Windows("bytes", 56, 8, 16, 0, shard_bytes=2000)
    docs = documents(spark, rows)
    table, size = segments(keyed(docs), w)
    largest = table.where("cnt > 0").groupBy("h").agg(F.sum(F.length("body")).alias("n")).agg(F.max("n")).first()[0]
    assert largest > 2000
    plain = winnow.trimmed

    def all_bodies(bodies, weights, w, repeated):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(map(len, bodies))))
        return plain(bodies, weights, w, repeated)

    monkeypatch.setattr(winnow, "trimmed", all_bodies)
    assert document_spans(table, matched(table, size, w, suffix_ranges(56))).collect()
    received = [int(f.read_text()) for f in tmp_path.iterdir()]
    # no shard holds what the anchor had
    assert received and max(received) < largest // 2
    masks = gone([t.encode() for _, t in rows], 56)
    want = Counter((i, bytes(c for c, g in zip(t.encode(), m) if not g)) for (i, t), m in zip(rows, masks))
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in repeated_bytes(docs, w).collect()) == want


def test_only_texts_that_may_have_spans_are_shuffled(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(3000)] + [(7, "text 7"), (None, None)])
    keys = keyed(docs).where("k1 % 50 = 0 or k1 < 0").select("k2")
    held = {r["k2"] for r in keys.collect()}
    for bits in (1, 10, 26):
        there, other = parted(keyed(docs), keys, bits)
        found, rest = ([tuple(r) for r in part.collect()] for part in (there, other))
        assert Counter(found + rest) == Counter(map(tuple, keyed(docs).collect()))
        assert all((r[3] % (1 << bits)) in {k % (1 << bits) for k in held} for r in found) and not any(r[3] in held for r in rest)
    assert len(found) < 70
    # a passage in two of many documents
    rnd = random.Random(4)
    passage = " ".join(rnd.choice("abcdefgh") * 3 for _ in range(60))
    rows = [(i, " ".join(f"{i}x{k}" for k in range(50)) + (" " + passage if i in (5, 900) else "")) for i in range(1000)]
    out = repeated_substrings(documents(spark, rows))
    assert {r["doc_id"]: r["n_removed"] for r in out.collect() if r["n_removed"]} == {5: 60, 900: 60}


def test_bitmaps_come_to_the_driver_compressed(spark, monkeypatch):
    bits, mask = 22, (1 << 22) - 1
    rnd = np.random.default_rng(5)
    # one bucket met twice in each range of buckets, and others met once
    twice = (np.arange(1 << 6, dtype=np.int64) << winnow.PART_BITS) + rnd.integers(0, 1 << winnow.PART_BITS, 1 << 6)
    numbers = np.concatenate([twice, twice, rnd.integers(0, 1 << 40, 20_000)]).tolist()
    docs = spark.createDataFrame([(str(n),) for n in numbers], "text string")
    came, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: came.append(collect(self)) or came[-1])
    found = winnow.seen_twice(docs, lambda column: [np.array([int(t) for t in column.to_pylist()], np.uint64)], bits)
    count = Counter(n & mask for n in numbers)
    assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == sorted(b for b, c in count.items() if c > 1)
    assert len(came) == 1 and sum(t.nbytes for t in came) < found.nbytes // 10


def test_empty_table(spark):
    assert repeated_substrings(documents(spark, texts()[:1]).limit(0)).count() == 0
    assert repeated_bytes(documents(spark, texts()[:1]).limit(0)).count() == 0
