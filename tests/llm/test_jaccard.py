import random
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, texts, words

from keelson.llm import jaccard
from keelson.llm.components import components
from keelson.llm.jaccard import Similar, join_region, one_of_each, similar


def shingles(text, k):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def linked(sets, w):
    return [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and w.den * len(sets[a] & sets[b]) >= w.num * len(sets[a] | sets[b])
    ]


def near_copies(seed, n=60):
    rnd = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if i % 12 == 0:
            base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(20, 60))]
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = "new" + str(rnd.random())
        out.append((100 + i, " ".join(copy[: len(copy) - rnd.randint(0, 4)])))
    return out


def check(spark, rows, w):
    docs = documents(spark, rows)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t, w.shingle) for _, t in rows]
    roots = grouped(len(sets), linked(sets, w))
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = Counter((i, len(s), least[r] if s else i) for (i, _), s, r in zip(rows, sets, roots))
    got = similar(docs, w).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_against_all_pairs(spark):
    check(spark, texts() + near_copies(1), Similar(4, 85, 100, 16))


def test_rings_and_lower_similarity(spark):
    check(spark, texts()[:12] + near_copies(2, 48), Similar(2, 60, 100, 16, ring_from=2))


def test_region():
    rnd = random.Random(5)
    w = Similar(1, 70, 100)
    for _ in range(60):
        base = set(rnd.sample(range(200), 30))
        sets = [{*rnd.sample(sorted(base), rnd.randint(15, 30)), *(rnd.randint(200, 400) for _ in range(rnd.randint(0, 6)))} for _ in range(14)]
        got = join_region([np.array(sorted(s), np.uint64) for s in sets], w)
        want = linked(sets, w)
        assert {frozenset(p) for p in got} <= {frozenset(p) for p in want}
        a, b = grouped(14, got), grouped(14, want)
        assert [[x == y for y in a] for x in a] == [[x == y for y in b] for x in b]


def template_copies(seed, n):
    """Copies of one template, with unique words at its end; and near copies of some of them."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(40)]
    out = [(1000 + i, " ".join(base + [f"u{i}x{k}" for k in range(rnd.randint(1, 8))])) for i in range(n)]
    return out + [(2000 + i, text + " end") for i, (_, text) in enumerate(out[::3])]


def test_large_groups_are_joined_in_rounds(spark):
    w = Similar(2, 60, 100, 16, ring_from=4, group_shingles=100, sub_pivots=2)
    check(spark, texts() + near_copies(6) + template_copies(7, 45), w)


def test_no_task_holds_a_large_group(spark, tmp_path, monkeypatch):
    plain, folder = jaccard.join_region, str(tmp_path)

    def noted(members, w):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(len(m) for m in members)))
        return plain(members, w)

    monkeypatch.setattr(jaccard, "join_region", noted)
    # two small groups, and copies of a template that are one group
    rows = template_copies(8, 60) + [(i, " ".join(f"s{i % 2}x{k}" for k in range(20 + i // 2))) for i in range(4)]
    check(spark, rows, Similar(4, 85, 100, 16, group_shingles=400))
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sizes and max(sizes) <= 400


def test_one_of_each(spark):
    rows = [*near_copies(3, 24), (1, None), (1, None), (2, " "), (None, "lone text here"), (7, "x y z"), (7, "x y z"), (8, "X y z")]
    docs = documents(spark, rows)
    out = one_of_each(docs, Similar(5, 80, 100, 16))
    assert out.schema == docs.schema
    sets = [shingles(t, 5) for _, t in rows]
    roots = grouped(len(rows), linked(sets, Similar(5, 80, 100)))
    groups = len({r for r, s in zip(roots, sets) if s})
    got = [r["doc_id"] for r in out.collect()]
    assert len(got) == groups + 3 and sorted(i for i in got if i in (1, 2, 7, 8)) == [1, 1, 2, 7]


def lone(n, times=1):
    """Texts that share no shingle, each under ``times`` ids."""
    return [(5000 + 1000 * k + i, " ".join(f"l{i}x{j}" for j in range(30))) for i in range(n) for k in range(times)]


def test_copies_alone_do_not_send_their_sets(spark, monkeypatch):
    plain, written = jaccard.kept, {}
    monkeypatch.setattr(jaccard, "kept", lambda df, label: written.setdefault(label, plain(df, label)))
    pair = [(1, " ".join(f"p{j}" for j in range(60))), (2, " ".join(f"p{j}" for j in range(60)) + " tail")]
    check(spark, lone(40, 3) + pair, Similar(4, 85, 100))
    assert written["near"].select("vid").distinct().count() == 2


@pytest.mark.parametrize("small", [False, True])
def test_near_holds_those_that_share_first_shingles(spark, monkeypatch, small):
    if small:  # many parts, and many rows for each
        monkeypatch.setattr(jaccard, "MEET", 8)
        monkeypatch.setattr(jaccard, "SEND", 40)
    w = Similar(4, 85, 100)
    rows = texts() + near_copies(9, 48) + lone(30, 2)
    docs = jaccard.keyed(documents(spark, rows))
    found, common = jaccard.vertices(docs, w)
    one, shingles = jaccard.one_document(found)
    by = {jaccard.digest(s): s for _, s in jaccard.sets(pa.array([t for _, t in rows], pa.string()), w) if len(s)}
    assert shingles == sum(map(len, by.values())) and (w.parts(shingles) > 64) == small
    first = {v: jaccard.first_shingles(s, common, w).tolist() for v, s in by.items()}
    holders = Counter(s for f in first.values() for s in f)
    want = {}
    for v, f in first.items():
        n = len(by[v])
        cells = sum(holders[s] > 1 for s in f[: w.first(n)])
        if cells and sum(holders[s] > 1 for s in f) >= w.least(n):
            want[v] = (n, cells)
    assert 10 < len(want) < len(by) - 29
    assert {r["vid"]: (r["n"], len(set(r["cells"]))) for r in jaccard.near(docs, w, common, one, shingles).collect()} == want


def test_hashes_that_two_vertices_hold():
    rnd = random.Random(8)
    for n in (0, 1, 2, 300):
        # the lowest bit is the mark; a vertex may come twice
        entries = [(rnd.randrange(100) << 1 | rnd.randrange(2), rnd.randrange(-4, 4)) for _ in range(n)]
        holders = {c: {v for d, v in entries if d >> 1 == c >> 1} for c, _ in entries}
        want = {}
        for c, v in entries:
            if len(holders[c]) > 1:
                places, route = want.get((v, c >> 1), (0, False))
                want[v, c >> 1] = (places + 1, route or bool(c & 1))
        code, vid = np.array([c for c, _ in entries], np.uint32), np.array([v for _, v in entries], np.int64)
        got = [x.tolist() for x in jaccard.meeting(code, vid)]
        assert {(v, c): (p, r) for v, c, p, r in zip(*got)} == want and len(got[0]) == len(want)


def test_least_as_a_column(spark):
    for w in (Similar(), Similar(5, 80, 100), Similar(2, 60, 100, 16), Similar(1, 1, 3, 7)):
        assert all(r["got"] == w.least(r["id"]) for r in spark.range(1, 400).withColumn("got", w.least_column("id")).collect())


def test_only_rows_that_may_go_are_shuffled(spark, monkeypatch):
    plain, cut = jaccard.parted, []
    monkeypatch.setattr(jaccard, "parted", lambda *a: cut.append(plain(*a)) or cut[-1])
    pair = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q r s t u v"), (3, "q r s t u v")]
    out = one_of_each(documents(spark, lone(200) + pair + [(None, None)]), Similar(5, 80, 100))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 3, None] + [i for i, _ in lone(200)])
    # the second of the pair, and the row that comes twice; hardly any other has their buckets
    there, other = cut[-1]
    assert there.count() < 20 and other.count() > 180


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ends = sorted(got)
    want = grouped(len(ends), [(ends.index(a), ends.index(b)) for a, b in pairs if a and a != b])
    assert len(set(zip(want, (got[e] for e in ends)))) == len(set(want)) == len(set(got.values()))


def test_empty_table(spark):
    assert similar(documents(spark, [(1, "x")]).limit(0)).count() == 0
