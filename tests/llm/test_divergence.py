import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import WORDS, texts

from keelson.llm.divergence import divergence, joint_sums, prices, term_counts

COLUMNS = "doc_id long, text string, lang string, source string, term string, n int, value double"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def expected(rows, min_docs=3, top=200, scale=10**9):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        keep = {t for t, n in seen.items() if n >= min_docs}
        groups = defaultdict(Counter)
        for _, source, found in own:
            groups[source].update(t for t in found if t in keep)
        whole = sum(groups.values(), Counter())
        price = lambda c, t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(keep))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        for g, c in groups.items():
            pair = [(-sum(f(price(c, t), price(d, t)) for t in keep), s.encode(), s) for s, d in groups.items() if s != g]
            better = [(-f(price(c, t), price(whole, t)), t.encode(), t) for t in c if c[t] and price(c, t) > price(whole, t)]
            for part, items, limit in (("pair", pair, None), ("term", better, top)):
                out.update((lang, g, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(items)[:limit]))
    return out


def made(seed, n=80):
    rnd = random.Random(seed)
    words = [*WORDS, "É", "é", "漢字", "x1y", "it's", "🙂", "ſ", "K"]
    out = [(t, "en", rnd.choice(["a", "b"])) for _, t in texts()]
    for _ in range(n):
        text = " ".join(rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 25)))
        out.append((text, rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", "d", "ä", "Z", None, ""])))
    out += [("once only here", "xx", "a"), (None, "xx", "b"), ("", "yy", "lonely"), ("same same", "zz", "a"), ("same same", "zz", "b"), ("same same", "zz", "c")]
    return out + out[-3:]


@pytest.mark.parametrize("blocks", [{}, {"tile": 2, "block_terms": 5, "rows": 3, "columns": 12}, {"tile": 3, "block_terms": 7, "columns": 1}])
def test_against_brute_force(spark, blocks):
    data = made(len(blocks))
    rows = spark.createDataFrame([(k, *r, "x", 1, 0.5) for k, r in enumerate(data)], COLUMNS).repartition(5)
    got = divergence(rows, top_terms=6, **blocks).select("lang", "source", "part", "item", "value", "rank").collect()
    assert Counter(map(tuple, got)) == expected(data, top=6)
    assert divergence(rows.limit(0), **blocks).count() == 0


def test_long_texts_and_no_terms(spark):
    rnd = random.Random(3)
    long = " ".join(f"{rnd.choice(WORDS)}" for _ in range(1_600_000))  # longer than what is counted at once
    data = [(long, "en", "a"), (long[:4000], "en", "b"), (long[:100], "en", "a"), ("x" * 100_000, "en", "b"), ("1 2 3", "no", "a"), (None, "no", "b")]
    rows = spark.createDataFrame(data, "text string, lang string, source string")
    got = divergence(rows).select("lang", "source", "part", "item", "value", "rank").collect()
    assert Counter(map(tuple, got)) == expected(data)
    counted = term_counts(rows, "text", ["lang", "source"]).collect()
    assert sum(r["n"] for r in counted) == sum(len(terms(t)) for t, _, _ in data)


def test_large_counts_are_exact(spark):
    big = 10**13
    assert prices([big, 0], big, 7, 10**9).tolist() == [1 + 10**9 * (big + 1) // (big + 7), 1]
    from keelson.llm.divergence import price

    row = spark.createDataFrame([(big, big, 7)], "n long, total long, vocab long").select(price("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 1) // (big + 7)


def test_joint_sums_by_levels():
    rnd = random.Random(5)
    groups = [(0, 40, 9), (1, 11, 9), (2, 0, 9)]
    cells = {(t, g): rnd.randint(1, 4) for t in range(9) for g in (0, 1) if rnd.random() < 0.6}
    cells = {(t, g): c for (t, g), c in cells.items()}
    renamed = {t: k for k, t in enumerate(sorted({t for t, _ in cells}))}
    term, group, level = (np.array(x) for x in zip(*[(renamed[t], g, c) for (t, g), c in cells.items()]))
    sums, n = joint_sums(groups, term, group, level, 1000, 4, 5)
    assert n == len(renamed)
    for a, (_, na, v) in enumerate(groups):
        for b, (_, nb, _) in enumerate(groups):
            want = 0
            for t in renamed:
                p, q = 1 + 1000 * (cells.get((t, a), 0) + 1) // (na + v), 1 + 1000 * (cells.get((t, b), 0) + 1) // (nb + v)
                want += (p - q) ** 2 // q
            assert sums[a, b] == want
