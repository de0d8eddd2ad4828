import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm.negatives import hard_negatives
from keelson.llm.residues import EXACT, PRIMES, products

COLUMNS = "vec_id long, embedding array<double>, label int, key int, anchor string, v double"


@pytest.mark.parametrize("size, dim", [(3, 5), (300, 64), (2**20, 7), (2**25, 130), (2**29, 3), (2**40, 4), (2**31, 1)])
def test_products(size, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-size, size + 1, (9, dim)), rng.integers(-size, size + 1, (11, dim))
    a[0], b[0], b[1] = size, size, -size
    assert (products(a, b).astype(object) == a.astype(object) @ b.T.astype(object)).all()


def test_residues_are_exact():
    assert math.prod(PRIMES) > 2**63 and all(all(p % k for k in range(2, p)) for p in PRIMES)
    # the largest partial sum that is made at once
    assert all(EXACT // (p // 2) ** 2 * (p // 2) ** 2 <= EXACT for p in PRIMES)
    assert products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    assert products(np.zeros((0, 4), np.int64), np.ones((3, 4), np.int64)).shape == (0, 3)


def rows(seed, n=220, dim=6):
    rnd = random.Random(seed)
    out = [(i, [rnd.gauss(0.3, 0.2) for _ in range(dim)], rnd.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    out += [(1000 + i, out[7][1], i % 2) for i in range(12)]  # a common vector
    out += [(100, out[3][1], 0), (100, out[3][1], 0), (None, out[5][1], 1), (None, out[5][1], 0), (300, [-x for x in out[4][1]], 1)]
    out += [(600, None, 1), (601, [0.1, None] + [0.0] * (dim - 2), 1), (602, [math.nan] * dim, 1), (603, [math.inf] * dim, 1), (604, out[2][1], None)]
    out += [(700, [0.0] * dim, 2), (701, [0.0] * dim, 2), (800, [1.0, 2.0], 1), (801, [3.0, -1.0], 1), (802, [0.5, 0.9], 2), (900, [], 1), (901, [], 1), (902, [], 2)]
    return out


def large(dim=6):
    """Components above 2**26, up to the largest doubles."""
    return [(2000, [3e6] * dim, 5), (2001, [2e6] * dim, 5), (2002, [1.1e6] * dim, 6), (2003, [1e300] * dim, 7), (2004, [1.7e308] * dim, 7), (2100, [1e290] * dim, 8), (2101, [-1e17] * dim, 8)]


def expected(data, k=5, m=10):
    whole = []
    for i, v, label in data:
        if label is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            ints = [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]
            whole.append((i, ints, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    cut = lambda s: max(1 - 10**38, min(10**38 - 1, s))
    long = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = Counter()
    for a, (i, v, label) in enumerate(whole):
        if i is None or i % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), math.inf if j is None else j, b, other) for b, (j, w, other) in enumerate(whole) if a != b and len(v) == len(w)
        )
        for s, j, _, _ in [r for r in scored if r[3] == label][:k]:
            p = cut(-s)
            some = [r for r in scored if r[3] != label and 30 * p <= -100 * r[0] and -100 * r[0] <= 90 * p][:m]
            out.update((i, None if j == math.inf else j, n + 1, None if r[1] == math.inf else r[1], long(p), long(-r[0])) for n, r in enumerate(some))
    return out


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 20, "tile_anchors": 2, "step": 1}])
@pytest.mark.parametrize("more", [[], large()])
def test_against_brute_force(spark, tiles, more):
    data = rows(1) + more
    table = spark.createDataFrame([(*r, 0, "x", 1.0) for r in data], COLUMNS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(table, F.col("vec_id") % 100 == 0, label, **tiles).collect()
    want = expected(data)
    assert len(want) > 20 and Counter(map(tuple, got)) == want
    assert hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0, label, **tiles).count() == 0
