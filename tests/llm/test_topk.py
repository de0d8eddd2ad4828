import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm.topk import survivors, top_k


def rows(seed, n=160, dim=6):
    rnd = random.Random(seed)
    out = [(i, [rnd.gauss(0, 1) * (5 if i % 40 == 0 else 1) for _ in range(dim)]) for i in range(n)]
    out += [(500 + i, out[7][1]) for i in range(15)]  # a common vector
    out += [(600, None), (601, [0.1, None] + [0.0] * (dim - 2)), (602, [float("nan")] * dim), (603, [math.inf] * dim), (604, []), (605, [1e12] * dim), (606, [3e6] * dim), (607, [-1e25] * dim), (608, [1e300] + [0.0] * (dim - 1))]
    out += [(700, [0.0] * dim), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (100, out[3][1]), (None, out[5][1])]
    return out


def expected(data, k):
    whole = [(i, np.array([max(-(2**62), min(2**62, math.floor(1024 * x))) for x in v], object)) for i, v in data if v and None not in v and np.isfinite(v).all()]
    cut = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = Counter()
    for a, (i, v) in enumerate(whole):
        if i is not None and i % 100 == 0:
            scores = sorted((-cut(int(v @ w)), math.inf if j is None else j) for b, (j, w) in enumerate(whole) if a != b and len(v) == len(w))[:k]
            out.update((i, rank + 1, None if j == math.inf else j, -s) for rank, (s, j) in enumerate(scores))
    return out


@pytest.mark.parametrize("tiles", [{}, {"seed_rows": 5, "block_rows": 8, "tile_queries": 1, "tile_rows": 20, "coordinate_from": 0.2}])
def test_against_brute_force(spark, tiles):
    data = rows(1)
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in data], "vec_id long, embedding array<double>, key int, norm double").repartition(3)
    got = top_k(table, F.col("id") % 100 == 0, k=5, **tiles).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == expected(data, 5)
    assert top_k(table.limit(0), F.col("id") % 100 == 0).count() == 0


def test_pruning_is_safe():
    rng = np.random.default_rng(2)
    for _ in range(200):
        c = rng.integers(-50, 50, (40, 5))
        norms = np.sqrt((c * c).sum(axis=1))
        order = np.argsort(-norms)
        c, norms = c[order], np.maximum(norms[order], 1e-300)
        q = rng.integers(-50, 50, 5)
        scores = c @ q
        bound = float(np.sort(scores)[-4])
        left = survivors(q, float(np.sqrt(q @ q)), bound, c, norms, 0.1, 3)
        if left is not None:
            assert set(np.flatnonzero(scores >= bound)) <= set(left.tolist())
