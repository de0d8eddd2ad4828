import math
from collections import Counter

import numpy as np
import pytest
from cases import documents, texts, words
from pyspark.sql import functions as F

from keelson.llm import lattice
from keelson.llm.packing_queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def all_segmentations(text, score, byte):
    """Sum of probabilities over all ways to cut ``text``."""
    if not text:
        return 1.0
    total = 0.0
    for j in range(1, len(text) + 1):
        s = score.get(text[:j])
        if s is None and j == 1:
            s = sum(byte[b] for b in text[0].encode())
        if s is not None:
            total += math.exp(s) * all_segmentations(text[j:], score, byte)
    return total


def test_marginal():
    vocab = lattice.vocabulary(PATH)
    values = np.log(np.random.default_rng(1).random(vocab.size) + 1e-3)
    model = lattice.Lattice(vocab, values)
    for word in ["the", "thing", "é", "a漢b", "x🙂", "|", "ation,", "▁a"]:
        want = all_segmentations(lattice.MARK + word, model.score, model.byte)
        assert model.marginal(word) == pytest.approx(math.log10(want), rel=1e-9)


@pytest.mark.parametrize("block", [300_000, 20])
def test_scores(spark, block, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_WORDS", block)
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: i is not None and i % 3 == 1
    out = lattice.score_documents(docs, F.col("doc_id") % 3 == 1, PATH).collect()
    lower = [(i, [w.lower().decode() for w in words(t)]) for i, t in rows]
    train = Counter(w for i, ws in lower if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in lower)
    n, v = sum(train.values()) + ends, len(train) + 1
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    vocab = lattice.vocabulary(PATH)
    count = np.ones(vocab.size)
    for w, c in train.items():
        for p in vocab.model.encode(w):
            count[p] += c
    whole = count.sum() + ends + 1
    model = lattice.Lattice(vocab, np.log(count / whole))
    lp = {w: model.marginal(w) for _, ws in lower for w in ws}
    want = sorted(
        (str(i), held(i), len(ws) + 1, sum(w in train for w in ws) + 1, n,
         round(sum(base(train[w]) for w in ws) + base(ends), 6), round(sum(lp[w] for w in ws) + math.log10((ends + 1) / whole), 6))
        for i, ws in lower
    )
    got = sorted((str(r[0]), *tuple(r)[1:5], round(r[5], 6), round(r[6], 6)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


def test_no_training_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: (r["n_known"], r["train_tokens"], r["base_score"]) for r in lattice.score_documents(docs, F.lit(True), PATH).collect()}
    assert got == {1: (0, 0, 0.0), 2: (0, 0, 0.0)}
    assert lattice.score_documents(documents(spark, texts()[:1]).limit(0), F.lit(False), PATH).count() == 0
