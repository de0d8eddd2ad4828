import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import documents, texts

from keelson.llm.packing import non_negative, pack, plan, strategies, tail_borders
from keelson.llm.packing_queries import tokenizer_path
from keelson.llm.tokens import WordTokenizer, encoded, tokenizer


def check(spark, rows, window, grain):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark, rows)
    want = Counter((i, tuple(model.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    pieces = pack(docs, tokenizer_path(), window=window, grain=grain).collect()
    # repeated rows cannot be told apart: their pieces are compared as a bag
    ids = Counter()
    for r in pieces:
        own = np.frombuffer(r["ids"], "<u4")
        assert len(own) == r["length"] > 0
        ids.update((r["doc_id"], r["doc_tokens"], r["start"] + k, int(x)) for k, x in enumerate(own))
    assert ids == Counter((i, len(t), k, x) for (i, t), n in want.items() for _ in range(n) for k, x in enumerate(t))
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        used += at
        padded += at if at & (at - 1) == 0 else window
    return 1 - used / padded


def test_round_trip(spark):
    assert check(spark, texts(), 64, 4) < 0.05
    assert check(spark, [(5, None)], 64, 4) == 0


def test_one_class_only(spark):
    assert check(spark, [(k, "a b c d e f g h i j k l") for k in range(9)], 64, 4) == 0
    assert pack(documents(spark, [(1, "a")]).limit(0), tokenizer_path()).count() == 0


def test_word_tokenizer():
    model = WordTokenizer(tokenizer_path())
    for word in "Thst, don't I'LL Ärger ÉTÉ İstanbul ΣΑΣ <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b 12ab|x… naïve é x\xa0y 漢字 ½ ²".split(" "):
        got, count = model.encode([word.encode()])
        assert got.tolist() == model.whole.encode(word, add_special_tokens=False).ids and count.tolist() == [len(got)]


def test_marks_are_learnt_once():
    letters = ["alpha", "Bêta", "gößß", "don't", "x\u0338y", "É"]
    rows = [" ".join(w + m for w in letters) for m in ("", ".", ",***", "'s", "!'s", "\u0338.", "×", "9", "<", "|>", "$\xa0%")]
    rows += ["a<|endoftext|>b. c", ".", None, "end", ".begin", ""]
    model = tokenizer(tokenizer_path())
    model.clear()
    for few in ([t for t in rows if "<|" not in (t or "")], rows):
        got = [ids.tolist() for _, ids in encoded(pa.array(few), tokenizer_path(), None)]
        assert got == [model.whole.encode(t or "", add_special_tokens=False).ids for t in few]
    model.clear()
    marked = pa.array([" ".join(w + m for w in ("one", "two", "three", "öß") for m in (".", ",", "!!", "$$$", "'s", ""))])
    assert sum(len(ids) for _, ids in encoded(marked, tokenizer_path(), None)) > 24
    assert len(model.code) == 4 + 5


def test_strategies_and_plan():
    found = strategies(np.array([1, 2, 3, 5]), 6, 3)
    assert set(found) == {(5, 1), (3, 3), (3, 2, 1), (2, 2, 2)}
    rnd = random.Random(1)
    counts = {k: rnd.randint(1, 500) for k in range(1, 17)}
    chosen = plan(counts, 16, 3)
    used = Counter()
    for s, n in chosen:
        assert sum(s) == 16 and n > 0
        for c in s:
            used[c] += n
    assert all(used[c] <= counts[c] for c in used) and used[16] == counts[16]


def test_least_squares():
    rng = np.random.default_rng(3)
    a, x = rng.random((8, 20)), np.maximum(rng.normal(size=20), 0)
    got = non_negative(a, a @ x, 100)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_tail():
    assert tail_borders(100, 64).tolist() == [64, 96] and tail_borders(128, 64).tolist() == []
