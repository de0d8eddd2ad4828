import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, texts

from keelson.llm.lattice import MARK
from keelson.llm.packing_queries import tokenizer_path
from keelson.llm.viterbi import NEVER, STEP, TIE, TOGETHER, UNIT, Best, decode, encode, encode_apart, places, product, segmenter, unit_begin, whole

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = ["the", "ing", " ", "tion", "a", "é", "\n", "漢", "er", " of ", "in", "  ", "xq", "🙂"]


def plain(best, text):
    """Best segmentation of a whole text at once, every piece tried everywhere."""
    place = places(text, 0)
    score, last = [0] + [NEVER] * len(text), [0] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - best.longest), j):
            s = best.score.get(text[i:j], best.unknown if j == i + 1 else None)
            if s is not None:
                own = s & (TIE - 1)
                s += score[i] - own + (own * (2 * place[i] + 1) & (TIE - 1))
                if s > score[j]:
                    score[j], last[j] = s, i
    out, j = [], len(text)
    while j:
        out.append(text[last[j] : j])
        j = last[j]
    ids = [i for p in out[::-1] for i in ([best.vocab.id[p]] if p in best.vocab.id else [best.vocab.byte[b] for b in p.encode()])]
    # the file's own scores; a character that has none costs ten less than the worst piece
    file = lambda p: round(best.vocab.model.get_score(best.vocab.id[p]))
    worst = min(map(file, best.score))
    total = sum(file(p) if p in best.score else worst - 10 for p in out)
    assert score[-1] // STEP == total
    return ids, total


def some_texts(seed, n):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(n)]
    return out + [t.replace(" ", "a").replace("\n", "b") for t in out[: n // 3]]


def test_chunks_make_the_whole():
    best, rnd = segmenter(PATH), random.Random(1)
    for text in some_texts(2, 150):
        text = MARK + text.replace(" ", MARK)
        ids, score = plain(best, text)
        cs = rnd.choice([1, 2, 5, 17, 20, 40])
        cuts = [(i, min(cs, len(text) - i), text[i : i + cs + best.longest - 1], i - unit_begin(text, i)) for i in range(0, len(text), cs)]
        found = [best.matrix(t, n, o) for _, n, t, o in cuts]
        total = found[0]
        for m in found[1:]:
            total = product(total, m)
        assert total[0, 0] // STEP == score
        rest = [np.full((best.longest, 1), NEVER, np.int64)]
        rest[0][0] = 0
        for m in reversed(found):
            rest.append(product(m, rest[-1]))
        states, got = [0], []
        for k, ((_, n, t, o), m) in enumerate(zip(cuts, found)):
            states.append(int((m[states[-1]] + rest[len(found) - 1 - k][:, 0]).argmax()))
            got += best.between(t, states[-2], n + states[-1], o).tolist()
        assert got == ids == best.units(text).tolist()
        assert best.decode(np.array(ids)).decode() == text.replace(MARK, " ")


def test_units_together(monkeypatch):
    best = Best(PATH)
    long = MARK + "tion" * 40
    units = sorted({u for t in some_texts(7, 300) for u in UNIT.findall(MARK + t.replace(" ", MARK))} | {MARK, MARK * 3 + "the", long, MARK + "a\0b"})
    want = [best.segment(u, range(len(u))) for u in units]
    assert [best.units(u).tolist() for u in units] == want
    # met in one go, in small steps, and with a memory that overflows
    for chars, kept in ((1 << 17, 600_000), (TOGETHER * 3, 600_000), (1 << 17, 20)):
        monkeypatch.setattr("keelson.llm.viterbi.TOGETHER_CHARS", chars)
        monkeypatch.setattr("keelson.llm.viterbi.UNITS_KEPT", kept)
        best = Best(PATH)
        assert [ids.tolist() for ids in best.many(["", *units, units[0]])] == [[], *want, want[0]]
    assert list(best.many([])) == []


@pytest.mark.parametrize("chunk", [7, 64, 32768])
def test_documents(spark, chunk):
    best = segmenter(PATH)
    rows = [r for r in texts() if r[0] != 7] + [(200 + k, t) for k, t in enumerate(some_texts(5, 30))]
    short, long = encode_apart(documents(spark, rows), PATH, chunk)
    out = whole(decode(short, PATH), decode(long, PATH)).collect()
    want = Counter()
    for i, t in rows:
        ids, score = plain(best, MARK + t.replace(" ", MARK)) if t else ([], 0)
        want[i, tuple(ids), score, t or ""] += 1
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["score"], r["text"]) for r in out) == want


def test_empty_table(spark):
    assert decode(encode(documents(spark, [(1, "a")]).limit(0), PATH), PATH).count() == 0
