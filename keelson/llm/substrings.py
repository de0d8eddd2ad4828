"""Substring dedup: suffix automata of reference shards and matching statistics of the texts streamed through them.

A reference shard is the distinct candidate segments (see ``winnow``) of a range of anchor hashes. Its generalised suffix
automaton counts in how many places each of its strings occurs, weighted with the copies of each segment. A segment is then
streamed through it: after each word, the matching statistic is the length of the longest suffix that occurs in at least
two places. Ranges with statistics of ``size`` words or more are the maximal repeated spans; words in them are removed.

Rows of ``repeated_substrings``: one per input row, in no order. A null text is empty: no words, empty result. Repeated
rows repeat each other's windows, so both lose them. Texts shorter than a window lose nothing. A null ``doc_id`` stays
null. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keelson.llm.text import chunks, tidy, words
from keelson.llm.winnow import Windows, covered, with_spans

WORDS = Windows("words", 35, 8)


class Automaton:
    """Generalised suffix automaton with weighted occurrence counts. State 0 is the empty string."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string of ``p`` followed by ``c``, taken out of ``q``."""
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int], weight: int) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Pass counts to the suffixes; note for each state its longest suffix that occurs twice."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for state in reversed(order):
            if state:
                self.count[self.link[state]] += self.count[state]
        self.twice = [0] * len(order)
        for state in order:
            if state:
                self.twice[state] = self.length[state] if self.count[state] > 1 else self.twice[self.link[state]]

    def statistics(self, tokens: list[int]) -> list[int]:
        """After each token, the length of the longest suffix that occurs in two places; ``tokens`` need not be in here."""
        following, link, length, count, twice = self.next, self.link, self.length, self.count, self.twice
        out = []
        state = matched = 0
        for c in tokens:
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c in following[state]:
                state = following[state][c]
                matched += 1
            out.append(matched if count[state] > 1 else twice[state])
        return out


def ranges(statistics: list[int], size: int) -> np.ndarray:
    """Maximal ranges of tokens that lie in a match of at least ``size``."""
    length = np.array(statistics, np.int64)
    end = np.flatnonzero(length >= size)
    if not len(end):
        return np.zeros((0, 2), np.int64)
    low = end - length[end] + 1
    low = np.minimum.accumulate(low[::-1])[::-1]
    new = np.r_[True, low[1:] > end[:-1] + 1]
    return np.stack([low[new], end[np.r_[new[1:], True]] + 1], axis=1)


def automaton_ranges(size: int):
    def repeated(bodies: list[bytes], weights: list[int]) -> list[np.ndarray]:
        codes: dict[bytes, int] = {}
        texts = [[codes.setdefault(word, len(codes)) for word in body.split()] for body in bodies]
        automaton = Automaton()
        for tokens, weight in zip(texts, weights):
            automaton.add(tokens, weight)
        automaton.finish()
        return [ranges(automaton.statistics(tokens), size) for tokens in texts]

    return repeated


def repeated_substrings(docs: DataFrame, w: Windows = WORDS, separator: str | None = " ", carry: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` of every document, and its columns in ``row`` with ``carry``.

    Kept words are joined by ``separator``; with None, the removed words are cut out of the text and the rest stays as it is.
    """
    glue = None if separator is None else separator.encode()

    def remove(batches):
        for batch in batches:
            ids, text, found = (batch.column(k) for k in range(3))
            n_words, n_removed, out = [], [], []
            founds = found.to_pylist()
            for chunk in chunks(text):
                at = words(chunk.data, chunk.offsets)
                raw = chunk.data.tobytes()
                for k in range(chunk.high - chunk.low):
                    a, b = chunk.offsets[k], chunk.offsets[k + 1]
                    low, high = at.first[k], at.first[k + 1]
                    spans = founds[chunk.low + k]
                    n_words.append(int(high - low))
                    gone = covered([(f["at"], f["spans"]) for f in spans], high - low) if spans else None
                    n_removed.append(int(gone.sum()) if spans else 0)
                    if spans and glue is None:
                        # a removed word goes with the white space after it
                        begin = np.append(at.begin[low:high], b)
                        cut = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                        edges = np.r_[a, begin[cut], b]
                        out.append(b"".join(raw[x:y] for x, y in edges.reshape(-1, 2)).decode())
                    elif spans:
                        out.append(glue.join(word for word, g in zip(raw[a:b].split(), gone.tolist()) if not g).decode())
                    else:
                        out.append((raw[a:b] if glue is None else glue.join(raw[a:b].split())).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string()), *batch.columns[3:]], names
            )

    names = ["doc_id", "n_words", "n_removed", "kept_text", *(["row"] if carry else [])]
    found = with_spans(docs, w, automaton_ranges(w.size), carry)
    kinds = [found.schema["doc_id"].dataType, LongType(), LongType(), StringType(), *([found.schema["row"].dataType] if carry else [])]
    return found.mapInArrow(tidy(remove), StructType([StructField(n, t) for n, t in zip(names, kinds)]))
