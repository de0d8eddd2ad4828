"""Token ids of whole Arrow batches with a public tokenizer file; words met before are looked up."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex

from keelson.llm.text import chunks

#: Words one worker remembers; beyond that it starts anew. About 250 bytes each, so 150 MB a worker.
WORDS_KEPT = 600_000

#: Fixed values of the tokenizer file: what it splits off before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Plain letters, printable marks of ASCII, and the second bytes of the letters U+00C0 to U+00FF, whose first is ``LATIN``.
LETTER, MARK, SECOND = np.zeros((3, 256), bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
SECOND[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
LATIN = 0xC3


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class _Codes(dict):
    """Numbers of words, in the order they were met; ``learn`` is called for a new one."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.learn(n, word)
        return n


class WordIds:
    """Ids of words, learnt once each by ``ids_of`` and then looked up for whole arrays of words."""

    def __init__(self) -> None:
        self.clear()

    def ids_of(self, word: bytes) -> list[int]:
        raise NotImplementedError

    def clear(self) -> None:
        self.code = _Codes(self._learn)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = 0

    def _learn(self, n: int, word: bytes) -> None:
        ids = self.ids_of(word)
        if n + 2 > len(self.start):
            self.start = np.resize(self.start, 2 * len(self.start))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.size : self.size + len(ids)] = ids
        self.start[n] = self.size
        self.size += len(ids)
        self.start[n + 1] = self.size

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has."""
        if len(self.code) > WORDS_KEPT:
            self.clear()
        codes = np.fromiter(map(self.code.__getitem__, found), np.int64, len(found))
        begin = self.start[codes]
        count = self.start[codes + 1] - begin
        before = np.cumsum(count) - count
        return self.flat[np.repeat(begin - before, count) + np.arange(int(count.sum()))], count


class WordTokenizer(WordIds):
    """Ids of the lower-casing, white-space-dropping word tokenizer, word by word.

    White space ends a token, so the ids of a text are the ids of its words one after another. Latin words are split and
    merged directly; any other word, and any word that may hold a special token, goes through the whole tokenizer.
    Words of letters alone are one part each, and are not remembered as parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.alphabet = _visible_bytes()
        self.shown = {b: c for b, c in self.alphabet.items() if chr(b) != c}
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.parts: dict[str, list[int]] = {}

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = self._merged(part)
        return ids

    def _merged(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.shown))]

    def ids_of(self, word: bytes) -> list[int]:
        if word.isalpha():  # plain letters are one part, their own letters of the byte alphabet
            return [t.id for t in self.model.tokenize(word.lower().decode())]
        text = word.decode()
        if max(text) < "\u0250" and "<|" not in text and "\u0130" not in text and text.split() == [text]:
            if text.isalpha():
                return self._merged(text.lower())
            parts = SPLIT.findall(text.lower())
            return self._part(parts[0]) if len(parts) == 1 else [i for part in parts for i in self._part(part)]
        return self.whole.encode(text, add_special_tokens=False).ids


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process; words stay known from task to task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def split_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space between a letter and a mark behind it: a token ends there anyway, and fewer words are to learn."""
    letter = LETTER[data]
    letter[1:] |= (data[:-1] == LATIN) & SECOND[data[1:]]
    at = np.flatnonzero(letter[:-1] & MARK[data[1:]]) + 1
    return np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)


def encoded(column: pa.Array, path: str, end: int | None):
    """For each document of a string column: its row and its ids, followed by ``end``."""
    model = tokenizer(path)
    for chunk in chunks(column):
        raw, offsets = chunk.data.tobytes(), chunk.offsets
        # only A-Z is lowered here, for fewer words to learn; a special token is told by its case, and holds marks
        if b"<|" not in raw:
            data, offsets = split_marks(chunk.data, offsets)
            raw = data.tobytes().lower()
        found: list[bytes] = []
        cuts = [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += raw[a:b].split()
            cuts.append(len(found))
        ids, count = model.encode(found)
        cuts = np.append(0, np.cumsum(count))[cuts]
        for k in range(chunk.high - chunk.low):
            own = ids[cuts[k] : cuts[k + 1]]
            yield chunk.low + k, own if end is None else np.append(own, np.uint32(end))
