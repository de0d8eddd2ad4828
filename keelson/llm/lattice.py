"""Language-model scores from a subword lattice.

The model is a unigram model over an existing subword vocabulary: a text's probability is the sum over all ways to split
its words into pieces, of the product of the pieces' probabilities. A piece's score is the logarithm of its share of the
pieces of the training words, under the vocabulary's own segmentation, with one added to each count. Characters outside the
vocabulary fall back to its byte pieces. Words are segmented apart from each other (pieces begin with the word mark), so
the marginal probability of a text is the product of its words' and of the end's; a word's comes from the forward
recursion in logarithms, once for each distinct word of the corpus.

``token_counts`` gives each block of documents a dictionary of its own, so that a word crosses the network once per block
and not once per use. Words and their counts stay distributed; piece counts, bounded by the vocabulary, go to the driver.

A text is the words of ``[^\\x20\\x09-\\x0D]+``, A-Z lowered, then one end. A null or empty text is the end alone. Rows with a
null ``doc_id`` train. Repeated rows count each time. Without training rows all counts are 0. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.store import kept
from keelson.llm.text import chunks

MARK = "▁"
BLOCK_WORDS = 300_000
BLOCK_BYTES = 48 << 20


class Vocabulary:
    """Pieces of a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {*self.byte, self.model.unk_id(), self.model.bos_id(), self.model.eos_id()}
        self.id = {self.model.id_to_piece(i): i for i in range(self.size) if i not in special}
        self.longest = max(map(len, self.id))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Lattice:
    """Marginal log10 probability of words under piece scores."""

    def __init__(self, vocab: Vocabulary, score: np.ndarray):
        values = score.tolist()
        self.score = {piece: values[i] for piece, i in vocab.id.items()}
        self.byte = [values[i] for i in vocab.byte]
        self.longest = vocab.longest

    def marginal(self, word: str) -> float:
        text = MARK + word
        n, score, longest = len(text), self.score, self.longest
        forward = [0.0] + [-math.inf] * n
        for i in range(n):
            here = forward[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                s = score.get(text[i:j])
                if s is None:
                    if j > i + 1:
                        continue
                    s = sum(self.byte[b] for b in text[i].encode())
                a, b = forward[j], here + s
                if a < b:
                    a, b = b, a
                forward[j] = a if b == -math.inf else a + math.log1p(math.exp(b - a))
        return forward[n] / math.log(10)


def token_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Document rows (``counts``: local word numbers and counts, packed) and word rows (``word``, ``local``, ``trained``)."""
    names = ["block", "doc_id", "held_out", "n_tokens", "counts", "word", "local", "trained"]

    def count(batches):
        pid, turn = TaskContext.get().partitionId(), 0
        code: dict[bytes, int] = {}
        trained = np.zeros(1 << 12, np.int64)
        size = 0

        def dictionary(block):
            n = len(code)
            none = [pa.nulls(n, t) for t in (doc_type, pa.bool_(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int64)), *none, pa.array(list(code), pa.binary()).cast(pa.string()),
                 pa.array(np.arange(n, dtype=np.int32)), pa.array(trained[:n])], names
            )

        for batch in batches:
            doc_type, held = batch.column(0).type, batch.column(2).to_pylist()
            for chunk in chunks(batch.column(1)):
                block = pid << 32 | turn
                raw = chunk.data.tobytes()
                totals, packed = [], []
                for k in range(chunk.high - chunk.low):
                    found = raw[chunk.offsets[k] : chunk.offsets[k + 1]].lower().split()
                    local, count = np.unique(np.fromiter((code.setdefault(w, len(code)) for w in found), np.int32, len(found)), return_counts=True)
                    if len(code) > len(trained):
                        trained = np.append(trained, np.zeros(len(code), np.int64))
                    if not held[chunk.low + k]:
                        trained[local] += count
                    totals.append(len(found) + 1)
                    packed.append(zlib.compress(np.diff(local, prepend=np.int32(0)).tobytes() + count.astype(np.int32).tobytes(), 1))
                n = chunk.high - chunk.low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block, np.int64)), batch.column(0).slice(chunk.low, n), batch.column(2).slice(chunk.low, n),
                     pa.array(totals, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names
                )
                size += len(chunk.data)
                if len(code) > BLOCK_WORDS or size > BLOCK_BYTES:
                    yield dictionary(block)
                    code.clear()
                    trained[:] = 0
                    turn, size = turn + 1, 0
        if code:
            yield dictionary(pid << 32 | turn)

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(
        count, f"block long, doc_id {kind}, held_out boolean, n_tokens long, counts binary, word string, local int, trained long"
    )


def piece_scores(words: DataFrame, ends: int, path: str) -> tuple[np.ndarray, float]:
    """Natural logarithms of the probabilities of all pieces and of the end, from ``word`` and ``trained``."""

    def count(batches):
        vocab = vocabulary(path)
        total = np.zeros(vocab.size, np.int64)
        for batch in batches:
            ids = vocab.model.encode(batch.column(0).to_pylist())
            if ids:
                weight = np.repeat(batch.column(1).to_numpy(), [len(i) for i in ids])
                np.add.at(total, np.concatenate([np.array(i, np.int64) for i in ids]), weight)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    found = words.where("trained > 0").select("word", "trained").mapInArrow(count, "piece int, n long")
    counts = np.ones(vocabulary(path).size)
    for row in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[row["piece"]] += row["n"]
    whole = counts.sum() + ends + 1
    return np.log(counts / whole), math.log((ends + 1) / whole)


def score_documents(docs: DataFrame, held_out: Column, path: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document."""
    spark = docs.sparkSession
    table = kept(token_counts(docs, held_out), "counts")
    rows = table.where("n_tokens is not null").select("block", "doc_id", "held_out", "n_tokens", "counts")
    local = table.where("word is not null").select("block", "word", "local", "trained")
    words = kept(local.groupBy("word").agg(F.sum("trained").alias("trained")), "words")
    ends = rows.where(~F.col("held_out")).count()
    sums = words.where("trained > 0").agg(F.sum("trained").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    scores, end_score = piece_scores(words, ends, path)
    shared = spark.sparkContext.broadcast(scores)

    def marginals(batches):
        lattice = Lattice(vocabulary(path), shared.value)
        for batch in batches:
            found = [lattice.marginal(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["word", "trained", "lp"])

    scored = words.mapInArrow(marginals, "word string, trained long, lp double")
    by_block = local.select("block", "word", "local").join(scored, "word").select("block", "local", "trained", "lp")
    bottom = math.log10(tokens + distinct + 1)
    end_base, end_known = math.log10(ends + 1) - bottom, int(ends > 0)
    end_lp = end_score / math.log(10)
    kind = dict(docs.dtypes)["doc_id"]

    def total(documents: pa.Table, dictionary: pa.Table) -> pa.Table:
        at = dictionary.column("local").to_numpy()
        trained, lp = np.zeros(len(at), np.int64), np.zeros(len(at))
        trained[at], lp[at] = dictionary.column("trained").to_numpy(), dictionary.column("lp").to_numpy()
        base = np.log10(trained + 1.0) - bottom
        known, base_score, score = [], [], []
        for packed in documents.column("counts").to_pylist():
            pair = np.frombuffer(zlib.decompress(packed), np.int32)
            n = len(pair) // 2
            local, count = np.cumsum(pair[:n]), pair[n:]
            known.append(int(count[trained[local] > 0].sum()) + end_known)
            base_score.append(float(count @ base[local]) + end_base)
            score.append(float(count @ lp[local]) + end_lp)
        n = len(known)
        return pa.table(
            {"doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"), "n_tokens": documents.column("n_tokens"),
             "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(n, tokens, np.int64)),
             "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())}
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # another name and expression: both sides come from one table
    rows = rows.select((F.col("block") + F.lit(0)).alias("own"), "doc_id", "held_out", "n_tokens", "counts")
    return rows.groupBy("own").cogroup(by_block.groupBy("block")).applyInArrow(total, schema)
