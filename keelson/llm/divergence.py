"""How far the sources of a language are from each other, and which terms set a source apart.

Terms are runs of ASCII letters and characters from U+0080 on, with A-Z lower-cased; a language keeps those found in at least
``min_docs`` of its documents. In a group (language, source) a kept term with count c has the price
p = 1 + floor(scale * (c + 1) / (N + V)): N counts the kept terms of the group, V the kept terms of the language. The divergence
of two prices is floor((p - q)^2 / q); that of two groups is the sum over all kept terms, also those that neither group holds.

One-hot level products: within a group the price depends on the count alone, and most terms share a few counts. So the terms
of a language are cut into blocks, and a block becomes an indicator matrix X with a row per term and a column per (group, count
level), level 0 included. X^T X is the joint table of every two groups: how many terms have level a in one and b in the other.
Each entry is priced once and weighed by its number of terms. Within a block, terms are taken in order of their total
count, so that rows with like counts share columns, and a product is made when ``columns`` is reached. Products hold at most
``rows`` and so are exact in float32; prices and sums are exact integers. A language with more groups than a ``tile`` is done
tile by tile. Terms that no group of two tiles holds are counted, and added as level 0 with level 0.

Null text, language and source are ''. Texts are counted whole; a repeated row is a document of its own. A group without terms
is a group; a language without kept terms gives 0 for its pairs; an empty table gives no row. Only the three columns named are
read, so others may have any name. Ties are ranked by the item's UTF-8 bytes. Sums stay below 2**63 while a language keeps fewer
than 2**31 terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.store import kept
from keelson.llm.text import LOWER, chunks, tidy
from keelson.plans.scans import running_rank, top_per_key

SCALE = 1_000_000_000
#: Bytes of text whose terms are counted together before they leave a task.
COUNT_BYTES = 4 << 20
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of a chunk in order, and the index of each document's first term (one more entry at the end)."""
    n = len(data)
    inside = TERM_BYTE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    open_, close = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1] | cut[1:n]
    close[:-1] &= ~inside[1:] | cut[1:n]
    begin, end = np.flatnonzero(open_), np.flatnonzero(close) + 1
    where = np.append(0, np.cumsum(end - begin))
    letters = LOWER[data[inside]]
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(where.astype(np.int64)), pa.py_buffer(letters))
    return terms, np.searchsorted(begin, offsets)


def term_counts(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, ``term``, ``n`` occurrences and ``docs`` documents, counted per run of texts; sums of equal rows are the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(k) for k in range(1, 1 + len(keys))], keys)
            for chunk in chunks(batch.column(0), COUNT_BYTES):
                terms, first = terms_of(chunk.data, chunk.offsets)
                if not len(terms):
                    continue
                found = terms.dictionary_encode()
                code = found.indices.to_numpy().astype(np.int64)
                size = len(found.dictionary)
                doc = np.repeat(np.arange(chunk.high - chunk.low), np.diff(first))
                in_doc, times = np.unique(doc * size + code, return_counts=True)
                own = [tuple(g.values()) for g in groups[chunk.low : chunk.high].to_pylist()]
                names = {g: k for k, g in enumerate(dict.fromkeys(own))}
                group = np.array([names[g] for g in own], np.int64)
                entry, back = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
                held = list(names)
                columns = [pa.array([g[k] for g in held], pa.string()).take(pa.array(entry // size)) for k in range(len(keys))]
                n = np.bincount(back, times, len(entry)).astype(np.int64)
                columns += [found.dictionary.take(pa.array(entry % size)).cast(pa.string()), pa.array(n), pa.array(np.bincount(back, minlength=len(entry)))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "term", "n", "docs"])

    schema = ", ".join(f"{k} string" for k in keys) + ", term string, n long, docs long"
    return docs.select(text, *keys).mapInArrow(tidy(count), schema)


def price(count: str, total: str, kept_terms: str = "vocab", scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + kept terms)), exact beyond 64 bits."""
    return F.expr(f"1 + cast(cast({scale} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0)) div cast({total} + {kept_terms} as decimal(20, 0)) as bigint)")


def prices(counts: np.ndarray, total: int, kept_terms: int, scale: int) -> np.ndarray:
    return np.array([1 + scale * (int(c) + 1) // (total + kept_terms) for c in counts], np.int64)


def joint_sums(groups: list[tuple[int, int, int]], term: np.ndarray, group: np.ndarray, level: np.ndarray, scale: int, rows: int, columns: int):
    """Summed divergence of every two groups over the terms of a block.

    ``groups`` are (index, N, V); ``term``, ``group`` (a place in ``groups``) and ``level`` are the block's entries, terms numbered from
    0 in the order in which they are to be taken. Gives the matrix of sums, first index p, second q, and the number of terms.
    """
    size = len(groups)
    sums = np.zeros((size, size), np.int64)
    order = np.argsort(term, kind="stable")
    term, group, level = term[order], group[order], level[order]
    terms = int(term[-1]) + 1 if len(term) else 0
    first = np.searchsorted(term, np.arange(terms + 1))
    low = 0
    while low < terms:
        high, seen = low, {(g, 0) for g in range(size)}
        while high < terms and high - low < rows:
            more = set(zip(group[first[high] : first[high + 1]].tolist(), level[first[high] : first[high + 1]].tolist())) | seen
            if len(more) > columns and high > low:
                break
            seen, high = more, high + 1
        heads = sorted(seen)
        place = {c: k for k, c in enumerate(heads)}
        part = slice(first[low], first[high])
        x = np.zeros((high - low, len(heads)), np.float32)
        starts = np.searchsorted([g for g, _ in heads], np.arange(size))
        x[:, starts] = 1
        x[term[part] - low, starts[group[part]]] = 0
        x[term[part] - low, [place[c] for c in zip(group[part].tolist(), level[part].tolist())]] = 1
        joint = (x.T @ x).astype(np.int64)
        p = np.concatenate([prices([c for h, c in heads if h == g], n, v, scale) for g, (_, n, v) in enumerate(groups)])
        away = p[:, None] - p[None, :]
        joint *= away * away // p[None, :]
        sums += np.add.reduceat(np.add.reduceat(joint, starts, axis=0), starts, axis=1)
        low = high
    return sums, terms


def kept_entries(docs: DataFrame, text: str, lang: str, source: str, min_docs: int) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` of kept terms, with ``lang_n``, the term's count in the language, and ``lead``, true once per
    language and term."""
    named = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))])
    counts = term_counts(named, "text", ["lang", "source"]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has one row per source by now
    term = Window.partitionBy("lang", "term")
    whole = counts.select("*", F.sum("docs").over(term).alias("_docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    return whole.where(F.col("_docs") >= min_docs).drop("_docs", "docs")


def group_sizes(docs: DataFrame, entries: DataFrame, lang: str, source: str) -> DataFrame:
    """Every occurring (``lang``, ``source``): ``total`` (N), ``vocab`` (V), ``lang_total``, and ``at``, its place among the language's sources from 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    occurring = docs.select(text(lang).alias("lang"), text(source).alias("source")).distinct()
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("_lead"))
    both = occurring.join(held, ["lang", "source"], "left")
    totals = both.groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("_lead"), F.lit(0)).alias("vocab"), F.count(F.lit(1)).alias("sources"))
    sized = both.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).join(totals, "lang")
    return kept(running_rank(kept(sized, "groups"), ["lang"], [F.col("source")], "at"), "groups")


def pair_divergence(entries: DataFrame, groups: DataFrame, scale: int = SCALE, block_terms: int = 8192, tile: int = 64, rows: int = 4096, columns: int = 768) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language) and ``value``, summed over all kept terms."""
    sides = groups.select("lang", "source", (F.col("at") - 1).alias("g"), "total", "vocab", "sources", F.ceil(F.greatest(F.col("vocab"), F.lit(1)) / block_terms).alias("blocks"))
    # every block knows the groups of its tiles, also those that hold none of its terms
    heads = sides.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.select("lang", "block", "g", "sources", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), F.col("vocab").alias("lang_n"))
    held = entries.join(sides.select("lang", "source", "g", "sources", "blocks"), ["lang", "source"])
    held = held.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "g", "sources", "term", "n", "lang_n")
    own = F.floor(F.col("g") / tile)
    others = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / tile))
    dealt = heads.unionByName(held).withColumn("t", F.explode(others)).select(
        "lang", "block", F.least("t", own).alias("t1"), F.greatest("t", own).alias("t2"), "g", "term", "n", "lang_n"
    )

    def multiply(part: pa.Table) -> pa.Table:
        tiles = (part.column("t1")[0].as_py(), part.column("t2")[0].as_py())
        head = part.filter(pc.is_null(part.column("term"))).sort_by("g")
        body = part.filter(pc.is_valid(part.column("term")))
        index = head.column("g").to_numpy()
        params = list(zip(index.tolist(), head.column("n").to_pylist(), head.column("lang_n").to_pylist()))
        found = pc.dictionary_encode(body.column("term").combine_chunks())
        code = found.indices.to_numpy() if len(body) else np.zeros(0, np.int64)
        # terms in order of their count in the language
        total = np.zeros(len(found.dictionary) if len(body) else 0, np.int64)
        total[code] = body.column("lang_n").to_numpy()
        turn = np.empty(len(total), np.int64)
        turn[np.argsort(total, kind="stable")] = np.arange(len(total))
        if params[0][2]:
            sums, terms = joint_sums(params, turn[code], np.searchsorted(index, body.column("g").to_numpy()), body.column("n").to_numpy(), scale, rows, columns)
        else:
            sums, terms = np.zeros((len(params), len(params)), np.int64), 0
        a, b = np.meshgrid(np.arange(len(params)), np.arange(len(params)), indexing="ij")
        # a pair within one tile belongs to that tile's own block
        of = index // tile
        wanted = (a != b) & ((of[a] != of[b]) | (tiles[0] == tiles[1]))
        a, b = a[wanted], b[wanted]
        return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(a), pa.string()), "g": index[a], "other": index[b], "value": sums[a, b], "terms": np.full(len(a), terms, np.int64)})

    summed = dealt.groupBy("lang", "block", "t1", "t2").applyInArrow(multiply, "lang string, g long, other long, value long, terms long")
    summed = summed.groupBy("lang", "g", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    p = sides.select("lang", "g", "source", "vocab", F.when(F.col("vocab") > 0, price("0", "total", scale=scale)).alias("p0"))
    q = p.select("lang", F.col("g").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    nowhere = (F.col("vocab") - F.col("terms")) * F.expr("(p0 - q0) * (p0 - q0) div q0")
    return summed.join(p, ["lang", "g"]).join(q, ["lang", "other"]).select("lang", "source", "item", (F.col("value") + F.coalesce(nowhere, F.lit(0))).alias("value"))


def term_divergence(entries: DataFrame, groups: DataFrame, scale: int = SCALE) -> DataFrame:
    """``lang``, ``source``, ``item`` (a term of the group that is more frequent there than in the language) and ``value``."""
    joined = entries.join(groups.select("lang", "source", "total", "vocab", "lang_total"), ["lang", "source"])
    priced = joined.select("lang", "source", F.col("term").alias("item"), price("n", "total", scale=scale).alias("p"), price("lang_n", "lang_total", scale=scale).alias("q"))
    return priced.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top_terms: int = 200, scale: int = SCALE, **blocks: int) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value`` and ``rank``: all other sources of the language by their distance, and
    the first ``top_terms`` terms."""
    entries = kept(kept_entries(docs, text, lang, source, min_docs), "entries")
    groups = group_sizes(docs, entries, lang, source)
    order = [F.col("value").desc(), F.col("item").asc()]
    pairs = running_rank(kept(pair_divergence(entries, groups, scale, **blocks), "pairs"), ["lang", "source"], order).withColumn("part", F.lit("pair"))
    terms = top_per_key(term_divergence(entries, groups, scale), ["lang", "source"], order, top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).union(terms.select(*columns))
