"""Chat formatting of reply trees, with DataFrame functions only.

A tree is rows (tree, node, parent, role, text, score). ``paths`` finds all root-to-leaf paths by iterated self-joins: each
round doubles how far a node's pointer reaches, so a path of n replies takes log2(n) rounds. Branches are ranked by the sum
of their scores and the best ones kept; their nodes are listed by the same pointers, longest first. ``format_paths`` writes
each path as one conversation.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled, ``<|`` becomes
``<\\|``, and in roles a line break becomes ``<\\n``; ``unescape`` is the exact inverse, and no text can hold a mark.
The loss mask is one (turn, begin, length) range per assistant turn, counted in characters from the turn's first.

Defined results: a null text or role is empty, a null score 0. A parent that is not in the tree makes a root. Nodes on a
cycle of parents have no root and are on no path. Rows with equal (tree, node) must not occur: ``linear`` numbers rows, so
repeated rows of a conversation are turns of their own. A conversation is one row of the result and must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.store import kept, kept_counted
from keelson.plans.scans import running_rank

START = "<|im_start|>"
END = "<|im_end|>"


def _put(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _put(_put(c, "\\", "\\\\"), "<|", "<\\|")


def unescape(c: Column) -> Column:
    return _put(_put(c, "<\\|", "<|"), "\\\\", "\\")


def escape_role(c: Column) -> Column:
    return _put(escape(c), "\n", "<\\n")


def unescape_role(c: Column) -> Column:
    return unescape(_put(c, "<\\n", "\n"))


def linear(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` as trees without branches: each turn replies to the one before.

    Rows are ordered by turn (nulls first), then role and text. Rows without ``conv_id`` are one conversation.
    """
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    ranked = running_rank(named, ["tree"], order, "node").withColumn("node", F.col("node").cast("long"))
    return ranked.select(
        "tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree``, ``leaf``, ``rank`` (from 1, best score first, ties to the smaller leaf), ``node``, ``depth`` of the
    ``branches`` best paths of each tree, or of all."""
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    # pointer: the ancestor ``hops`` above; total: the scores from the node up to below the pointer
    state = links.join(there, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("found"), F.col("parent")).alias("pointer"),
        F.lit(1).cast("long").alias("hops"), F.col("score").alias("total"),
    )
    state, seen = kept_counted(state, "jumps", active=F.count("pointer"), rows=F.count(F.lit(1)))
    jumps, rows = [], seen["rows"]
    while seen["active"] and 1 << len(jumps) <= rows:
        jumps.append(state.where("pointer is not null").select("tree", "node", "pointer"))
        above = state.select(
            "tree", F.col("node").alias("pointer"), F.col("pointer").alias("_pointer"), F.col("hops").alias("_hops"), F.col("total").alias("_total")
        )
        active = state.where("pointer is not null").join(above, ["tree", "pointer"]).select(
            "tree", "node", F.col("_pointer").alias("pointer"), F.col("hops") + F.col("_hops"), F.col("total") + F.col("_total")
        )
        state, seen = kept_counted(state.where("pointer is null").union(active), "jumps", active=F.count("pointer"))
    ended = state.where("pointer is null").select("tree", "node", F.col("hops").alias("depth"), "total")
    leaves = ended.join(links.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("node").asc())
    chosen = leaves.select("tree", F.col("node").alias("leaf"), F.row_number().over(order).alias("rank"))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= F.lit(branches))
    found = kept(chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node")), "paths")
    for jump in reversed(jumps):
        further = found.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("pointer").alias("node"))
        found = kept(found.union(further), "paths")
    return found.join(ended.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``rank``, ``formatted`` and ``loss`` of each path."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth",
        F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("segment"),
        F.when(
            F.col("role") == "assistant",
            F.struct((F.length(role) + len(START) + 1).cast("long").alias("begin"), F.length(text).cast("long").alias("length")),
        ).alias("mask"),
    )
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "segment", "mask"))).alias("turns"))
    loss = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.when(
                t["mask"].isNotNull(),
                F.struct(i.cast("long").alias("turn"), t["mask"]["begin"].alias("begin"), t["mask"]["length"].alias("length")),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``segments`` (a turn's text from the mark on), ``roles``, ``texts`` and ``loss_texts``, parsed from the output."""
    rows = formatted.withColumn("segments", F.filter(F.split("formatted", r"<\|im_start\|>"), lambda s: s != ""))
    skip = len(START)

    def text_of(s: Column) -> Column:
        begin = F.instr(s, "\n") + 1
        return unescape(F.substring(s, begin, F.length(s) - begin + 1 - len(END) - 1))

    return rows.select(
        "*",
        F.transform("segments", lambda s: unescape_role(F.substring_index(s, "\n", 1))).alias("roles"),
        F.transform("segments", text_of).alias("texts"),
        F.transform(
            "loss", lambda m: unescape(F.substring(F.get(F.col("segments"), m["turn"]), m["begin"] - skip + 1, m["length"]))
        ).alias("loss_texts"),
    )
