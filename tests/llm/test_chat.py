import random
import re

from pyspark.sql import functions as F

from keelson.llm.chat import END, START, escape, format_paths, linear, paths, read_back, unescape


def all_paths(nodes, branches):
    """Root-to-leaf paths by following parents, best first."""
    by = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in nodes}
    inner = {(t, p) for t, n, p, *_ in nodes}
    found = {}
    for (t, n), _ in by.items():
        if (t, n) in inner:
            continue
        path, seen, at = [], set(), n
        while (t, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = by[t, at][0]
        if at in seen:
            continue
        found.setdefault(t, []).append((-sum(by[t, x][1] for x in path), n, path[::-1]))
    return {(t, n, k + 1): path for t, ps in found.items() for k, (_, n, path) in enumerate(sorted(ps)) if branches is None or k < branches}


def table(spark, nodes):
    return spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")


def test_branches(spark):
    rnd = random.Random(1)
    nodes = []
    for tree in "abc":
        for n in range(1, 30):
            nodes.append((tree, n, rnd.randint(max(1, n - 4), n - 1) if n > 1 else None, rnd.choice(["user", "assistant"]), f"t{n}", float(rnd.randint(0, 3)) if n % 5 else None))
    nodes += [("d", 1, 99, "user", "orphan", 1.0), ("e", 1, 2, "user", "x", 1.0), ("e", 2, 1, "user", "y", 1.0), ("f", 1, None, None, None, None)]
    for branches in (1, 2, None):
        got = {}
        for r in paths(table(spark, nodes), branches).collect():
            got.setdefault((r["tree"], r["leaf"], r["rank"]), []).append((r["depth"], r["node"]))
        assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == all_paths(nodes, branches)


def test_hostile_texts_come_back(spark):
    rnd = random.Random(2)
    parts = ["<|", "|>", "\\", "\n", START, END, "<", "|", "assistant", "é🙂", "<\\|", "<\\n", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", "".join(rnd.choice(parts) for _ in range(3))]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for c in range(20) for t in range(6)]
    rows += [(50, 1, "user", None), (50, None, None, "first"), (50, 2, "assistant", ""), (51, 0, "a", "same"), (51, 0, "a", "same"), (None, 1, "user", "no id")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, node int, tree string")
    nodes = linear(frame.repartition(3)).persist()
    out = {r["tree"]: r for r in read_back(format_paths(nodes, paths(nodes))).collect()}
    assert len(out) == 23
    for conv in {r[0] for r in rows}:
        own = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        r = out["" if conv is None else str(conv)]
        assert list(zip(r["roles"], r["texts"])) == [x[1:] for x in own]
        assert r["loss_texts"] == [text for _, role, text in own if role == "assistant"]
        assert len(re.findall(re.escape(START), r["formatted"])) == len(own) == len(re.findall(re.escape(END), r["formatted"]))


def test_escape_is_reversible(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("<|\\>n\na") for _ in range(rnd.randint(0, 12))),) for _ in range(400)]
    frame = spark.createDataFrame(rows, "t string").select("t", escape(F.col("t")).alias("e")).select("*", unescape(F.col("e")).alias("u"))
    for r in frame.collect():
        assert r["t"] == r["u"] and "<|" not in r["e"]


def test_plan_has_no_python(spark):
    nodes = table(spark, [("a", 1, None, "user", "x", 0.0), ("a", 2, 1, "assistant", "y", 0.0)])
    plan = read_back(format_paths(nodes, paths(nodes)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert paths(nodes.limit(0)).count() == 0
