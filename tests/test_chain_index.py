"""The persisted index of parent links against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.operators import chains as K
from keelson.plans.backup import BackupRequest, Catalog, ChainError, restore_table, run_backup
from keelson.plans.chain_index import ChainIndex
from keelson.session import scratch_path
from test_backup import ITEMS, newest_until
from test_chains import awkward, frame, walk_root  # noqa: F401


def logged(spark, records, order=None):
    """The records as a log, appended in a random order."""
    place = {r[0]: k for k, r in enumerate(order or records)}
    seqs = spark.createDataFrame(list(place.items()), "id string, seq bigint")
    return frame(spark, records).join(seqs, "id")


@pytest.fixture(scope="module")
def built(spark, awkward):  # noqa: F811
    order = list(awkward)
    random.Random(5).shuffle(order)
    log = logged(spark, awkward, order)
    index = ChainIndex(spark, scratch_path(spark, "index"), buckets=3)
    worked = [index.extend(log.filter(F.col("seq") <= cut)) for cut in (700, 700, 10**6)]
    return log, index, worked


def expected_lineage(records):
    by_id = {r[0]: r for r in records}
    out = []
    for r in records:
        kind, _, path = walk_root(r, by_id)
        out += [(r[0], len(path) - 1 - k, spot) for k, spot in enumerate(path)] if kind == "ROOT" else []
    return sorted(out)


def test_lineage_of_all(spark, awkward, built):  # noqa: F811
    _, index, worked = built
    targets = frame(spark, awkward).select(F.col("id").alias("target_id"))
    want = expected_lineage(awkward)
    assert rows(index.lineage(targets), "target_id", "step", "id") == want
    assert worked[1] == 0  # nothing new
    small = index.compact(scratch_path(spark, "index"))
    assert rows(small.lineage(targets), "target_id", "step", "id") == want
    assert (small.state().mark, small.state().last) == (index.state().mark, 1)


def test_ends(spark, awkward, built):  # noqa: F811
    _, index, _ = built
    by_id = {r[0]: r for r in awkward}
    walked = {r[0]: walk_root(r, by_id) for r in awkward}
    targets = frame(spark, awkward).select(F.col("id").alias("target_id"))
    assert rows(index.ends(targets), "target_id", "root", "depth") == sorted((i, end, len(path) - 1) for i, (kind, end, path) in walked.items() if kind == "ROOT")
    assert rows(index.pending(index.state()), "id") == sorted((i,) for i, w in walked.items() if w[0] != "ROOT")


def test_one_target(spark, awkward, built):  # noqa: F811
    log, index, _ = built
    for target in ("s7", "to-x", "n1", "never"):
        verdict, end, lineage = index.resolve_target(log, target)
        full = K.resolve_target(log, target)
        assert (verdict, end) == full[:2] and rows(lineage) == rows(full[2]), target


def test_folders_are_pruned(spark, built):
    _, index, _ = built
    found = index.roots(index.state()).filter((F.col("bucket") == index.bucket(F.lit("h399"))) & (F.col("id") == "h399"))
    held = index.roots(index.state())
    assert 0 < len(found.inputFiles()) <= len(held.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(id,h399)" in plan


def record_of(awkward_record, i, parent):
    out = list(awkward_record)
    out[0], out[4] = i, parent
    return tuple(out)


def test_parents_that_come_late_or_change(spark, awkward):  # noqa: F811
    make = lambda *links: [record_of(awkward[0], i, p) for i, p in links]
    index = ChainIndex(spark, scratch_path(spark, "index"), buckets=2)
    targets = lambda *ids: spark.createDataFrame([(i,) for i in ids], "target_id string")
    first = make(("c", "b"), ("d", "c"))
    index.extend(logged(spark, first))
    assert index.lineage(targets("d")).count() == 0 and rows(index.pending(index.state()), "id") == [("c",), ("d",)]
    second = first + make(("b", "a"), ("a", None), ("e", "d"))
    index.extend(logged(spark, second))
    assert rows(index.lineage(targets("e", "e")), "step", "id") == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    # the same record again changes nothing
    again = logged(spark, second).unionByName(frame(spark, [second[1]]).withColumn("seq", F.lit(50).cast("bigint")))
    index.extend(again)
    assert index.state().first == 1 and index.lineage(targets("e")).count() == 5
    # another parent: the index starts over
    moved = again.unionByName(frame(spark, make(("d", "b"))).withColumn("seq", F.lit(60).cast("bigint")))
    index.extend(moved)
    assert index.state().first > 1
    assert rows(index.lineage(targets("e")), "step", "id") == [(0, "a"), (1, "b"), (2, "d"), (3, "e")]


def test_a_failed_extension_leaves_nothing(spark, awkward, monkeypatch):  # noqa: F811
    index = ChainIndex(spark, scratch_path(spark, "index"), buckets=2)
    log = logged(spark, awkward[:300])

    def fail(*_):
        raise OSError("no more disk")

    with monkeypatch.context() as m:
        m.setattr(ChainIndex, "_write_mark", fail)
        with pytest.raises(OSError):
            index.extend(log)
    assert index.state().mark is None and index.roots(index.state()).count() == 0
    index.extend(log)
    targets = log.select(F.col("id").alias("target_id"))
    assert rows(index.lineage(targets), "target_id", "step", "id") == expected_lineage(awkward[:300])


def test_catalog_with_an_index(spark):
    root = scratch_path(spark, "t")
    catalog = Catalog(spark, f"{root}/catalog", indexed=True)
    for i, kind, parent, cut in [(1, "FULL", None, 10), (2, "INCREMENTAL", "b1", 15), (3, "DIFFERENTIAL", "b2", 21)]:
        request = BackupRequest("db", [ITEMS], cut, root, kind, parent_id=parent, backup_id=f"b{i}")
        run_backup(catalog, request, lambda name, c=cut: newest_until(spark, c))
    assert rows(restore_table(catalog, "b3", ITEMS, root, "db"), "k", "v") == [(1, "a"), (2, "b2"), (4, "d")]
    assert catalog.resolve_target("b3")[:2] == ("OK", "b1")
    with pytest.raises(ChainError, match="not found"):
        catalog.restore_steps("b9")
