"""Runs, chains of real snapshots, restores, storage formats, JDBC, inventory."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.operators import catalog as C
from keelson.operators.replay import fingerprint, multiset_difference, replay, snapshot_diff, union_steps
from keelson.plans.backup import BackupRequest, Catalog, ChainError, cleanup_plan, restore_database, restore_steps, restore_table, run_backup
from keelson.session import scratch_path
from keelson.sources import listing as L
from keelson.sources.framed import write_streams
from keelson.sources import tables as S
from keelson.sources.snapshots import STORE_FORMATS, TrackedTable, load_table, read_snapshots, store_table, write_snapshot

ITEMS = TrackedTable("items", ("k",), "pos", deleted="gone")
CHANGES = TrackedTable("items", ("k",), "pos", deleted="gone", versioned=True)


def changes(spark):
    data = [(1, 1, "a", False), (2, 2, "b", False), (3, 3, "c", False), (2, 11, "b2", False), (4, 12, "d", False), (3, 21, None, True), (1, 22, "a2", False)]
    return spark.createDataFrame(data, "k int, pos bigint, v string, gone boolean")


def newest_until(spark, cut):
    """What a source table holds at a position: one row per key, tombstones included."""
    return changes(spark).filter(F.col("pos") <= cut).groupBy("k").agg(F.max_by(F.struct("pos", "v", "gone"), "pos").alias("r")).select("k", "r.*")


def chain(spark):
    root = scratch_path(spark, "t")
    catalog = Catalog(spark, f"{root}/catalog")
    ask = lambda **kw: BackupRequest("my/db", [ITEMS], root=root, **kw)
    for i, kind, parent, cut in [(1, "FULL", None, 10), (2, "INCREMENTAL", "b1", 15), (3, "DIFFERENTIAL", "b1", 21), (4, "INCREMENTAL", "b3", 30)]:
        run_backup(catalog, ask(cut=cut, backup_type=kind, parent_id=parent, backup_id=f"b{i}"), lambda name, c=cut: newest_until(spark, c))
    return root, catalog, ask


def test_chain_of_runs(spark):
    root, catalog, ask = chain(spark)
    got = {r["id"]: r for r in catalog.current().collect()}
    assert {i: r["status"] for i, r in got.items()} == dict.fromkeys(["b1", "b2", "b3", "b4"], "SUCCESS")
    assert {r["backup_chain_id"] for r in got.values()} == {"b1"}
    assert all(r["file_size_bytes"] > 0 and r["duration_ms"] >= 0 and r["end_time"] for r in got.values())
    assert catalog.log().count() == 8
    state = lambda target: rows(restore_table(catalog, target, ITEMS, root, "my/db"), "k", "v")
    assert state("b1") == [(1, "a"), (2, "b"), (3, "c")]
    assert state("b2") == [(1, "a"), (2, "b2"), (3, "c"), (4, "d")]
    assert state("b3") == [(1, "a"), (2, "b2"), (4, "d")]
    assert state("b4") == [(1, "a2"), (2, "b2"), (4, "d")]
    stored = read_snapshots(spark, root, "my/db", "items", newest_until(spark, 30).schema)
    assert dict(rows(stored.groupBy("backup_id").count())) == {"b1": 3, "b2": 2, "b3": 3, "b4": 1}


def test_cleanup_plan_names_whole_chains(spark):
    root = scratch_path(spark, "clean")
    catalog = Catalog(spark, f"{root}/catalog")
    for n in range(7):
        run_backup(catalog, BackupRequest("db", [ITEMS], 10, root, backup_id=f"f{n}"), lambda name: newest_until(spark, 10))
    plan = cleanup_plan(catalog, "db", datetime(2030, 1, 1))
    uris = [r["uri"] for r in plan.orderBy("uri").collect()]
    assert uris == [f"{root}/db/*/backup_id=f0", f"{root}/db/*/backup_id=f1"]
    assert L.list_objects(spark, uris[0]).filter("path like '%/part-%'").count() > 0
    assert cleanup_plan(catalog, "other", datetime(2030, 1, 1)).count() == 0


def test_restore_into_target_and_selection(spark):
    root, catalog, _ = chain(spark)
    seen = {}
    names = restore_database(catalog, "b2", [ITEMS], root, "my/db", lambda df, n: seen.update({n: df.count()}), selected=["items"])
    assert (names, seen) == (["items"], {"items": 4})
    with pytest.raises(ChainError, match="unknown tables"):
        restore_database(catalog, "b2", [ITEMS], root, "my/db", lambda df, n: None, selected=["other"])


def test_failed_run_is_logged(spark):
    root, catalog, ask = chain(spark)

    def broken(name):
        raise RuntimeError("dump failed")

    with pytest.raises(RuntimeError):
        run_backup(catalog, ask(cut=50, backup_id="b9"), broken)
    row = C.lookup(catalog.current(), "b9").first()
    assert (row["status"], row["error_message"], row["file_size_bytes"]) == ("FAILED", "dump failed", 0)
    with pytest.raises(ChainError, match="cannot be restored"):
        restore_steps(catalog.current(), "b9")


def test_refusals(spark):
    root, catalog, ask = chain(spark)
    with pytest.raises(ChainError, match="differ"):
        run_backup(catalog, ask(cut=40, backup_type="INCREMENTAL", parent_id="b4", selected=("other",)), lambda n: changes(spark))
    with pytest.raises(ChainError, match="not found"):
        run_backup(catalog, ask(cut=40, backup_type="INCREMENTAL", parent_id="nope"), lambda n: changes(spark))
    with pytest.raises(ChainError, match="target backup not found"):
        restore_steps(catalog.current(), "nope")
    lost = catalog.current().filter("id <> 'b1'")
    with pytest.raises(ChainError, match="parent backup not found in chain: b1"):
        restore_steps(lost, "b4")
    looped = catalog.current().withColumn("parent_backup_id", F.when(F.col("id") == "b1", "b4").otherwise(F.col("parent_backup_id")))
    with pytest.raises(ChainError, match="CYCLE"):
        restore_steps(looped, "b4")


def test_compacted_catalog(spark):
    _, catalog, _ = chain(spark)
    small = catalog.compact(scratch_path(spark, "compact"))
    assert small.log().count() == 4
    assert multiset_difference(small.current(), catalog.current()).count() == 0


def test_history_limits(spark):
    _, catalog, _ = chain(spark)
    records = catalog.current()
    assert C.history(records, 2).count() == 2
    assert C.history(records, 0, " ").count() == 4
    assert C.history(records, -1, "my/db").count() == 4
    assert C.history(records, 5, "other").count() == 0
    assert C.lookup(records, "nope").count() == 0


def test_versioned_replay_ties_and_tombstones(spark):
    early = spark.createDataFrame([(1, 5, "x", False), (1, 5, "y", False), (2, 5, "z", True), (2, 4, "q", False)], "k int, pos bigint, v string, gone boolean")
    late = spark.createDataFrame([(3, 1, "w", False)], "k int, pos bigint, v string, gone boolean")
    assert rows(replay(union_steps([early, late]), CHANGES), "k", "v") == [(1, "y"), (3, "w")]


def test_columns_added_later(spark):
    root = scratch_path(spark, "evolve")
    write_snapshot(spark.createDataFrame([(1, 1)], "k int, pos bigint"), root, "d", "items", "b1")
    write_snapshot(spark.createDataFrame([(2, 2, "n")], "k int, pos bigint, v string"), root, "d", "items", "b2")
    assert rows(read_snapshots(spark, root, "d", "items"), "k", "v", "backup_id") == [(1, None, "b1"), (2, "n", "b2")]


def test_lineage_prunes_snapshot_folders(spark):
    root, catalog, _ = chain(spark)
    df = restore_table(catalog, "b2", ITEMS, root, "my/db")
    df.collect()
    assert "dynamicpruning" in df._jdf.queryExecution().toString()


def test_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "n")], "k int, v string")
    assert sorted(map(tuple, snapshot_diff(old, new, ["k"]).collect())) == [(2, "UPDATE", "c"), (4, "INSERT", "n"), (5, "DELETE", None)]


def test_fingerprint_sees_copies(spark):
    one = spark.createDataFrame([(1,), (2,)], "k int")
    two = spark.createDataFrame([(1,), (2,), (2,), (2,)], "k int")
    a, b = fingerprint(one, "t").first(), fingerprint(two, "t").first()
    assert a["rows"] != b["rows"] and a["checksum"] != b["checksum"]
    assert rows(multiset_difference(one, two)) == [(2, -2)]


@pytest.mark.parametrize("fmt", STORE_FORMATS)
def test_formats_keep_values(spark, fmt):
    data = [(1, "", datetime(2024, 1, 1, 1, 2, 3, 456789)), (2, None, None), (3, 'q"uo,te \\ x', datetime(1995, 5, 5))]
    df = spark.createDataFrame(data, "k int, v string, t timestamp_ntz")
    back = load_table(spark, store_table(df, scratch_path(spark, fmt), fmt), df.schema, fmt)
    assert sorted(map(tuple, back.collect())) == data


def test_store_replaces(spark):
    path = scratch_path(spark, "replace")
    store_table(spark.range(5), path)
    store_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_jdbc_round_trip(spark):
    options = {"url": "jdbc:derby:memory:keelson;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("v"), "id").alias("V"))
    S.write_jdbc(df.repartition(3), options, "ITEMS")
    back = S.scan_jdbc(spark, options, "ITEMS", "K", 4)
    assert back.rdd.getNumPartitions() == 4
    assert rows(back) == rows(df)
    assert back.filter("K < 10").count() == 10


def test_jdbc_options():
    o = S.jdbc_options("postgres", "h", None, "d", "u", "p")
    assert o["url"] == "jdbc:postgresql://h:5432/d" and "p" not in o["url"].split("/")[-1:][0][1:]
    assert S.jdbc_options("MySQL", "h", 9, "d", "u", "p")["url"] == "jdbc:mysql://h:9/d"


def test_select_tables():
    assert S.select_tables([], ["a", "b"]) == ["a", "b"]
    assert S.select_tables(["b", "b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        S.select_tables(["z"], ["a"])


def test_filter_and_columns_reach_the_scan(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table = TrackedTable("lineitem", ("l_orderkey",), "l_shipdate")
    df = S.consistent_read(lambda n: lineitem, [table], "1999-01-01")["lineitem"].groupBy("l_shipdate").count()
    plan = df._jdf.queryExecution().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan


def test_tree_listing_is_that_of_the_file_system(spark):
    root = scratch_path(spark, "tree")
    names = ["a", "_a", ".a", "d/b", "d/_hid/c", "d/.x/y/z", "d e/f g", "d/backup_id=b-1/part-0", "d/backup_id=b-1/.part-0.crc", "dd/q"]
    sizes = {f"{name}.enc": n for n, name in enumerate(names)}
    objects = spark.createDataFrame([(name, bytes(n)) for n, name in enumerate(names)], "part string, stream binary")
    assert write_streams(objects, root).count() == len(names)
    base = L.qualified(spark, root) + "/"
    found = lambda df: {r["path"].removeprefix(base): r["length"] for r in df.collect()}
    assert found(L.list_tree(spark, root)) == found(L.list_tree(spark, base)) == sizes
    below = lambda prefix: {k: v for k, v in sizes.items() if k.startswith(prefix)}
    for prefix in ("d", "d/", "d/_", "d/backup_id=b-", "_", "none", "none/x"):
        assert found(L.list_prefix(spark, root, prefix)) == below(prefix)
    assert L.list_tree(spark, f"{root}/none").collect() == []
    assert rows(L.bytes_by_backup(L.list_tree(spark, root))) == [("b-1", 1, 7)]
    # the times are those that Spark's own listing tells
    told = {r["path"].removeprefix(base): r["modified"] for r in L.list_objects(spark, root).collect()}
    mine = {r["path"].removeprefix(base): r["modified"] for r in L.list_tree(spark, root).collect()}
    assert told and all(abs((mine[name] - at).total_seconds()) < 0.002 for name, at in told.items())


def test_listing_sniffing_and_prefix(spark):
    root = scratch_path(spark, "ls")
    store_table(spark.range(3).coalesce(1), f"{root}/b/gz", "json")
    store_table(spark.range(3).coalesce(1), f"{root}/b/raw", "json", compressed=False)
    files = L.list_objects(spark, root).filter("path like '%/part-%'")
    assert files.count() == 2 and files.filter("length > 0").count() == 2
    assert sorted(r["codec"] for r in L.sniff_files(files).collect()) == ["gzip", "raw"]
    assert L.list_prefix(spark, root, "b/g").filter("path like '%/part-%'").count() == 1
    assert L.list_objects(spark, f"{root}/none", missing_ok=True) is None
    assert "content" not in L.list_objects(spark, root)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_codec_of_short_payloads(spark):
    df = spark.createDataFrame([(bytearray(b"\x1f"),), (bytearray(b""),), (bytearray(b"\x1f\x8b\x00"),)], "b binary")
    assert [r[0] for r in df.select(L.codec_of("b")).collect()] == ["raw", "raw", "gzip"]


def test_uris(spark):
    data = ["S3://Bk/a/b", "s3:Bk", "AZURE:box/k", "file:///x/y", "local:z", "c/d", "gs://b/", "ftp://h/x", "", None]
    df = spark.createDataFrame([(u,) for u in data], "uri string")
    got = {r["uri"]: (r["provider"], r["bucket"], r["key"]) for r in L.split_uri(df).collect()}
    assert got == {
        "S3://Bk/a/b": ("s3", "Bk", "a/b"), "s3:Bk": ("s3", "Bk", ""), "AZURE:box/k": ("azure", "box", "k"), "file:///x/y": ("local", None, "/x/y"),
        "local:z": ("local", None, "z"), "c/d": ("local", None, "c/d"), "gs://b/": ("gcs", "b", ""),
    }
    known, unknown = L.classify(df)
    assert [r["uri"] for r in unknown.collect()] == ["ftp://h/x"] and known.count() == 9


def test_own_runs_are_reconciled(spark):
    root = scratch_path(spark, "own")
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    rows_ = spark.range(20).select("id", F.col("id").alias("pos"))
    for backup in ("r1", "r2"):
        run_backup(catalog, BackupRequest("db", [TrackedTable("t", ("id",), "pos")], 100, f"file:{root.removeprefix('file:')}", backup_id=backup), lambda n: rows_)
    records, listed = catalog.current(), L.list_objects(spark, root)
    assert L.missing_objects(records, listed).count() == L.orphan_objects(records, listed).count() == 0
    without = listed.filter("path not like '%backup_id=r1%'")
    assert rows(L.missing_objects(records, without), "id") == [("r1",)]
    stray = listed.limit(1).withColumn("path", F.lit(f"{root}/stray/file"))
    assert L.orphan_objects(records, listed.unionAll(stray)).count() == 1


def test_one_object_in_several_spellings(spark):
    from keelson.functions.text import object_id
    from keelson.operators.retention import object_delete_plan

    same = ["file:///x/shared", "/x/shared", "FILE:/x//shared"], ["s3://b/k", "S3A://b/k", "s3n://b/k"], ["gs:store/k", "gcs://store/k"]
    for group in same:
        got = spark.createDataFrame([(u,) for u in group], "u string").select(object_id("u").alias("o")).distinct()
        assert got.count() == 1
    catalog = spark.createDataFrame([("a", "file:///x/shared"), ("b", "/x/shared"), ("c", "s3://b/k"), ("d", "S3A://b/k")], "id string, destination_uri string")
    doomed = catalog.filter("id in ('a', 'c', 'd')")
    assert rows(object_delete_plan(doomed, catalog)) == [("S3A://b/k", "s3a")]


def test_white_space_and_named_schedules(spark):
    from keelson.functions.text import blank_to_null, decode_tables, normal_cron

    frame = spark.createDataFrame([("\t\n ",), (" a,\tb\n,\t",), ("@Daily",), ("\t5 1 * * *",)], "t string")
    got = frame.select(blank_to_null("t").alias("b"), decode_tables("t").alias("d"), normal_cron("t").alias("c")).collect()
    assert got[0]["b"] is None and got[0]["d"] == [] and got[1]["d"] == ["a", "b"]
    assert [r["c"] for r in got[2:]] == ["0 0 0 * * *", "0 5 1 * * *"]


def test_diff_with_null_keys_and_a_later_column(spark):
    old = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 1, "x"), (3, 3, None)], "k int, v int, w string")
    got = {(r["k"], r["change"]) for r in snapshot_diff(old, new, ["k"]).collect()}
    assert got == {(None, "UPDATE"), (2, "DELETE"), (3, "INSERT")}
    assert snapshot_diff(old, old, ["k"]).count() == 0


def test_replay_of_maps(spark):
    steps = spark.createDataFrame([(0, 1, 1, {"a": 1}), (1, 1, 2, {"b": 2}), (1, 1, 2, {"a": 9})], "step long, id int, pos int, m map<string,int>")
    got = replay(steps, TrackedTable("t", ("id",), "pos")).collect()
    assert [(r["id"], r["m"]) for r in got] == [(1, {"b": 2})]


def test_child_of_a_failed_run_goes_on_from_the_last_good_step(spark):
    root, catalog = scratch_path(spark, "failed"), Catalog(spark, scratch_path(spark, "catalog"))
    rows_ = spark.range(1, 41).select("id", F.col("id").alias("pos"))
    table = TrackedTable("t", ("id",), "pos")
    ask = lambda **k: BackupRequest("db", [table], root=root, **k)
    run_backup(catalog, ask(cut=10, backup_id="f"), lambda n: rows_)
    with pytest.raises(RuntimeError):
        run_backup(catalog, ask(cut=20, backup_id="bad", backup_type="INCREMENTAL", parent_id="f"), lambda n: (_ for _ in ()).throw(RuntimeError("gone")))
    record = run_backup(catalog, ask(cut=30, backup_id="next", backup_type="INCREMENTAL", parent_id="bad"), lambda n: rows_)
    assert record["parent_backup_id"] == "f"
    assert restore_table(catalog, "next", table, root, "db").count() == 30
