"""Encrypted runs: sealed chains, what is written, and what a restore finds before it replays."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.plans.backup import BackupRequest, Catalog, ChainError, damage_report, restore_database, restore_table, run_backup
from keelson.session import scratch_path
from keelson.sources import sealed as S
from keelson.sources.snapshots import TrackedTable

ITEMS = TrackedTable("items", ("k",), "pos", deleted="gone")
OTHER = TrackedTable("other", ("k",), "pos")
WORD = "open sesame"
SECRET = "needle-in-the-rows"


def items(spark, cut):
    n = 4000
    base = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 50).alias("pos"), F.concat(F.lit(SECRET), F.col("id")).alias("v"), F.lit(False).alias("gone"))
    return base.filter(F.col("pos") <= cut).repartition(3)


def source(spark, cut):
    def read(name):
        rows_ = items(spark, cut)
        # a column that later steps add
        return rows_.withColumn("extra", F.lit(cut).cast("int")) if cut > 20 else rows_

    return read


def sealed_chain(spark, passwords=(WORD,) * 5, tables=(ITEMS,), **options):
    root = scratch_path(spark, "sealed")
    catalog = Catalog(spark, f"{root}/catalog")
    steps = [(1, "FULL", None, 10), (2, "INCREMENTAL", "b1", 15), (3, "DIFFERENTIAL", "b1", 30), (4, "INCREMENTAL", "b3", 40), (5, "INCREMENTAL", "b4", 60)]
    for (i, kind, parent, cut), word in zip(steps, passwords):
        request = BackupRequest("my/db", list(tables), cut, root, kind, parent_id=parent, backup_id=f"b{i}", passphrase=word, segment_bytes=4000, **options)
        assert word is None or word not in repr(request)
        run_backup(catalog, request, source(spark, cut))
    return root, catalog


def expected(spark):
    return sorted((r["k"], r["pos"], r["v"]) for r in items(spark, 60).collect())


def files_below(root):
    return [f for f in glob.glob(f"{root}/**", recursive=True, include_hidden=True) if os.path.isfile(f)]


def rewrite(spark, path, change):
    """Replace a folder's rows by changed ones."""
    held = spark.read.parquet(path)
    data, schema = [r.asDict() for r in held.collect()], held.schema
    spark.createDataFrame(change(data), schema).write.mode("overwrite").parquet(path)


@pytest.fixture(scope="module")
def chain(spark):
    return sealed_chain(spark)


def restored(catalog, root, word=WORD):
    return restore_table(catalog, "b5", ITEMS, root, "my/db", passphrase=word)


def test_a_sealed_chain_is_restored(spark, chain):
    root, catalog = chain
    out = restored(catalog, root)
    assert rows(out, "k", "pos", "v") == expected(spark)
    late = {r["extra"]: r["count"] for r in out.groupBy("extra").count().collect()}
    assert set(late) == {None, 30, 40, 60}
    assert {r["id"]: r["sealed"] for r in catalog.with_positions().collect()} == {f"b{i}": True for i in range(1, 6)}
    assert all(r["file_size_bytes"] > 0 for r in catalog.current().collect())
    assert damage_report(catalog, "b5", "items", root, "my/db", WORD).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_nothing_plain_is_written(spark, compressed):
    root, catalog = sealed_chain(spark, (WORD,), compressed=compressed)
    found = files_below(root)
    assert any("@sealed" in f for f in found) and any("@manifest" in f for f in found)
    assert not any("/items/" in f for f in found)
    for f in found:
        with open(f, "rb") as data:
            held = data.read()
        assert SECRET.encode() not in held and WORD.encode() not in held, f


def test_ivs_are_new_for_every_segment(spark, chain):
    root, _ = chain
    segments = S.read_segments(spark, root, "my/db", "items")
    counted = segments.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("payload", 1, 12)).alias("ivs")).first()
    assert counted["n"] == counted["ivs"] > 20


def test_wrong_or_no_passphrase(spark, chain):
    root, catalog = chain
    with pytest.raises(S.SealError, match="seals that do not hold"):
        restored(catalog, root, "wrong")
    for word in (None, " "):
        with pytest.raises(S.SealError, match="need a passphrase: b1, b3, b4, b5"):
            restored(catalog, root, word)


def test_plain_and_sealed_steps_in_one_chain(spark):
    root, catalog = sealed_chain(spark, (None, WORD, WORD, None, WORD))
    assert rows(restored(catalog, root), "k", "pos", "v") == expected(spark)


def test_a_flipped_byte_is_named(spark):
    root, catalog = sealed_chain(spark)

    def flip(data):
        hit = next(r for r in data if (r["part"], r["segment_index"]) == (1, 2))
        changed = bytearray(hit["payload"])
        changed[len(changed) // 2] ^= 1
        hit["payload"] = changed
        return data

    rewrite(spark, f"{root}/my_db/items@sealed/backup_id=b3", flip)
    assert rows(damage_report(catalog, "b5", "items", root, "my/db", WORD)) == [("b3", 1, 2)]
    with pytest.raises(Exception, match="segment does not open: b3/items/1/2"):
        restored(catalog, root).collect()


def swap(data):
    a, b = [r for r in data if r["part"] == 0][:2]
    a["payload"], b["payload"] = b["payload"], a["payload"]
    return data


def test_swapped_segments_do_not_open(spark):
    root, catalog = sealed_chain(spark, (WORD,))
    rewrite(spark, f"{root}/my_db/items@sealed/backup_id=b1", swap)
    assert damage_report(catalog, "b1", "items", root, "my/db", WORD).count() == 2


@pytest.mark.parametrize(
    "folder, change, message",
    [
        ("items@sealed", lambda data: [r for r in data if (r["part"], r["segment_index"]) != (1, 3)], "missing segments: b1/1/3"),
        ("items@sealed", lambda data: [r for r in data if r["part"] != 2], "missing segments: b1/2/0, "),
        ("@manifest", lambda data: [r for r in data if r["part"] != 1], "parts that the manifest counts but does not list: b1/3/2"),
        ("@manifest", lambda data: [r for r in data if r["table_name"] != "items"], "tables that the manifest counts but does not list: b1/1/0"),
        ("@manifest", lambda data: [{**r, "segments": r["segments"] - (r["part"] == 0)} for r in data], "seals that do not hold .*: b1/items/0"),
        ("@manifest", lambda data: [{**r, "table_schema": r["table_schema"] and r["table_schema"].replace("pos", "sop")} for r in data], "seals that do not hold"),
        ("@manifest", lambda data: [], "no manifest for backups: b1"),
    ],
)
def test_losses_are_found_before_replay(spark, folder, change, message):
    root, catalog = sealed_chain(spark, (WORD,))
    rewrite(spark, f"{root}/my_db/{folder}/backup_id=b1", change)
    with pytest.raises(S.SealError, match=message):
        restore_table(catalog, "b1", ITEMS, root, "my/db", passphrase=WORD)


def test_several_tables_and_selection(spark):
    root, catalog = sealed_chain(spark, (WORD, WORD), (ITEMS, OTHER))
    seen = {}
    restore_database(catalog, "b2", [ITEMS, OTHER], root, "my/db", lambda df, n: seen.update({n: df.count()}), ["other"], WORD)
    assert seen == {"other": items(spark, 15).count()}


def test_empty_table_and_failed_run(spark):
    root = scratch_path(spark, "sealed")
    catalog = Catalog(spark, f"{root}/catalog")
    run_backup(catalog, BackupRequest("db", [ITEMS], -1, root, backup_id="b1", passphrase=WORD), source(spark, 15))
    assert restore_table(catalog, "b1", ITEMS, root, "db", passphrase=WORD).count() == 0

    def broken(name):
        return items(spark, 15).withColumn("v", F.raise_error(F.lit("disk on fire")))

    with pytest.raises(Exception, match="disk on fire"):
        run_backup(catalog, BackupRequest("db", [ITEMS], 10, root, backup_id="b2", passphrase=WORD), broken)
    assert rows(catalog.current().filter("status = 'FAILED'"), "id") == [("b2",)]
    with pytest.raises(ChainError, match="NOT_SUCCESSFUL"):
        restore_table(catalog, "b2", ITEMS, root, "db", passphrase=WORD)
