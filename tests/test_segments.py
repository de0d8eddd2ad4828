"""Segments, stream files, and what is reported when they are damaged."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keelson.functions import crypto
from keelson.operators import segments as E
from keelson.session import materialise, scratch_path
from keelson.sources import framed

TEXT = b"Hello, segmented world of backups! 0123456"


def payloads(spark, *data):
    rows_ = [("b", i, bytearray(d)) for i, d in enumerate(data)]
    return spark.createDataFrame(rows_, "backup_id string, part bigint, payload binary")


def test_split_edges(spark):
    got = E.split_payload(payloads(spark, b"", b"abc", b"abcd", b"abcde"), size=4)
    assert rows(got, "part", "segment_index", "payload") == [(1, 0, b"abc"), (2, 0, b"abcd"), (3, 0, b"abcd"), (3, 1, b"e")]
    with pytest.raises(ValueError):
        E.split_payload(payloads(spark, b"x"), size=0)


@pytest.fixture(scope="module")
def sealed(spark):
    key = crypto.backup_keys(spark, "secret", {"b": b"s" * 16})
    plain = E.split_payload(payloads(spark, TEXT, b"\x00\xff" * 50), size=10)
    return key, materialise(E.encrypt_segments(plain, key), "sealed")


def test_round_trip(spark, sealed):
    key, segments = sealed
    good, bad = E.decrypt_segments(segments, key)
    assert bad.count() == 0
    assert rows(E.reassemble(good), "part", "payload") == [(0, TEXT), (1, b"\x00\xff" * 50)]
    assert segments.select(F.sum(F.octet_length("payload"))).first()[0] == len(TEXT) + 100 + 28 * segments.count()


def test_wrong_key_swap_and_flip(spark, sealed):
    key, segments = sealed
    assert E.decrypt_segments(segments, crypto.backup_keys(spark, "other", {"b": b"s" * 16}))[0].count() == 0
    swapped = segments.withColumn("segment_index", F.when(F.col("part") == 0, 1 - F.col("segment_index")).otherwise(F.col("segment_index")))
    assert rows(E.decrypt_segments(swapped.filter("part = 0 and segment_index in (0, 1)"), key)[1], "segment_index") == [(0,), (1,)]
    last = F.substring(F.col("payload"), -1, 1)
    flip = F.when(last == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    flipped = segments.withColumn("payload", F.concat(F.expr("substring(payload, 1, octet_length(payload) - 1)"), flip))
    assert E.decrypt_segments(flipped, key)[0].count() == 0


def test_every_iv_is_used_once(spark, sealed):
    _, segments = sealed
    ivs = segments.select(F.hex(F.substring("payload", 1, 12)).alias("iv"))
    assert ivs.distinct().count() == ivs.count()


def test_parts_beyond_32_bits_and_two_backups(spark):
    keys = crypto.backup_keys(spark, "secret", {"b": b"s" * 16, "c": b"t" * 16})
    data = [(b, p, 0, bytearray(b"same")) for b in "bc" for p in (1, 1 + 2**32, -1)]
    plain = spark.createDataFrame(data, "backup_id string, part bigint, segment_index bigint, payload binary")
    sealed = E.encrypt_segments(plain, keys)
    got = sealed.select("backup_id", F.hex(F.substring("payload", 1, 12)).alias("iv")).collect()
    assert len({(r["backup_id"], r["iv"]) for r in got}) == 6
    with pytest.raises(ValueError):
        crypto.backup_keys(spark, "secret", {"b": b"s" * 16, "c": b"s" * 16})
    with pytest.raises(Exception, match="out of range"):
        E.encrypt_segments(plain.withColumn("segment_index", F.lit(2**32)), keys).collect()
    with pytest.raises(Exception, match="no key"):
        E.encrypt_segments(plain.withColumn("backup_id", F.lit("unknown")), keys).collect()


def test_no_plan_shows_the_key(spark, sealed):
    keys, segments = sealed
    secret = crypto.derive_key("secret", b"s" * 16)
    for df in (E.encrypt_segments(segments, keys), E.decrypt_segments(segments, keys)[0], E.frame_stream(payloads(spark, TEXT), keys, 10)):
        text = df._jdf.queryExecution().toString().lower()
        assert secret.hex() not in text and "[b@" not in text and str(list(secret))[1:20] not in text


def test_empty_parts_come_back(spark, sealed):
    keys, segments = sealed
    named = payloads(spark, b"", b"", b"")
    assert rows(E.reassemble(E.decrypt_segments(segments, keys)[0], named), "part", "payload") == [(0, TEXT), (1, b"\x00\xff" * 50), (2, b"")]


def test_segment_iv_formula(spark):
    base = bytes(range(12))
    got = spark.range(1).select(*[crypto.segment_iv(F.lit(base), F.lit(i)) for i in (0, 1, 256, 70000)]).first()
    want = [base[:8] + bytes(a ^ b for a, b in zip(base[8:], i.to_bytes(4, "big"))) for i in (0, 1, 256, 70000)]
    assert [bytes(v) for v in got] == want


def test_key_derivation():
    assert crypto.derive_key("p", b"s" * 16) == hashlib.pbkdf2_hmac("sha256", b"p", b"s" * 16, 65536, 32)


def test_int32(spark):
    got = spark.range(1).select(*[crypto.int32_value(crypto.int32_bytes(F.lit(v))) for v in (0, 7, -1, 2**31 - 1, -(2**31))]).first()
    assert list(got) == [0, 7, -1, 2**31 - 1, -(2**31)]


def test_truncation_report(spark):
    expected = spark.createDataFrame([("b", 0, 3), ("b", 1, 2), ("b", 2, 0), ("b", 3, 2)], "backup_id string, part bigint, segments bigint")
    present = spark.createDataFrame([("b", 0, 0), ("b", 0, 2), ("b", 1, 0), ("b", 1, 1)], "backup_id string, part bigint, segment_index bigint")
    assert rows(E.truncation_report(expected, present)) == [("b", 0, 1), ("b", 3, 0), ("b", 3, 1)]


def test_whole_table(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("d"))
    packed = materialise(E.pack_table(df.repartition(3), "b", size=20_000), "packed")
    assert packed.count() > 3 and packed.select(F.sum("row_count")).first()[0] == 5000
    assert packed.select(*E.PLACE).distinct().count() == packed.count()
    key = crypto.backup_keys(spark, "secret", {"b": b"t" * 16})
    good, bad = E.decrypt_segments(materialise(E.encrypt_segments(packed, key), "s"), key)
    assert bad.count() == 0
    assert rows(E.unpack_table(good, df.schema)) == rows(df)


def stream_files(spark, size=10, change=None):
    keys = crypto.backup_keys(spark, "secret", {"b": b"0123456789abcdef"})
    streams = E.frame_stream(payloads(spark, TEXT, b"", b"z" * 25), keys, size)
    if change is not None:
        streams = streams.withColumn("stream", change)
    written = materialise(framed.write_streams(streams, scratch_path(spark, "f")), "w")
    return written.withColumnRenamed("bytes", "length")


def reports(files):
    got = framed.file_report(files, framed.scan_frames(files))
    return {r["path"].rsplit("/", 1)[1][0]: (r["report"], r["segments"]) for r in got.collect()}


def test_stream_files(spark):
    files = stream_files(spark)
    assert reports(files) == {"0": ("OK", 5), "1": ("OK", 0), "2": ("OK", 3)}
    sizes = {r["path"].rsplit("/", 1)[1][0]: r["length"] for r in files.collect()}
    assert sizes == {"0": 32 + len(TEXT) + 5 * 20 + 4, "1": 36, "2": 32 + 25 + 3 * 20 + 4}
    frames = framed.scan_frames(files)
    for passphrase, readable in (("secret", True), ("wrong", False)):
        segments = framed.read_segments(frames, spread=4).join(framed.keys_by_salt(frames, passphrase), "salt")
        good, bad = framed.decrypt_stream_segments(segments, F.col("key"))
        assert (good.count(), bad.count()) == ((8, 0) if readable else (0, 8))
        if readable:
            parts = good.select(F.lit("b").alias("backup_id"), F.regexp_extract("path", r"(\d)\.enc", 1).alias("part"), "segment_index", "payload")
            assert rows(E.reassemble(parts), "part", "payload") == [("0", TEXT), ("2", b"z" * 25)]


def test_damaged_stream_files(spark):
    cut = F.expr("substring(stream, 1, octet_length(stream) - 4)")
    assert reports(stream_files(spark, change=cut)) == {"0": ("TRUNCATED", 5), "1": ("TRUNCATED", 0), "2": ("TRUNCATED", 3)}
    short = F.expr("substring(stream, 1, octet_length(stream) - 9)")
    assert reports(stream_files(spark, change=short))["0"] == ("TRUNCATED", 4)
    magic = F.concat(F.unhex(F.lit("00")), F.col("stream"))
    assert {v[0] for v in reports(stream_files(spark, change=magic)).values()} == {"INVALID"}
    negative = F.concat(F.substring("stream", 1, 32), F.unhex(F.lit("FFFFFFFF")))
    assert {v[0] for v in reports(stream_files(spark, change=negative)).values()} == {"CORRUPT"}
    huge = F.concat(F.substring("stream", 1, 32), F.unhex(F.lit("20000001")))
    assert {v[0] for v in reports(stream_files(spark, change=huge)).values()} == {"CORRUPT"}


def test_header_check(spark):
    df = spark.createDataFrame([(bytearray(b"DBBK" + b"x" * 28),), (bytearray(b"DBBK"),), (bytearray(b"XXXX" + b"x" * 28),)], "content binary")
    assert [r["valid_header"] for r in E.header_check(df).collect()] == [True, False, False]
