"""Queries over segments: documents in pieces, encrypted and back; stream files; damaged ones found."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import crypto
from keelson.operators import segments as E
from keelson.session import materialise, scratch_path
from keelson.sources import framed
from keelson.workload.fixtures import table
from keelson.workload.registry import query

SIZE = 1000


def payloads(spark, sf_dir):
    """Every document's text as bytes, some of them empty; the document is the part."""
    text = F.when(F.col("doc_id") % 13 == 5, F.lit("")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        F.lit("b-docs").alias("backup_id"), F.col("doc_id").alias("part"), F.encode(text, "UTF-8").alias("payload")
    )


#: The documents as the payloads hold them: every thirteenth is empty.
DOCS = "(select doc_id, case when doc_id % 13 = 5 then '' else text end as text from documents)"


def backup_keys(spark):
    return crypto.backup_keys(spark, "correct horse", {name: crypto.new_salt() for name in ("b-docs", "b-items", "b-more")})


PIECES = (
    f"pieces as (select part, i as segment_index, array_slice(b, cast(i * {SIZE} + 1 as bigint), cast((i + 1) * {SIZE} as bigint)) as payload from "
    f"(select doc_id as part, encode(text) as b, unnest(range(cast(ceil(strlen(text) / {SIZE}.0) as bigint))) as i from {DOCS} d) x)"
)


@query("e1_segment_split", f"with {PIECES} select part, segment_index, md5(hex(payload)) as digest, octet_length(payload) as bytes from pieces")
def segment_split(spark, sf_dir):
    pieces = E.split_payload(payloads(spark, sf_dir), size=SIZE)
    return pieces.select(
        "part", "segment_index", F.md5(F.hex("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes")
    )


@query("e1_table_segments", "select * from lineitem")
def table_segments(spark, sf_dir):
    """A whole table packed, encrypted, decrypted and unpacked."""
    rows = table(spark, sf_dir, "lineitem")
    plain = materialise(E.pack_table(rows, "b-items", size=1 << 20), "segments", **E.STORED)
    keys = backup_keys(spark)
    sealed = materialise(E.encrypt_segments(plain, keys), "sealed", **E.STORED)
    good, _ = E.decrypt_segments(sealed, keys)
    return E.unpack_table(good, rows.schema)


@query(
    "e3_segment_iv",
    "select event_id, lower(concat(substr(b, 1, 16), lpad(hex(xor(cast(concat('0x', substr(b, 17, 8)) as bigint), event_id)), 8, '0'))) as iv "
    "from (select event_id, substr(sha256(event_type), 1, 24) as b from events) x",
)
def segment_ivs(spark, sf_dir):
    base = F.unhex(F.substring(F.sha2("event_type", 256), 1, 24))
    return table(spark, sf_dir, "events").select("event_id", F.lower(F.hex(crypto.segment_iv(base, "event_id"))).alias("iv"))


def sealed_documents(spark, sf_dir):
    keys = backup_keys(spark)
    pieces = E.split_payload(payloads(spark, sf_dir), size=SIZE)
    return materialise(E.encrypt_segments(pieces, keys), "sealed"), keys


@query("e4_encrypted_sizes", f"with {PIECES} select part, segment_index, octet_length(payload) + 28 as bytes, true as hidden from pieces")
def encrypted_sizes(spark, sf_dir):
    """Each sealed segment is its IV, as many bytes as before, and a tag; it is not the plain text."""
    sealed, _ = sealed_documents(spark, sf_dir)
    plain = E.split_payload(payloads(spark, sf_dir), size=SIZE).withColumnRenamed("payload", "plain")
    both = sealed.join(plain, list(E.PLACE))
    return both.select(
        "part",
        "segment_index",
        F.octet_length("payload").cast("bigint").alias("bytes"),
        # a few bytes can turn up by chance
        ((F.octet_length("plain") < 16) | (F.instr(F.hex("payload"), F.hex("plain")) == 0)).alias("hidden"),
    )


def damaged(sealed):
    """Every 11th document loses a byte of its second segment, and every 7th changes places with nothing: its number moves."""
    broken = (F.col("part") % 11 == 0) & (F.col("segment_index") == 1)
    last = F.octet_length("payload") - 1
    flipped = F.concat(F.substring(F.col("payload"), F.lit(1), last.cast("int")), F.unhex(F.lit("00")), F.unhex(F.lit("01")))
    sealed = sealed.withColumn("payload", F.when(broken, flipped).otherwise(F.col("payload")))
    return sealed.withColumn("segment_index", F.when(F.col("part") % 7 == 3, F.col("segment_index") + 1).otherwise(F.col("segment_index")))


@query(
    "e5_bad_segments",
    f"with {PIECES} select part, case when part % 7 = 3 then segment_index + 1 else segment_index end as segment_index from pieces "
    "where (part % 11 = 0 and segment_index = 1) or part % 7 = 3",
)
def bad_segments(spark, sf_dir):
    """Changed bytes and moved segments are named by their place."""
    sealed, key = sealed_documents(spark, sf_dir)
    _, bad = E.decrypt_segments(damaged(sealed), key)
    return bad.select("part", "segment_index")


@query("e5_decrypted_segments", f"with {PIECES} select part, segment_index, md5(hex(payload)) as digest from pieces")
def decrypted_segments(spark, sf_dir):
    sealed, key = sealed_documents(spark, sf_dir)
    good, _ = E.decrypt_segments(sealed, key)
    return good.select("part", "segment_index", F.md5(F.hex("payload")).alias("digest"))


@query(
    "e4_distinct_ivs",
    f"with {PIECES} select k.name as backup_id, k.shift + part as part, segment_index, cast(1 as bigint) as uses from pieces, "
    "(values ('b-docs', 0), ('b-docs', 4294967296), ('b-more', 0)) k(name, shift)",
)
def distinct_ivs(spark, sf_dir):
    """Two backups, and parts beyond 32 bits: how many segments share a segment's key and IV."""
    keys = backup_keys(spark)
    pieces = E.split_payload(payloads(spark, sf_dir), size=SIZE)
    far = pieces.withColumn("part", F.col("part") + 2**32)
    sealed = E.encrypt_segments(pieces.union(far).union(pieces.withColumn("backup_id", F.lit("b-more"))), keys)
    seen = E.with_keys(sealed, keys, "key").select(*E.PLACE, F.sha2("_key", 256).alias("k"), F.substring("payload", 1, 12).alias("iv"))
    seen = materialise(seen, "ivs")
    uses = seen.groupBy("k", "iv").agg(F.count(F.lit(1)).alias("uses"))
    return seen.join(uses, ["k", "iv"]).select(*E.PLACE, "uses")


@query("e10_reassembly", f"select doc_id as part, text from {DOCS} d")
def reassembly(spark, sf_dir):
    sealed, key = sealed_documents(spark, sf_dir)
    good, _ = E.decrypt_segments(sealed, key)
    return E.reassemble(good, payloads(spark, sf_dir)).select("part", F.decode("payload", "UTF-8").alias("text"))


def missing_some(segments):
    gone = ((F.col("part") % 5 == 0) & (F.col("segment_index") % 3 == 1)) | (F.col("part") % 9 == 4)
    return segments.filter(~gone)


@query(
    "e8_truncation",
    f"with {PIECES} select part, segment_index from pieces where (part % 5 = 0 and segment_index % 3 = 1) or part % 9 = 4",
)
def truncation(spark, sf_dir):
    """Segments that trailers promise and storage lacks."""
    pieces = materialise(E.split_payload(payloads(spark, sf_dir), size=SIZE).select(*E.PLACE), "places")
    report = E.truncation_report(E.trailers(pieces), missing_some(pieces))
    return report.select("part", "segment_index")


@query(
    "e9_length_sanity",
    "select event_id, n as length, case when n = 0 then 'END' when n < 0 or n > 536870912 then 'CORRUPT' else 'SEGMENT' end as verdict from "
    "(select event_id, (cast(round(value * 1000) as bigint) - 2000) * (event_id % 5) * 4000 as n from events) x",
)
def length_sanity(spark, sf_dir):
    length = (F.round(F.col("value") * 1000).cast("bigint") - 2000) * (F.col("event_id") % 5) * 4000
    rows = table(spark, sf_dir, "events").select("event_id", length.alias("length"))
    return rows.withColumn("verdict", E.length_verdict(F.col("length")))


def stream_files(spark, sf_dir, damage: bool):
    """All documents as encrypted stream files of one backup, every eighth one cut short, mislabelled or with a bad length."""
    streams = E.frame_stream(payloads(spark, sf_dir), backup_keys(spark), SIZE)
    if damage:
        kind = F.col("part") % 8
        whole = F.octet_length("stream")
        upto = lambda n: F.substring(F.col("stream"), F.lit(1), n.cast("int"))
        streams = streams.withColumn(
            "stream",
            F.when(kind == 1, upto(whole - 4))
            .when(kind == 2, F.concat(F.unhex(F.lit("00")), F.col("stream")))
            .when(kind == 3, F.concat(upto(F.lit(32)), F.unhex(F.lit("FFFFFFF0"))))
            .when(kind == 4, upto(F.lit(32)))
            .otherwise(F.col("stream")),
        )
    root = scratch_path(spark, "streams")
    written = materialise(framed.write_streams(streams, root), "written")
    return written.select("path", F.col("bytes").alias("length"))


def doc_number():
    return F.regexp_extract("path", r"/(\d+)\.enc$", 1).cast("bigint")


@query("e6_header_check", "select doc_id as part, doc_id % 8 <> 2 as valid_header from documents")
def header_check(spark, sf_dir):
    files = stream_files(spark, sf_dir, damage=True)
    frames = framed.scan_frames(files)
    heads = frames.groupBy("path").agg(F.bool_and(F.col("salt").isNotNull()).alias("valid"))
    # a file with only a header has no frames, and its header is good
    return files.join(heads, "path", "left").select(doc_number().alias("part"), F.coalesce("valid", F.lit(True)).alias("valid_header"))


@query(
    "e7_frame_scan",
    "select doc_id as part, case doc_id % 8 when 1 then 'TRUNCATED' when 2 then 'INVALID' when 3 then 'CORRUPT' when 4 then 'TRUNCATED' else 'OK' end as report, "
    f"case when doc_id % 8 in (2, 3, 4) then 0 else cast(ceil(strlen(text) / {SIZE}.0) as bigint) end as segments from " + DOCS,
)
def frame_scan(spark, sf_dir):
    """Stream files checked by their frames: bad headers, bad lengths, missing end markers."""
    files = stream_files(spark, sf_dir, damage=True)
    report = framed.file_report(files, framed.scan_frames(files))
    return report.select(doc_number().alias("part"), "report", "segments")


@query("e7_stream_round_trip", f"select doc_id as part, text from {DOCS} d")
def stream_round_trip(spark, sf_dir):
    """Documents out to encrypted stream files and back by ranged reads."""
    files = stream_files(spark, sf_dir, damage=False)
    frames = materialise(framed.scan_frames(files), "frames")
    keys = framed.keys_by_salt(frames, "correct horse")
    segments = framed.read_segments(frames).join(keys, "salt")
    good, _ = framed.decrypt_stream_segments(segments, F.col("key"))
    named = good.select(F.lit("b-docs").alias("backup_id"), doc_number().alias("part"), "segment_index", "payload")
    parts = files.select(F.lit("b-docs").alias("backup_id"), doc_number().alias("part"))
    return E.reassemble(named, parts).select("part", F.decode("payload", "UTF-8").alias("text"))
