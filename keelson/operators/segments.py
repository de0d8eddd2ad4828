"""Payloads in fixed-size segments: split, encrypt, check, decrypt, reassemble; whole tables as segments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import crypto

PLACE = ("backup_id", "part", "segment_index")

#: How segment tables are stored: sizes are checked after every row, as a row can be as large as a row group.
STORED = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def split_payload(rows: DataFrame, payload: str = "payload", size: int = crypto.SEGMENT_BYTES) -> DataFrame:
    """Each row's bytes as pieces of ``size`` bytes numbered from 0, the last one short; no piece for empty bytes.

    Pieces are cut from bytes, not characters: a byte offset is reached directly, so a long payload costs its length.
    """
    if size <= 0:
        raise ValueError("segment size must be positive")
    length = F.octet_length(payload)
    count = F.ceil(length / size).cast("bigint")
    indexed = rows.filter(length > 0).withColumn("segment_index", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    start = (F.col("segment_index") * size + 1).cast("int")
    return indexed.withColumn(payload, F.substring(payload, start, F.lit(size)))


def with_keys(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the ``columns`` of their backup in ``keys``, a table the driver made row by row and so a small one."""
    named = [F.col(c).alias(f"_{c}") for c in columns]
    return rows.join(F.broadcast(keys.select("backup_id", *named)), "backup_id", "left")


def encrypt_segments(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Encrypt plain segments (backup_id, part, segment_index, payload) with the keys of ``crypto.backup_keys``.

    The IV follows from the place, and the place is bound as authenticated text. The plain rows must come from files
    (see ``pack_table``) or be a pure function of them, so that a retried task meets the same bytes under an IV.
    """
    iv = crypto.segment_iv(crypto.base_iv("part"), "segment_index")
    key = F.when(F.col("_key").isNull(), F.raise_error(F.lit("no key for this backup")).cast("binary")).otherwise(F.col("_key"))
    sealed = crypto.encrypt("payload", key, iv, crypto.segment_aad(*PLACE))
    return with_keys(segments, keys, "key").withColumn("payload", sealed).select(*segments.columns)


def decrypt_segments(segments: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain segments, places that fail): a wrong or missing key, changed bytes or a moved segment names its place."""
    plain = with_keys(segments, keys, "key").withColumn("_plain", crypto.try_decrypt("payload", F.col("_key"), crypto.segment_aad(*PLACE)))
    good = plain.filter("_plain is not null").withColumn("payload", F.col("_plain")).select(*segments.columns)
    return good, plain.filter("_plain is null").select(*PLACE)


def trailers(segments: DataFrame) -> DataFrame:
    """One row per part with the number of its segments: the end marker of a part."""
    return segments.groupBy("backup_id", "part").agg(F.count(F.lit(1)).alias("segments"))


def truncation_report(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Missing segments, named by place, of the parts in ``expected`` (backup_id, part, segments).

    Parts are compared by count first; only those that lack segments are spelled out and anti-joined.
    """
    found = present.groupBy("backup_id", "part").agg(F.count_distinct("segment_index").alias("found"))
    short = (
        expected.join(found, ["backup_id", "part"], "left")
        .filter((F.col("segments") > 0) & (F.coalesce("found", F.lit(0)) < F.col("segments")))
        .select("backup_id", "part", "segments")
    )
    wanted = short.select(
        "backup_id", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segments") - 1)).alias("segment_index")
    )
    return wanted.join(present, list(PLACE), "left_anti")


def reassemble(segments: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Bytes of each part in index order. A part is what was one payload before the split, so it fits one row again.

    Empty payloads have no segment: they come back only if ``parts`` (backup_id, part) names them.
    """
    piece = F.struct(F.col("segment_index"), F.col("payload"))
    ordered = F.sort_array(F.collect_list(piece))
    # hex text joins in one pass, where folding concat over the pieces would copy the payload once per piece
    joined = F.unhex(F.array_join(F.transform(ordered, lambda s: F.hex(s["payload"])), ""))
    whole = segments.groupBy("backup_id", "part").agg(joined.alias("payload"))
    if parts is None:
        return whole
    named = parts.select("backup_id", "part").join(whole, ["backup_id", "part"], "left")
    return named.withColumn("payload", F.coalesce("payload", F.lit(b"")))


def frame_stream(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """One encrypted stream per row of (backup_id, part, payload): header, length-prefixed segments, end marker."""
    base = crypto.base_iv("part")
    count = F.ceil(F.octet_length("payload") / size).cast("int")

    def frame(i: Column) -> Column:
        piece = F.substring(F.col("payload"), (i * size + 1).cast("int"), F.lit(size))
        sealed = crypto.encrypt(piece, F.col("_key"), crypto.segment_iv(base, i))
        body = F.substring(sealed, crypto.IV_BYTES + 1, 2**31 - 1)  # the stream keeps the IV in its header only
        return F.hex(F.concat(crypto.int32_bytes(F.octet_length(body)), body))

    indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    frames = F.unhex(F.array_join(F.transform(indexes, frame), ""))
    header = F.concat(F.unhex(F.lit(crypto.MAGIC)), F.col("_salt"), base)
    stream = F.concat(header, frames, F.lit(bytes(4))).alias("stream")
    return with_keys(rows, keys, "salt", "key").select(*rows.columns, stream)


def header_check(streams: DataFrame, content: str = "content") -> DataFrame:
    """Whether each stream starts with the format's magic and is long enough for a header."""
    magic = F.hex(F.substring(content, 1, 4)) == crypto.MAGIC
    return streams.withColumn("valid_header", F.coalesce(magic & (F.octet_length(content) >= crypto.HEADER_BYTES), F.lit(False)))


def length_verdict(length: Column) -> Column:
    """What a frame length says: 0 ends the stream, negative or above the limit is damage."""
    return (
        F.when(length == 0, F.lit("END"))
        .when((length < 0) | (length > crypto.MAX_SEGMENT_BYTES), F.lit("CORRUPT"))
        .otherwise(F.lit("SEGMENT"))
    )


SEGMENT_SCHEMA = T.StructType(
    [
        T.StructField("backup_id", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("segment_index", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def pack_table(df: DataFrame, backup_id: str, size: int = crypto.SEGMENT_BYTES, codec: str | None = None) -> DataFrame:
    """A table as self-contained segments of about ``size`` bytes, each an Arrow stream of whole rows.

    The part is the task, the index counts its segments, a task never holds more than one segment. No shuffle:
    rows stay where they are read. ``codec`` (lz4 or zstd) compresses inside the segment. Write the result before encrypting it
    with IVs made from places, so that places and bytes are fixed.
    """
    if size <= 0:
        raise ValueError("segment size must be positive")

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        index, held, rows, held_bytes = 0, [], 0, 0

        def segment():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
                for batch in held:
                    writer.write_batch(batch)
            return pa.RecordBatch.from_pydict(
                {
                    "backup_id": [backup_id],
                    "part": [part],
                    "segment_index": [index],
                    "row_count": [rows],
                    "payload": [sink.getvalue().to_pybytes()],
                },
                schema=pa.schema(
                    [("backup_id", pa.string()), ("part", pa.int64()), ("segment_index", pa.int64()),
                     ("row_count", pa.int64()), ("payload", pa.binary())]
                ),
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            # a batch above the size is cut by rows
            per_cut = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, per_cut):
                cut = batch.slice(start, per_cut)
                cut_bytes = cut.get_total_buffer_size() if cut.num_rows == batch.num_rows else cut.nbytes
                if held and held_bytes + cut_bytes > size:
                    yield segment()
                    index, held, rows, held_bytes = index + 1, [], 0, 0
                held.append(cut)
                rows += cut.num_rows
                held_bytes += cut_bytes
        if held:
            yield segment()

    return df.mapInArrow(pack, SEGMENT_SCHEMA)


def unpack_table(segments: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of plain table segments; every segment is read on its own, in any order."""

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for payload in batch.column("payload"):
                with pa.ipc.open_stream(payload.as_buffer()) as reader:
                    yield from reader

    return segments.select("payload").mapInArrow(unpack, schema)
