"""Encrypted stream files: written one per row, scanned by their frames, and read segment by segment."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import crypto
from keelson.operators.segments import length_verdict
from keelson.sources.listing import locate, open_object, qualified, spread_tasks

#: Payload bytes read before they are handed on; a single segment may be larger.
FETCH_BYTES = 64 << 20

FRAME_SCHEMA = "path string, salt binary, base_iv binary, segment_index bigint, offset bigint, length bigint, file_bytes bigint"

#: Frames a task holds before it hands them on.
FRAMES_PER_BATCH = 50_000


def write_streams(streams: DataFrame, root: str, name: str = "part", content: str = "stream") -> DataFrame:
    """One file per row below ``root`` (name column gives the file name, with folders before it); returns (path, bytes) of each.

    Each file is written whole under its final name, so a retried task replaces it with the same bytes.
    """

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        system, folder = locate(home)
        for batch in batches:
            done = []
            for label, data in zip(batch["name"], batch["content"]):
                target = f"{folder}/{label}.enc"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(data)
                done.append((f"{home}/{label}.enc", len(data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    home = qualified(streams.sparkSession, root)
    rows = streams.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"))
    return rows.mapInPandas(write, "path string, bytes bigint")


def scan_frames(listing: DataFrame) -> DataFrame:
    """Frames of every listed file: place, offset and stored length. Payloads are skipped, not read.

    A file without the format's header gives one row with a null salt. A file that ends before its end marker has no
    row of length 0.
    """

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]

        def frames_of(path: str, total: int) -> Iterator:
            with open_object(path) as stream:
                head = stream.read(crypto.HEADER_BYTES)
                if len(head) < crypto.HEADER_BYTES or head[:4].hex().upper() != crypto.MAGIC:
                    yield path, None, None, -1, 0, 0, total
                    return
                at, index = crypto.HEADER_BYTES, 0
                while at + 4 <= total:
                    stream.seek(at)
                    length = int.from_bytes(stream.read(4), "big", signed=True)
                    yield path, head[4:20], head[20:32], index, at + 4, length, total
                    if length <= 0 or length > crypto.MAX_SEGMENT_BYTES:
                        return
                    at, index = at + 4 + length, index + 1

        frames = []
        for batch in batches:
            for path, total in zip(batch["path"], batch["length"]):
                for frame in frames_of(path, total):
                    frames.append(frame)
                    if len(frames) >= FRAMES_PER_BATCH:
                        yield pd.DataFrame(frames, columns=names)
                        frames = []
        if frames:
            yield pd.DataFrame(frames, columns=names)

    spread = listing.select("path", "length").repartition(spread_tasks(listing), "path")
    return spread.mapInPandas(scan, FRAME_SCHEMA)


def with_verdict(frames: DataFrame) -> DataFrame:
    """Frames with INVALID (no header), END, CORRUPT, CUT (runs past the file) or SEGMENT."""
    cut = F.col("offset") + F.col("length") > F.col("file_bytes")
    kind = length_verdict(F.col("length"))
    verdict = (
        F.when(F.col("salt").isNull(), F.lit("INVALID")).when((kind == "SEGMENT") & cut, F.lit("CUT")).otherwise(kind)
    )
    return frames.withColumn("verdict", verdict)


def file_report(listing: DataFrame, frames: DataFrame) -> DataFrame:
    """One verdict per file: OK, INVALID, CORRUPT or TRUNCATED (no end marker, or only a header)."""
    seen = with_verdict(frames).groupBy("path").agg(
        F.bool_or(F.col("verdict") == "INVALID").alias("invalid"),
        F.bool_or(F.col("verdict") == "CORRUPT").alias("corrupt"),
        F.bool_or(F.col("verdict") == "END").alias("ended"),
        F.count_if(F.col("verdict") == "SEGMENT").alias("segments"),
    )
    report = (
        F.when(F.col("invalid"), F.lit("INVALID"))
        .when(F.col("corrupt"), F.lit("CORRUPT"))
        .when(F.col("ended"), F.lit("OK"))
        .otherwise(F.lit("TRUNCATED"))
    )
    return listing.select("path").join(seen, "path", "left").select(
        "path", report.alias("report"), F.coalesce("segments", F.lit(0)).alias("segments")
    )


def read_segments(frames: DataFrame, spread: int | None = None) -> DataFrame:
    """Cipher bytes of each whole segment, read by range. Segments are spread over tasks, so one large file is read by many."""

    def fetch(batches: Iterator) -> Iterator:
        for batch in batches:
            data, held, begin, opened, stream = [], 0, 0, None, None
            for row, (path, offset, length) in enumerate(zip(batch["path"], batch["offset"], batch["length"])):
                if path != opened:
                    if stream is not None:
                        stream.close()
                    stream, opened = open_object(path), path
                stream.seek(offset)
                data.append(stream.read(length))
                held += length
                if held >= FETCH_BYTES:
                    yield batch.iloc[begin : row + 1].assign(payload=data)
                    data, held, begin = [], 0, row + 1
            if stream is not None:
                stream.close()
            if data:
                yield batch.iloc[begin:].assign(payload=data)

    whole = with_verdict(frames).filter("verdict = 'SEGMENT'").drop("verdict", "file_bytes")
    return whole.repartition(spread or spread_tasks(frames), "path", "segment_index").mapInPandas(
        fetch, "path string, salt binary, base_iv binary, segment_index bigint, offset bigint, length bigint, payload binary"
    )


def decrypt_stream_segments(segments: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(plain segments, failed places). ``key`` is a column: each file has its own salt."""
    iv = crypto.segment_iv("base_iv", "segment_index")
    sealed = F.concat(iv, F.col("payload"))
    plain = segments.withColumn("_plain", F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT")))
    good = plain.filter("_plain is not null").select("path", "segment_index", F.col("_plain").alias("payload"))
    return good, plain.filter("_plain is null").select("path", "segment_index")


def keys_by_salt(frames: DataFrame, passphrase: str) -> DataFrame:
    """(salt, key) for every different salt, derived in tasks. A backup has one salt, however many files it has."""

    def derive(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(key=[crypto.derive_key(passphrase, bytes(salt)) for salt in batch["salt"]])

    salts = frames.filter("salt is not null").select("salt").distinct()
    return salts.mapInPandas(derive, "salt binary, key binary")
