"""Objects under a storage prefix: listing, existence, sizes, codecs, stale and orphaned objects."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import SCHEME_PROVIDERS, blank_to_null, object_id, uri_bucket, uri_key, uri_path, uri_scheme
from keelson.session import materialise_counted

#: The first bytes of a gzip stream, and the age after which a left-over object is stale.
GZIP_MAGIC = "1F8B"
STALE_MINUTES = 15

#: Schemes whose first path element is the bucket.
BUCKET_SCHEMES = {"s3", "gs", "gcs", "abfs", "abfss"}


def list_objects(spark: SparkSession, prefix: str, missing_ok: bool = False) -> DataFrame | None:
    """(path, length, modified) of every file below a folder; contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix)
    except AnalysisException:
        if missing_ok:
            return None
        raise
    return files.select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


@lru_cache(maxsize=64)
def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[0]


def locate(uri: str):
    """(file system, path in it) of a URI. One client per store and worker, however many objects it opens."""
    scheme, _, rest = uri.partition(":")
    host, path = "", rest
    if rest.startswith("//"):
        host, slash, path = rest[2:].partition("/")
        path = slash + path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    inner = host + path if scheme in BUCKET_SCHEMES else path
    return _file_system(f"{scheme}://{host}/"), inner


def open_object(uri: str):
    """A seekable file on whatever file system the URI names; used inside tasks for small ranged reads."""
    system, inner = locate(uri)
    return system.open_input_file(inner)


def spread_tasks(df: DataFrame) -> int:
    """Tasks for per-object work. Given as a number: rows that only name objects are tiny and would be merged into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; one without a scheme lies on the cluster's default file system."""
    hadoop = spark._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(hadoop).makeQualified(target).toString()


#: Entries of a folder that a task hands on at a time.
ENTRIES = 20_000


def _entries(batches: Iterator) -> Iterator:
    """What lies directly in each folder, as the file system tells it. A folder that is not there is empty."""
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        for uri in batch["path"]:
            system, inner = locate(uri)
            head = uri[: len(uri) - len(inner)]
            infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            for at in range(0, len(infos), ENTRIES):
                part = infos[at : at + ENTRIES]
                yield pd.DataFrame(
                    {
                        "path": [head + i.path for i in part],
                        "length": [i.size or 0 for i in part],
                        "modified": pd.to_datetime(pd.Series([i.mtime_ns for i in part], dtype="Int64") // 1000, unit="us"),
                        "folder": [i.type == fs.FileType.Directory for i in part],
                    }
                )


def list_tree(spark: SparkSession, root: str, name_prefix: str = "") -> DataFrame:
    """(path, length, modified) of every file below a folder whose path continues with ``name_prefix``, hidden names included.

    Folders are dealt to tasks, one level of the tree a round, and every round is written, so the driver holds no names.
    Only folders that the prefix leaves open are listed.
    """
    wanted = f"{qualified(spark, root).rstrip('/')}/{name_prefix}"
    folders, levels = spark.createDataFrame([(wanted.rpartition("/")[0],)], "path string"), []
    while True:
        dealt = folders.repartition(spread_tasks(folders), "path")
        entries = dealt.mapInPandas(_entries, "path string, length bigint, modified timestamp_ntz, folder boolean")
        entries, seen = materialise_counted(entries.filter(F.col("path").startswith(wanted)), "listing", folders=F.count_if("folder"))
        levels.append(entries.filter("not folder").drop("folder"))
        if not seen["folders"]:
            return reduce(DataFrame.unionAll, levels)
        folders = entries.filter("folder").select("path")


def list_prefix(spark: SparkSession, folder: str, name_prefix: str) -> DataFrame:
    """Files below ``folder`` whose path continues with ``name_prefix``."""
    return list_tree(spark, folder, name_prefix)


def provider_table(spark: SparkSession) -> DataFrame:
    """The fixed scheme map as a table (one row per scheme)."""
    return spark.createDataFrame(list(SCHEME_PROVIDERS.items()), "scheme string, provider string")


def classify(objects: DataFrame, uri: str = "uri") -> tuple[DataFrame, DataFrame]:
    """(known, quarantine): rows with their provider, and rows no provider answers for."""
    schemed = objects.withColumn("scheme", uri_scheme(uri))
    # the right side is a fixed map of seven rows
    known = schemed.join(F.broadcast(provider_table(objects.sparkSession)), "scheme")
    return known, schemed.filter(~F.col("scheme").isin(*SCHEME_PROVIDERS))


def split_uri(objects: DataFrame, uri: str = "uri") -> DataFrame:
    """Bucket and key for cloud URIs; a local URI has only a path, kept as the key."""
    known, _ = classify(objects.filter(blank_to_null(uri).isNotNull()), uri)
    cloud = F.col("provider") != "local"
    return known.withColumn("bucket", F.when(cloud, uri_bucket(uri))).withColumn(
        "key", F.when(cloud, uri_key(uri)).otherwise(uri_path(uri))
    )


def run_id(c: Column | str) -> Column:
    """What a run's record calls the folder an object lies in, over all tables; null outside of runs."""
    run = F.regexp_replace(object_id(c), r"/[^/]+/(backup_id=[^/]+)/.*$", "/*/$1")
    return F.when(object_id(c).rlike(r"/[^/]+/backup_id=[^/]+/"), run)


def listed_ids(listing: DataFrame) -> DataFrame:
    """Every name under which a record can mean a listed object: the object's own, and its run's."""
    names = F.filter(F.array(object_id("path"), run_id("path")), lambda n: n.isNotNull())
    return listing.select(F.explode(names).alias("_id")).distinct()


def missing_objects(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Successful records whose object is not in the listing."""
    done = catalog.filter("status = 'SUCCESS' and destination_uri is not null")
    return done.join(listed_ids(listing), object_id("destination_uri") == F.col("_id"), "left_anti")


def orphan_objects(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed objects no record names, by itself or by its run."""
    # records may share an object: distinct combines them before the shuffle
    named = catalog.filter("destination_uri is not null").select(object_id("destination_uri").alias("_id")).distinct()
    alone = listing.join(named, object_id("path") == F.col("_id"), "left_anti")
    return alone.join(named, run_id("path") == F.col("_id"), "left_anti")


def with_existence(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Every record with a URI and whether the listing has the object."""
    joined = catalog.filter("destination_uri is not null").join(listed_ids(listing), object_id("destination_uri") == F.col("_id"), "left")
    return joined.withColumn("object_exists", F.col("_id").isNotNull()).drop("_id")


def stale_objects(listing: DataFrame, asof: Column, folder: str, minutes: int = STALE_MINUTES) -> DataFrame:
    """Objects directly in one folder (not below it) that are strictly older than the age limit."""
    parent = F.regexp_replace(object_id("path"), "/[^/]*$", "")
    return listing.filter((parent == object_id(F.lit(folder.rstrip("/")))) & (F.col("modified") < asof - F.make_dt_interval(mins=F.lit(minutes))))


def codec_of(content: Column | str) -> Column:
    """gzip when the bytes start with its magic, else raw; fewer than two bytes are raw."""
    first = F.substring(F.col(content) if isinstance(content, str) else content, 1, 2)
    return F.when(F.hex(first) == GZIP_MAGIC, F.lit("gzip")).otherwise(F.lit("raw"))


def sniff_files(listing: DataFrame) -> DataFrame:
    """Codec of every listed file, reading two bytes of each from the file system it lives on."""

    def first_bytes(batches: Iterator) -> Iterator:
        for batch in batches:
            heads = []
            for path in batch["path"]:
                with open_object(path) as stream:
                    heads.append(stream.read(2))
            yield batch.assign(head=heads)

    schema = "path string, length bigint, head binary"
    heads = listing.select("path", "length").repartition(spread_tasks(listing), "path").mapInPandas(first_bytes, schema)
    return heads.select("path", "length", codec_of("head").alias("codec"))


def bytes_by_backup(listing: DataFrame) -> DataFrame:
    """Stored files and bytes per backup id, taken from the folder names. Marks and checksums (hidden names) are no data."""
    backup = F.regexp_extract("path", "/backup_id=([^/]+)/", 1)
    files = listing.withColumn("backup_id", backup).filter((F.col("backup_id") != "") & ~F.col("path").rlike(r"/[._][^/]*$"))
    return files.groupBy("backup_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
