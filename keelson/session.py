"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rows one task may hold for a single key before a running scan is cut into slices.
ROWS_PER_KEY_CONF = "spark.keelson.rowsPerKey"
DEFAULT_ROWS_PER_KEY = 4_000_000


def build_session(app_name: str = "keelson", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows may be whole files or segments: batches for Python are bounded by bytes too
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        # stored files are compressed: judge what may be broadcast by what it becomes in memory
        "spark.sql.sources.fileCompressionFactor": "4.0",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the workers, so that functions run there whatever folder the driver was started in."""
    package = Path(__file__).resolve().parent
    if any(name.startswith(f"{package.name}-code") for name in map(os.path.basename, spark.sparkContext._python_includes)):
        return
    # the driver's own copy; Spark hands it to every worker
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="keelson-")
    spark.sparkContext.setCheckpointDir(root)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{scratch_root(spark)}/keelson/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Cuts the lineage so that a lost executor re-reads files instead of re-running the loop, gives every
    later reader the same rows, and leaves real file sizes for Catalyst's broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "lz4").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialise_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialise`` that also returns aggregates of the rows, observed while they are written."""
    seen = Observation()
    kept = materialise(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label)
    return kept, {name: int(value or 0) for name, value in seen.get.items()}


def rows_per_key(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_KEY_CONF, str(DEFAULT_ROWS_PER_KEY)))
