"""Tables written to the shared folder to cut the lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from keelson.session import scratch_path


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the folder of ``spark.checkpoint.dir`` and read them back."""
    path, schema = scratch_path(df.sparkSession, label), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def kept_counted(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """``kept``, with aggregates of the rows observed while they are written."""
    seen = Observation()
    out = kept(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), label)
    return out, {k: int(v or 0) for k, v in seen.get.items()}
