"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (own := getattr(spark, "_vetra_shared", None)):
        own = spark._vetra_shared = tempfile.mkdtemp(prefix="vetra-")
    return own


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df written to the shared folder and read again: it cuts lineage, and survives the loss of executors. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vetra_path = path
    _kept(spark).add(path)
    return out


def _kept(spark: SparkSession) -> set[str]:
    if not hasattr(spark, "_vetra_stored"):
        spark._vetra_stored = set()
    return spark._vetra_stored


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _kept(spark).discard(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    _deleted(df.sparkSession, df._vetra_path)


def clear(spark: SparkSession) -> int:
    """Deletes all stored() tables of this session; how many. Call it when the results that read them, lazily, are written."""
    paths = list(_kept(spark))
    for path in paths:
        _deleted(spark, path)
    return len(paths)
