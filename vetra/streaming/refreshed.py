"""Columns of a partitioned table recomputed in place: only partitions that change are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.storage import dropped, stored


def refresh_partitions(spark: SparkSession, path: str, partition: str, recomputed: DataFrame, key: str, columns: list[str], counts: dict[str, tuple[DataFrame, list[str]]] | None = None) -> tuple[int, dict[str, DataFrame]]:
    """Gives rows of a Parquet table, partitioned by one column, new values of some columns by key; how many partitions that touched, and the dependent counts as they are now.

    Only partitions in which a value changes are read as a whole and overwritten; the files of all others stay as they are. counts: tables (keys, n) of how many rows
    have each of some columns' values; they are adjusted by the difference of the touched partitions' rows before and after, not counted anew. Keys without a row, and
    rows without a key, change nothing. What is written stands in the shared folder first, so a run that dies leaves partitions old or new.
    """
    table = spark.read.parquet(path)
    new = recomputed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = table.join(new, F.col(key) == F.col("_k"))
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in columns])
    touched = stored(joined.where(differs).select(F.col(partition).alias("_p")).distinct(), "touched")
    n = touched.count()
    if not n:
        return 0, {name: df for name, (df, _) in (counts or {}).items()}
    before = table.join(touched, F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    own = before.join(new.withColumn("_has", F.lit(True)), F.col(key) == F.col("_k"), "left")
    after = stored(own.select(*[F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(dict(table.dtypes)[c]).alias(c) if c in columns else F.col(c) for c in table.columns]), "refreshed")
    out = {}
    for name, (old, keys) in (counts or {}).items():
        side = lambda df, sign, by=keys: df.groupBy(*by).agg((F.lit(sign) * F.count("*")).alias("n"))
        moved = old.select(*keys, F.col("n").cast("long").alias("n")).unionByName(side(after, 1)).unionByName(side(before, -1))
        out[name] = stored(moved.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0"), f"counts-{name}")
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for t in (touched, after):
        dropped(t)
    return n, out
