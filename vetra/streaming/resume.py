"""Incremental and resumable processing."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def pending(source: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done yet. Nulls equal nulls."""
    if done is None:
        return source
    names = [f"_done{k}" for k in range(len(keys))]
    d = done.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    return source.join(d, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left_anti")


def append_pending(spark: SparkSession, source: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Works on what a Parquet sink lacks, and appends it in one commit; how many rows it added. A run that died is taken up by the next."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    done = spark.read.parquet(path) if there else None
    before = done.count() if there else 0
    work(pending(source, done, keys)).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def process_new_files(spark: SparkSession, schema: StructType | str, source: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_at_once: int = 250, source_format: str = "parquet") -> StreamingQuery:
    """A file stream that works off what is new since the last call, in batches, then ends; each file exactly once, also over restarts."""
    stream = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_at_once).load(source)
    return work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: str, order: str, delay: str | None = None, event_time: str | None = None) -> DataFrame:
    """Per key the row with the greatest order, batch or stream; with a watermark if a delay is given."""
    rows = events.withWatermark(event_time, delay) if delay else events
    rest = [c for c in events.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def cache_status(expected: DataFrame, stored: DataFrame, key: list[str], identity: list[str], content: str) -> DataFrame:
    """Each expected or stored entry: BUILT (nothing stored), RECOVERED_PARTIAL (content without metadata), VERIFIED_EXISTING, or why it fails.

    stored has the identity columns (null: no metadata), the recorded content hash in `content`, and the actual one in `actual_` + content.
    """
    e = expected.select(*key, *[F.col(c).alias(f"_e_{c}") for c in identity], F.lit(True).alias("_e"))
    s = stored.select(*key, *[F.col(c).alias(f"_s_{c}") for c in identity], F.col(content).alias("_recorded"), F.col(f"actual_{content}").alias("_actual"), F.lit(True).alias("_s"))
    out = e.join(s, key, "full")
    same = F.lit(True)
    known = F.lit(False)
    for c in identity:
        same = same & F.col(f"_e_{c}").eqNullSafe(F.col(f"_s_{c}"))
        known = known | F.col(f"_s_{c}").isNotNull()
    status = (
        F.when(F.col("_e").isNull(), "UNEXPECTED")
        .when(F.col("_s").isNull() | (F.col("_actual").isNull() & ~known), "BUILT")
        .when(F.col("_actual").isNull(), "ERROR_MISSING_CONTENT")
        .when(~known, "RECOVERED_PARTIAL")
        .when(~same, "ERROR_IDENTITY")
        .when(~F.col("_recorded").eqNullSafe(F.col("_actual")), "ERROR_CONTENT")
        .otherwise("VERIFIED_EXISTING")
    )
    return out.select(*key, status.alias("status"))


def complete_units(recorded: DataFrame, observed: DataFrame, unit: str, artifact: str, digest: str) -> DataFrame:
    """(unit, artifact_count, complete): units all of whose recorded artifacts are there with the recorded hash; others must run again."""
    o = observed.select(F.col(unit).alias("_u"), F.col(artifact).alias("_a"), F.col(digest).alias("_d"))
    rows = recorded.join(o, (F.col(unit) == F.col("_u")) & (F.col(artifact) == F.col("_a")), "left")
    return rows.groupBy(unit).agg(F.count("*").alias("artifact_count"), F.bool_and(F.coalesce(F.col("_d") == F.col(digest), F.lit(False))).alias("complete"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that came, went or changed between two snapshots, and how."""
    out = before.alias("a").join(after.alias("b"), F.col("a.path") == F.col("b.path"), "full")
    how = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when((F.col("a.length") != F.col("b.length")) | (F.col("a.modificationTime") != F.col("b.modificationTime")), "changed")
    return out.select(F.coalesce("a.path", "b.path").alias("path"), how.alias("change")).where("change is not null")


def refresh(table: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with new values of some columns where the key has them; all else stays."""
    new = recomputed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_has"))
    out = table.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def progress(done: int, total: int, done_lately: int, lately_seconds: float, run_seconds: float) -> dict[str, float]:
    """Share, rate and time left of a run, by its latest interval, or by the whole run where that is empty."""
    rate = done_lately / lately_seconds if lately_seconds > 0 and done_lately > 0 else done / run_seconds if run_seconds > 0 else 0.0
    return {"percent": 100.0 * done / total if total else 100.0, "rate": rate, "eta_seconds": (total - done) / rate if rate else float("inf")}


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()
