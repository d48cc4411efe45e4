"""Exact quantiles by selection, for all columns and groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from vetra.storage import dropped, stored

#: Bits of a level: a histogram has so many cells at most, by group and column.
LEVEL_BITS = 16


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values with whole numbers in the same order; NaN is the greatest, and both zeros are one."""
    for batch in batches:
        value = batch.column("value").to_numpy(zero_copy_only=False) + 0.0
        value[np.isnan(value)] = np.nan
        bits = value.view(np.int64)
        yield batch.append_column("bits", pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)))


def selected(counts: DataFrame, group: list[str], ranks: DataFrame) -> DataFrame:
    """ranks (group, rank) with the value of each: of the group's values in order, from (group, value, n), that with so many before it.

    Values become whole numbers in the same order. A level counts, for all groups in one pass, the values that share their highest bits with a sought one, by
    the next LEVEL_BITS; each rank goes on with the cell that it falls into. So a task sums cells, LEVEL_BITS of them, and never sorts a group's values.
    Nulls in the group equal nulls.
    """
    schema = StructType([*counts.select(*group, "value", "n").schema.fields]).add("bits", LongType())
    rows = stored(counts.select(*group, F.col("value").cast("double").alias("value"), "n").mapInArrow(_keyed, schema), "quantile-counts")
    sought = ranks.select(*group, "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("path"))
    names = [f"_g{k}" for k in range(len(group))]
    other = lambda df: df.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], *[c for c in df.columns if c not in group])

    def same(x: str, y: str) -> Column:
        out = F.col(x) == F.col(y)
        for c, n in zip(group, names, strict=True):
            out &= F.col(c).eqNullSafe(F.col(n))
        return out

    # the highest level is signed, so that paths rise with the values
    for shift in range(64 - LEVEL_BITS, -1, -LEVEL_BITS):
        own = rows.withColumn("above", F.shiftright("bits", shift + LEVEL_BITS) if shift + LEVEL_BITS < 64 else F.lit(0).cast("long")).withColumn("cell", F.shiftright("bits", shift))
        paths = other(sought.select(*group, F.col("path").alias("on")).distinct())
        cells = own.join(paths, same("above", "on"), "left_semi").groupBy(*group, "above", "cell").agg(F.sum("n").alias("n"), F.first("value").alias("value"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "above").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = other(cells.withColumn("before", before))
        met = sought.drop("value").join(counted, same("path", "above") & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        sought = stored(met.select(*group, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("cell").alias("path"), "value"), "quantile-ranks")
    dropped(rows)
    return sought.select(*group, "rank", "value")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], at: tuple[float, ...]) -> DataFrame:
    """(keys, column, n, minimum, maximum, mean, deviation, q0, q1, ...) of the columns' values that aren't null: quantiles by linear interpolation, as percentile() gives them."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "column", "value").where("value is not null")
    group = [*keys, "column"]
    counts = stored(long.groupBy(*group, "value").agg(F.count("*").alias("n")), "quantile-values")
    stats = stored(long.groupBy(*group).agg(F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")), "quantile-stats")
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in at])))
    found = selected(counts, group, stats.select(*group, F.explode(wanted).alias("rank")))
    by_rank = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    names = [f"_k{k}" for k in range(len(group))]
    both = stats.join(by_rank.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], "_v"), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names, strict=True)]).drop(*names)

    def value(q: float) -> Column:
        low, high = F.try_element_at("_v", F.floor(place(q))), F.try_element_at("_v", F.ceil(place(q)))
        return F.when(low == high, low).otherwise((F.ceil(place(q)) - place(q)) * low + (place(q) - F.floor(place(q))) * high)

    return both.select(*group, "n", "minimum", "maximum", "mean", "deviation", *[value(q).alias(f"q{k}") for k, q in enumerate(at)])
