"""Rows numbered in an order, by as many tasks as the order has ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetra.storage import stored


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "ordinal", base: int = 1, size: str | None = None) -> DataFrame:
    """df with each row's place in its group (or in all of it) by the order, from `base`; with the group's rows as `size`, if that is named.

    Rows are dealt by ranges of (group, order) and sorted there; a range counts its rows by group, and a second pass adds what the ranges before
    hold. So a group of any size is numbered by several tasks, and what is summed in one place has a row for each range of a group. Rows
    that the order can't tell apart meet in one range and are numbered in any order. Null groups are a group; an empty table gives none.
    """
    rows, own = ranged(df, order, group or [])
    return in_ranges(rows, own, name, base, size)


def ranged(df: DataFrame, order: list[Column], group: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows, as _row, dealt by ranges of (group, order) and sorted there, with the range's number and the place, _at, in it; and the names of the group's columns beside them."""
    own = [f"_g{k}" for k in range(len(group))]
    by = [*(F.col(c) for c in group), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = dealt.select(F.struct("*").alias("_row"), *[F.col(c).alias(k) for k, c in zip(own, group, strict=True)], F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("_range", F.shiftright("_at", 33)), own


def _same(keys: list[str]) -> Column:
    """Equal ranges of equal groups, of which nulls equal nulls; the other side's names end in s."""
    out = F.col("_range") == F.col("_in")
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"{k}s"))
    return out


def in_ranges(rows: DataFrame, group: list[str], name: str, base: int = 1, size: str | None = None) -> DataFrame:
    """The _row of each row with its place in its group: groups' ranges (_range) follow each other, and within one _at rises by 1 from row to row."""
    placed = stored(rows, "ranges")
    counts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"{k}s") for k in group], F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size"))
    place = (F.col("_at") + F.col("_shift") + base).alias(name)
    return placed.join(starts, _same(group)).select("_row.*", place, *([F.col("_size").alias(size)] if size else []))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None, totals: dict[str, str] | None = None, ranges: str | None = None) -> DataFrame:
    """df with running sums by the order within each group, {new name: summed column}, and the groups' whole sums, {new name: summed column}; a range's number as `ranges`.

    By ranges, as numbered(): each sums its rows on its own, and what the ranges before it sum to is added. However the values crowd, ranges are of about equal size, so no
    task sums a whole group. Nulls count as 0.
    """
    rows, own = ranged(df, order, group or [])
    placed = stored(rows, "ranges")
    columns = list(dict.fromkeys([*sums.values(), *(totals or {}).values()]))
    parts = placed.groupBy(*own, "_range").agg(*[F.coalesce(F.sum(f"_row.`{c}`"), F.lit(0)).alias(f"_p{k}") for k, c in enumerate(columns)])
    whole = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(k).alias(f"{k}s") for k in own], F.col("_range").alias("_in"), *[x for k in range(len(columns)) for x in (F.coalesce(F.sum(f"_p{k}").over(earlier), F.lit(0)).alias(f"_b{k}"), F.sum(f"_p{k}").over(whole).alias(f"_t{k}"))])
    inside = Window.partitionBy(*own, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(F.coalesce(F.col(f"_row.`{c}`"), F.lit(0))).over(inside).alias(f"_r{k}") for k, c in enumerate(columns)])
    out = run.join(starts, _same(own))
    at = {c: k for k, c in enumerate(columns)}
    found = [(F.col(f"_r{at[c]}") + F.col(f"_b{at[c]}")).alias(n) for n, c in sums.items()] + [F.col(f"_t{at[c]}").alias(n) for n, c in (totals or {}).items()]
    return out.select("_row.*", *found, *([F.col("_range").alias(ranges)] if ranges else []))
