"""Duplicate groups by a key, such as a content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.operators.pages import PAGE, paged


def duplicate_groups(df: DataFrame, key: str, member: str, empty: str | None = None) -> DataFrame:
    """Keys of more than one row: member_count and the sorted members joined by ;. Null keys, and the key of empty content, are left out."""
    own = df.where(F.col(key).isNotNull())
    own = own.where(F.col(key) != empty) if empty is not None else own
    repeated = own.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)  # single rows stay out of the second shuffle
    return own.join(repeated, key, "left_semi").groupBy(key).agg(F.count("*").alias("member_count"), F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ";").alias("members"))


def duplicate_pages(df: DataFrame, key: str, member: str, empty: str | None = None, size: int = PAGE) -> DataFrame:
    """duplicate_groups() with the members in pages of so many, for groups of any size."""
    own = df.where(F.col(key).isNotNull())
    own = own.where(F.col(key) != empty) if empty is not None else own
    repeated = own.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return paged(own.join(repeated, key, "left_semi"), key, member, size)


def duplicate_rollup(df: DataFrame, key: str) -> DataFrame:
    """One row: groups of more than one row, their rows, rows beyond the first of each, and the largest."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    zero = lambda c, a: F.coalesce(c, F.lit(0)).alias(a)
    return n.agg(F.count(many).alias("group_count"), zero(F.sum(many), "affected_rows"), zero(F.sum(many - 1), "extra_rows"), zero(F.max(many), "largest_group"))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many groups have each size."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("group_count"))


def group_flags(df: DataFrame, key: str, attribute: str, flag: str, ends: bool = False) -> DataFrame:
    """Of each duplicate group: distinct attributes joined by ; (ends: the least and the greatest alone), whether they cross, and whether all rows have the flag.

    With ends, a group holds two values however many attributes it has, and a group without any has null attributes and crosses.
    """
    found = [F.min(attribute).alias("_least"), F.max(attribute).alias("_greatest")] if ends else [F.array_sort(F.collect_set(attribute)).alias("_a")]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("member_count"), *found, F.bool_and(flag).alias("all_flagged")).where("member_count > 1")
    crosses = F.col("_least") != F.col("_greatest") if ends else F.size("_a") > 1
    attributes = F.when(crosses, F.concat_ws(";", "_least", "_greatest")).otherwise(F.col("_least")) if ends else F.array_join("_a", ";")
    return out.select(key, "member_count", attributes.alias("attributes"), crosses.alias("crosses"), "all_flagged")
