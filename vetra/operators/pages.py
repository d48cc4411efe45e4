"""Lists of a key's members in numbered pages of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.operators.ordinals import numbered

#: Members of a page.
PAGE = 10_000


def paged(df: DataFrame, key: str, member: str, size: int = PAGE, distinct: bool = False) -> DataFrame:
    """(key, page, page_count, member_count, members): of each key, its members in order, so many to a page; pages count from 0.

    A small key is one row with all its members, sorted. Of a large one, members are dealt by ranges, numbered, and gathered by page, so neither a
    row nor a task holds more than a page of it. Null members are left out, a null key is one; repeated members are there as often, or once if distinct.
    """
    own = df.select(F.col(key).alias("_key"), F.col(member).alias("_member")).where("_member is not null")
    placed = numbered(own.distinct() if distinct else own, [F.col("_member")], ["_key"], "_at", 0, "_count")
    pages = placed.groupBy("_key", F.floor(F.col("_at") / size).alias("page")).agg(F.max("_count").alias("member_count"), F.array_sort(F.collect_list("_member")).alias("members"))
    return pages.select(F.col("_key").alias(key), "page", F.ceil(F.col("member_count") / size).alias("page_count"), "member_count", "members")
