"""Helpers that the operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.storage import dropped, shared_dir, stored

__all__ = ["LOWER", "UPPER", "ascii_lower", "blocks", "dropped", "lacking", "let", "perhaps", "read", "sha", "shared_dir", "size_in_bytes", "small", "stored", "texts", "without"]

#: Bits of a bitmap of keys: what is broadcast has a row for 64 of them, 262,144 at most, at any size of the input.
KEY_BITS = 1 << 24

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators need, under fixed names, so that no other column can clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Catalyst's size of a table of which it knows none is more.
UNKNOWN = 1 << 60


def size_in_bytes(docs: DataFrame) -> int:
    """Bytes of the files that docs (with a column text) come from; where they come from no files, of their texts, which takes a pass."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return total if total < UNKNOWN else int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def blocks(docs: DataFrame, block_bytes: int) -> int:
    """Into how many blocks a table goes so that each holds about block_bytes, and all cores have work."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size_in_bytes(docs) / block_bytes))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has that many rows at most, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha(text_col: str = "text") -> Column:
    """The text's SHA-256 in hex; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8"), 256)


def perhaps(docs: DataFrame, keys: list[str], members: DataFrame, others: bool = False) -> DataFrame:
    """The rows of docs whose key may be one of the members' (columns of the same names), or those whose key can't be, if others.

    Judged by a bitmap of hashed keys: it has every member, and few others until KEY_BITS fill up. It spares most rows a
    shuffle; an exact join must follow. Where it is full, all rows may be members.
    """
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    place = F.pmod(F.xxhash64(*keys), F.lit(KEY_BITS))
    words = members.select(place.alias("_place")).groupBy(F.expr("_place div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = docs.withColumn("_place", place).join(F.broadcast(words), F.expr("_place div 64 = _word"), "left")
    found = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(~found if others else found).select(*docs.columns)


def lacking(df: DataFrame, keys: list[str], members: DataFrame) -> DataFrame:
    """The rows of df whose keys no row of members has. Only those that the bitmap doubts are shuffled."""
    return perhaps(df, keys, members, others=True).unionByName(perhaps(df, keys, members).join(members.select(*keys), keys, "left_anti"))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but those whose id and text are in gone; of each id and text in repeated, one row, the least by all its columns, as JSON.

    gone and repeated have doc_id and text_sha256. Nulls equal nulls; a null text is empty. Only rows that a bitmap
    finds are shuffled, with their texts; all others stay where they are. A row travels as one value, so its columns may have any names and types.
    """
    keys = ["_id", "_sha"]
    key = lambda df, what: df.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.lit(what).alias("_what"))
    marks = stored(key(gone, 2).unionByName(key(repeated, 1)).groupBy(*keys).agg(F.max("_what").alias("_what")), "marked-rows")
    own = docs.select(F.struct("*").alias("_row")).select("_row", F.col(f"_row.`{id_col}`").cast("long").alias("_id"), sha(f"_row.`{text_col}`").alias("_sha"))
    marked = perhaps(own, keys, marks).alias("a").join(marks.alias("b"), F.expr("a._id <=> b._id and a._sha = b._sha"), "left").select("a.*", F.coalesce("_what", F.lit(0)).alias("_what"))
    out = perhaps(own, keys, marks, others=True).select("_row").unionByName(marked.where("_what = 0").select("_row"))
    if not marks.where("_what = 1").isEmpty():
        out = out.unionByName(marked.where("_what = 1").groupBy(*keys).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return out.select("_row.*")
