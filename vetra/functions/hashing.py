"""Hash-based keys, splits and offsets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the splits but the last.
SPLITS = (("train", 0.8), ("validation", 0.9), ("test", 1.0))


def unit(payload: Column) -> Column:
    """The first 8 bytes of SHA-256 as a number in [0, 1]: the double nearest to that integer, by 2**64."""
    return F.conv(F.substring(F.sha2(payload, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def stable_unit(key: Column, salt: str) -> Column:
    return unit(F.concat(F.lit(f"{salt}|"), key.cast("string")))


def stable_split(key: Column, salt: str, splits: tuple[tuple[str, float], ...] = SPLITS) -> Column:
    """The split of a group key; the same key always has the same, under one salt."""
    value = stable_unit(key, salt)
    out = F.when(value < splits[0][1], splits[0][0])
    for name, end in splits[1:-1]:
        out = out.when(value < end, name)
    return out.otherwise(splits[-1][0])


def stable_offset(seed: Column | int, epoch: Column | int, dataset: Column, sample_id: Column) -> Column:
    """A record's offset in [0, 1] for a seed and an epoch."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (seed, epoch, dataset, sample_id)]
    return unit(F.concat_ws("|", *[p.cast("string") for p in parts]))


def composite_key(*columns: Column) -> Column:
    """SHA-256 of the values with NUL between them; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def content_hashes(content: Column) -> Column:
    """md5, sha1 and sha256 of a binary value, as a struct."""
    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"))


def inventory_digest(line: Column) -> Column:
    """An aggregate: SHA-256 over the sorted lines of a group, each with a line feed. For inventories, whose lines fit into a task."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256)
