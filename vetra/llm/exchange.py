"""Blocks of documents that send parts of their data to buckets, and get back what these find."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block's entries go out in so many rows at most. Of more buckets, several share a row, and a level between sorts them out.
FAN = 1_024
#: Tasks of a shuffle, at most; of more blocks or buckets, a task works on several, one after the other.
TASKS = 20_000
ROW = "part int, block int, data binary"

Entries = list[tuple[int, bytes]]


def boxed(entries: Entries) -> bytes:
    """Numbered byte strings as one."""
    head = np.array([len(entries), *(k for k, _ in entries), *(len(x) for _, x in entries)], "<i8")
    return head.tobytes() + b"".join(x for _, x in entries)


def unboxed(data: bytes) -> Iterator[tuple[int, bytes]]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8)
    at = 8 * (2 * n + 1)
    for k, size in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        yield k, data[at : at + size]
        at += size


def told(found: pa.Table) -> Entries:
    """What the buckets tell a block, by bucket."""
    return sorted((x for data in found.column("data") for x in unboxed(data.as_py())), key=lambda x: x[0])


def _rows(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    part, block, data = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
    return pa.table([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "data"])


def _gathered(entries: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(to, number, bytes) as one box for each `to`."""
    for to, own in groupby(sorted(entries, key=lambda x: x[:2]), key=lambda x: x[0]):
        yield to, boxed([x[1:] for x in own])


def _dealt(rows: DataFrame, numbers: int, column: str) -> DataFrame:
    return rows.repartitionById(min(numbers, TASKS), column)


def exchanged(dealt: DataFrame, send: Callable[..., Entries], count: Callable[[int, Entries], Entries], blocks: int, buckets: int, fan: int = FAN, before: DataFrame | None = None) -> DataFrame:
    """(part, block, data): boxes of what the buckets tell each block of dealt, which is in_blocks(); see told().

    send: a block's rows -> its entries by bucket. count: a bucket and its entries by block -> entries by block. Blocks and buckets are numbered from 0.
    before: what an earlier exchange told the blocks, which send gets as its second argument.

    Up to `fan` buckets, an entry is a row. Beyond that a block's entries to neighbouring buckets share a row, `fan` rows at most; those of
    `fan` blocks meet, and go on to each bucket in one row for all these blocks; the way back is the same. So rows grow with the
    blocks, and not with the pairs of blocks and buckets, up to fan * fan buckets.
    """
    share = -(-buckets // fan)  # buckets that share a row
    cells = -(-blocks // fan) * fan

    def out(table: pa.Table, *earlier: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        return _rows((part, block, box) for part, box in _gathered((k // share, k, x) for k, x in send(table, *earlier)))

    def out_after(table: pa.Table, earlier: pa.Table) -> pa.Table:
        return out(table, earlier)

    def forth(table: pa.Table) -> pa.Table:
        lot = table.column("block")[0].as_py() // fan
        entries = ((bucket, block, x) for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True) for bucket, x in unboxed(data.as_py()))
        return _rows((bucket, lot, box) for bucket, box in _gathered(entries))

    def meet(table: pa.Table) -> pa.Table:
        bucket, entries = table.column("part")[0].as_py(), []
        for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
            entries += [(block if share == 1 else k, x) for k, x in unboxed(data.as_py())]
        found = count(bucket, sorted(entries, key=lambda x: x[0]))  # a shuffle's rows come in any order
        if share == 1:
            return _rows((bucket, block, boxed([(bucket, x)])) for block, x in found)
        return _rows((bucket, lot, box) for lot, box in _gathered((block // fan, block, x) for block, x in found))

    def back(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() // share
        entries = ((block, bucket, x) for bucket, data in zip(table.column("part").to_pylist(), table.column("data"), strict=True) for block, x in unboxed(data.as_py()))
        return _rows((part, block, box) for block, box in _gathered(entries))

    sent = dealt.groupBy("slot").applyInArrow(out, ROW) if before is None else answered(dealt, before, blocks, out_after, ROW)
    if share > 1:
        cell = (F.floor(F.col("block") / fan) * fan + F.col("part")).cast("int")
        sent = _dealt(sent.withColumn("cell", cell), cells, "cell").groupBy("cell").applyInArrow(forth, ROW)
    found = _dealt(sent, buckets, "part").groupBy("part").applyInArrow(meet, ROW)
    if share > 1:
        cell = (F.col("block") * fan + F.floor(F.col("part") / share)).cast("int")
        found = _dealt(found.withColumn("cell", cell), cells, "cell").groupBy("cell").applyInArrow(back, ROW)
    return found


def _slot(spark: SparkSession, blocks: int) -> Column:
    """A number for each block that Spark's hash deals to a task of its own; with more blocks than TASKS, the block's own number.

    Cogrouped rows must be dealt by a hash, under which plain numbers leave a third of the tasks without a block and give others several.
    """
    if blocks > TASKS:
        return F.col("block")
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks))
    first = spark.range(40 * blocks).groupBy(place.alias("place")).agg(F.min("id").alias("id")).orderBy("place").collect()
    return F.element_at(F.split(F.lit(",".join(str(r["id"]) for r in first)), ",").cast("array<int>"), F.col("block") + 1)


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """docs (doc_id, text, ...) with block and slot, dealt by slot. A block is chosen by a hash of id and text, so that rows without an id, or with the same one, spread."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.withColumn("block", block).withColumn("slot", _slot(docs.sparkSession, blocks)).repartition(min(blocks, TASKS), "slot")


def answered(dealt: DataFrame, found: DataFrame, blocks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(a block's rows, what it is told) for each block."""
    found = found.withColumn("slot", _slot(found.sparkSession, blocks))
    return dealt.groupBy("slot").cogroup(found.groupBy("slot")).applyInArrow(work, schema)
