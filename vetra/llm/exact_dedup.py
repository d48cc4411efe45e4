"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import perhaps, read, small, stored

#: Two primes below 2**31 and a base for each: a term of a 4-byte word and a power fits into 63 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1_103_515_245, 1_664_525_013)
#: Bytes of a chunk, a multiple of 4; only a text's last chunk may be shorter.
CHUNK = 1 << 16
FINGERPRINT = "doc_id long, text_sha256 string, fp long, bytes long"

Hash = tuple[int, int, int]  # by each prime, and the words


def _powers() -> list[np.ndarray]:
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        row = [1]
        for _ in range(CHUNK // 4 - 1):
            row.append(row[-1] * b % p)
        out.append(np.array(row[::-1], np.uint64))
    return out


def chunk_hash(data: bytes, powers: list[np.ndarray]) -> Hash:
    """The polynomial, by each prime, with the 4-byte words of data as coefficients; zeros fill up the last word."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4").astype(np.uint64)
    h = [int((words * row[len(row) - len(words) :] % p).sum()) % p for p, row in zip(PRIMES, powers, strict=True)]
    return h[0], h[1], len(words)


def combine(a: Hash, b: Hash) -> Hash:
    """The hash of two texts in a row, from theirs alone: a's is shifted by b's length. Associative."""
    x, y = ((a[i] * pow(BASES[i], b[2], p) + b[i]) % p for i, p in enumerate(PRIMES))
    return x, y, a[2] + b[2]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, whole = _powers(), (0, 0, 0)
    for batch in batches:
        rows = []
        for doc, sha, size, last, chunk in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_sha256", "bytes", "last", "chunk")), strict=True):
            whole = combine(whole, chunk_hash(chunk, powers))
            if last:
                rows.append((doc, sha, whole[0] << 31 | whole[1], size))
                whole = (0, 0, 0)
        doc, sha, fp, size = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sha, pa.string()), pa.array(fp, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "text_sha256", "fp", "bytes"])


def _chunks(data: Column) -> Column:
    """The chunks of a binary value; one empty chunk if it is empty."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(data) / CHUNK).cast("int") - 1, F.lit(0))), lambda i: F.substring(data, i * CHUNK + 1, F.lit(CHUNK)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, fp, bytes of each row. Texts travel in chunks, so a huge one never is one Arrow value."""
    data = docs.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"), F.encode("text", "utf-8").alias("data"))
    rows = data.select("doc_id", "text_sha256", F.length("data").cast("long").alias("bytes"), F.posexplode(_chunks(F.col("data"))).alias("no", "chunk"))
    rows = rows.select("doc_id", "text_sha256", "bytes", ((F.col("no") + 1) * CHUNK >= F.col("bytes")).alias("last"), "chunk")
    return rows.mapInArrow(_fingerprints, FINGERPRINT)


def unlike(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """The (fp, bytes) under which texts differ. Chunks of equal place stream through a least and a greatest for each group, combined before the shuffle.

    Texts are found by their ids. Where an id is null, or has texts of several groups, these groups count as differing too.
    """
    members = stored(prints.select(F.col("doc_id").alias("member"), "fp", "bytes").distinct().join(groups, ["fp", "bytes"]), "members")
    by_id = members.where("member is not null").groupBy("member").agg(F.min(F.struct("fp", "bytes")).alias("k"), F.count("*").alias("n"))
    own = by_id.where("n = 1").select("member", "k.fp", "k.bytes")
    rows = perhaps(docs, ["doc_id"], own.withColumnRenamed("member", "doc_id")).join(own, F.col("doc_id") == F.col("member")).select("fp", "bytes", F.encode("text", "utf-8").alias("data")).where("length(data) = bytes")
    rows = rows.select("fp", "bytes", F.posexplode(_chunks(F.col("data"))).alias("no", "chunk"))
    differ = rows.groupBy("fp", "bytes", "no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("fp", "bytes")
    several = members.join(by_id.where("n > 1").select("member"), "member", "left_semi").select("fp", "bytes")
    return differ.unionByName(members.where("member is null").select("fp", "bytes")).unionByName(several).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of identical texts; of each, the row with the largest doc_id stays.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose fingerprint and length are shared are compared chunk by chunk; should texts differ under one
    fingerprint (or one doc_id have several texts), that group is parted by SHA-256.

    Null counts as the empty text. Rows that repeat one doc_id and text are each kept if that id stays. A null
    doc_id never wins against another; a group of null ids alone has keep_id null and is kept. Very long texts travel in chunks. An empty table gives no rows.
    Only the two columns are read, so others may have any names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = stored(fingerprints(docs), "fingerprints")
    # stored, as below: of joins of plain exchanges, Spark splits a hot group
    groups = stored(prints.groupBy("fp", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("fp", "bytes"), "shared")
    differ = stored(unlike(docs, prints, groups), "unlike")
    marked = prints.join(small(differ.withColumn("differ", F.lit(True)), 100_000), ["fp", "bytes"], "left")
    marked = marked.withColumn("part", F.when(F.col("differ"), F.col("text_sha256")).otherwise("")).drop("differ")
    sizes = stored(marked.groupBy("fp", "bytes", "part").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"), "groups")
    out = marked.join(sizes, ["fp", "bytes", "part"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
