"""Importance resampling towards a target distribution, by hashed n-grams that DuckDB counts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import closing

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.operators.ordinals import numbered

from .common import LOWER, UPPER, read, stored, texts

BUCKETS = 10_000
#: Words that a document must have to be drawn, and the share of such documents that is drawn, in hundredths.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Bytes of text that DuckDB counts at once, but for a longer word, and the memory that it may take. It has no folder to spill to.
SLICE_BYTES, MEMORY = 1 << 19, "256MB"
#: Bytes of a row group of the counts, which a task holds until it is written.
GROUP_BYTES = 1 << 23
#: What lies between words, once A-Z are lower-cased.
BETWEEN = rb"\x00-\x2F\x3A-\x60\x7B-\x7F"
_GAP, _FIRST, _LAST = re.compile(rb"[%b]" % BETWEEN), re.compile(rb"[^%b]+" % BETWEEN), re.compile(rb"[^%b]+(?=[%b]*\Z)" % (BETWEEN, BETWEEN))
COUNTED = "doc_id long, n_words long, n_features long, buckets array<short>, counts array<int>, sums array<long>"
#: Rows that are weighed at once.
WEIGHED_ROWS = 256

#: A text's words, its runs of one and two words, and how many of these each bucket holds. Rows come in the order of their texts, so the next word is one row on.
GRAMS = rf"""
WITH words AS (SELECT place, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM slice),
pairs AS (SELECT place, word, lead(word) OVER () AS next, lead(place) OVER () AS next_place FROM words),
grams AS (SELECT place, unnest(CASE WHEN next_place = place THEN [word, word || ' ' || next] ELSE [word] END) AS gram FROM pairs)
SELECT place, zlib_crc32(gram) % {BUCKETS} AS bucket, count(*) AS n FROM grams GROUP BY ALL
"""


def crc32(grams: pa.Array | pa.ChunkedArray) -> pa.Array:
    data = (grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams).cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].tolist()
    raw, crc = data.buffers()[2].to_pybytes() if data.buffers()[2] else b"", zlib.crc32
    return pa.array(np.array([crc(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(place: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.searchsorted(place, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _found(db: duckdb.DuckDBPyConnection, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bucket, n) of the texts' grams."""
    db.register("slice", pa.table({"place": pa.array(np.arange(len(texts_))), "text": texts_}))
    found = db.sql(GRAMS).to_arrow_table()
    db.unregister("slice")
    return tuple(np.asarray(found.column(c), np.int64) for c in ("place", "bucket", "n"))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A lower-cased text in pieces of about SLICE_BYTES that end between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _long(db: duckdb.DuckDBPyConnection, text: bytes) -> np.ndarray:
    """The buckets' counts of a long text, piece by piece, with the pairs of words across pieces."""
    out, before = np.zeros(BUCKETS, np.int64), None
    for piece in _pieces(text.lower()):
        _, bucket, n = _found(db, pa.array([piece], pa.binary()).cast(pa.string()))
        out += np.bincount(bucket, n, BUCKETS).astype(np.int64)
        if before is not None and (first := _FIRST.search(piece)):
            out[zlib.crc32(before + b" " + first[0]) % BUCKETS] += 1
        before = last[0] if (last := _LAST.search(piece)) else before
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; at the end one for the partition, with the sum of its buckets."""
    whole, names = np.zeros(BUCKETS, np.int64), [c.split()[0] for c in COUNTED.split(", ")]
    with closing(duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})) as db:
        db.create_function("zlib_crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
        for batch in batches:
            for part in _slices(batch):
                rows = part.num_rows
                if rows == 1 and (text := part.column("text")[0].as_buffer()).size > SLICE_BYTES:
                    n = _long(db, text.to_pybytes())
                    bucket = np.flatnonzero(n)
                    place, n = np.zeros(len(bucket), np.int64), n[bucket]
                else:
                    place, bucket, n = _found(db, part.column("text"))
                    order = np.argsort(place * BUCKETS + bucket)
                    place, bucket, n = place[order], bucket[order], n[order]
                whole += np.bincount(bucket, n, BUCKETS).astype(np.int64)
                features = np.bincount(place, n, rows).astype(np.int64)
                words = (features + 1) // 2  # a text of w words has w single ones and w - 1 pairs
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(features), _lists(place, rows, bucket, pa.int16()), _lists(place, rows, n, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))], names)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([0]) for _ in "ab"), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.list_(pa.int32())), pa.array([whole], pa.list_(pa.int64()))], names)


def bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, n_words, n_features, buckets and their counts of each text, as Parquet in the shared folder; and a row of sums for each partition."""
    return stored(docs.mapInArrow(_counted, COUNTED), name, **{"parquet.block.size": GROUP_BYTES})


def totals(counted: DataFrame) -> DataFrame:
    """(bucket, n): BUCKETS rows at most."""
    each = counted.where("sums is not null").select(F.posexplode("sums").alias("bucket", "n"))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """Each bucket's gain, from (bucket, n) of the corpus and the target: how much likelier the target is to have it, as 1,000 times the logarithm, floored."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    size = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    odds = (F.col("t") + 1).cast("double") * float(size.s + BUCKETS) / ((F.col("s") + 1).cast("double") * float(size.t + BUCKETS))
    found = both.select("bucket", F.floor(F.lit(1000.0) * F.ln(odds)).alias("gain")).collect()  # BUCKETS rows
    return [r.gain for r in sorted(found)]


def _weighed(gain: list[int]):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(gain, np.int64)
        for batch in batches:
            for part in (batch.slice(k, WEIGHED_ROWS) for k in range(0, batch.num_rows, WEIGHED_ROWS)):
                buckets, counts = part.column("buckets"), part.column("counts")
                ends = np.append(0, np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False)))
                sums = np.append(0, np.cumsum(own[buckets.flatten().to_numpy()] * counts.flatten().to_numpy()))
                features = part.column("n_features").to_numpy()
                weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), part.column("n_features"), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return weighed


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw of the document, 1,000-fold and floored, from a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Draws documents without replacement, likelier the more their words and pairs of words are like the target's.

    Returns a row per document: doc_id, n_words, n_features, weight, score, rank. Of the documents of least_words words at least, `percent` in a hundred are
    drawn, those of the highest scores (ties: the smaller doc_id); rank is 1, 2, 3, ... in that order, null for the others.

    DuckDB, in each task, cuts texts into words, pairs each with the next by a window, and counts the buckets of a CRC function; the counts are
    written as Parquet. Spark sums the partitions' buckets, and scores each document from its own. A weight is the floored mean of the buckets' gains, a
    score adds a Gumbel draw from a hash of the id, so the highest scores are a weighted draw. Ranks come from ranges of the order.

    Null and empty texts have no features, weight 0, and aren't drawn. A null doc_id draws as an empty one and comes last among ties. Repeated rows each
    have a row; they tie. A very long text is counted piece by piece, whole. An empty target or table is all zeros; no rows from no rows.
    Only the two columns are read, so others may have any names.
    """
    own = bucket_counts(texts(docs, id_col, text_col), "bucket-counts")
    other = bucket_counts(texts(target.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col), "target-counts")
    gain = gains(totals(own), totals(other))
    weighed = own.where("sums is null").select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    ranked = numbered(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by SQL: the register after each byte, from a table of 256 words, each of eight halvings of its index.
CRC_TABLE = "SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen({0})::BIGINT), lambda z: ('0x' || substr(hex(encode({0})), 2 * z + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"
ORACLE = rf"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
bg AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM b),
h AS (SELECT g, {CRC_SQL.format("g")} % 10000 AS k FROM (SELECT g FROM dg UNION SELECT g FROM bg), crc),
s AS (SELECT k, count(*)::DOUBLE AS s FROM dg JOIN h USING (g) GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS t FROM bg JOIN h USING (g) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k), n),
w AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM dg JOIN h USING (g) JOIN gain USING (k) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS k FROM x WHERE words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
