"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, size_in_bytes, texts
from .tokens import byte_bpe

LENGTH = 2048
END_ID = 0
#: Bins that a packer keeps open, at most.
OPEN_BINS = 1_000
#: Pieces that a packer looks at together, the longest first. Measured on 184,992 pieces: sequences beyond the least possible are 0.96 % if each
#: is placed as it comes, 0.25 % for 256 at once, 0.06 % for 1,024; 4,000 open bins instead of 1,000 change nothing.
AHEAD = 1_024
#: Input bytes whose pieces one packer gets, and the most packers; these get more each then, which they stream.
PACKER_BYTES, PACKERS = 1 << 25, 8_192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


class BestFit:
    """Bounded-space online best fit: an item goes into the open bin with the least free space that holds it.

    Open bins are stacks by free space, and one integer has a bit for each space that has an open bin. If none holds the item and
    `limit` bins are open, the fullest closes for a new one.
    """

    def __init__(self, size: int, limit: int = OPEN_BINS):
        self.size, self.limit, self.bits, self.open, self.made = size, limit, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The item's bin, and its offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.size
            self.made += 1
        if left := free - length:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than size."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, size: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless asked for)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), size)):
                    own = ids[at : at + n]
                    rows.append((doc, k, at, n, zlib.crc32(own), own.astype(np.int32) if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, size: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", packers: int | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs documents, each with an end token, into sequences of at most `size` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset. Longer documents alone are
    cut, and all their pieces but the first are full sequences.

    Pieces are dealt by a hash to packers, whose number follows the input's size up to PACKERS, and come to each in the order of another hash.
    A packer places AHEAD of them at a time, the longest first, and holds at most open_bins open bins, the fullest of which close, and nothing
    of what it has placed. So each packer ends with some bins less than full, and no more.

    Null and empty texts are one end token. Repeated rows are packed each. Very long texts are cut into many pieces, by one task. An empty table gives no rows. Only the two columns are read, so others may have any names.
    """
    docs = texts(docs, id_col, text_col)
    cut = pieces(docs, size, tokenizer, with_ids)
    if packers is None:
        packers = max(1, min(math.ceil(size_in_bytes(docs) / PACKER_BYTES), PACKERS))
    own = ("doc_id", "piece", "length", "ids_crc32")
    dealt = cut.withColumn("packer", F.pmod(F.xxhash64(*own), F.lit(packers)).cast("int")).repartitionById(packers, "packer")
    dealt = dealt.sortWithinPartitions("packer", F.xxhash64(F.lit(1), *own), *own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = BestFit(size, open_bins), None
        for batch in batches:
            number, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            packer, length = np.asarray(batch.column("packer")), np.asarray(batch.column("length"))
            starts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(packer)) + 1, np.arange(0, batch.num_rows, AHEAD)]).astype(int))
            for at in np.split(np.arange(batch.num_rows), starts[1:]) if batch.num_rows else ():
                if packer[at[0]] != now:
                    bins, now = BestFit(size, open_bins), packer[at[0]]
                for k in at[np.argsort(-length[at], kind="stable")].tolist():
                    n, offset[k] = bins.place(int(length[k]))
                    number[k] = int(now) << 40 | n
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(number), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return dealt.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")
