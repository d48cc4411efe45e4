"""Substring deduplication by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, read, stored, texts
from .exchange import FAN, Entries, answered, exchanged, in_blocks, told
from .wordhash import Text, mix, units

WINDOW = 13
#: Words of a minimiser.
GRAM = 5
#: Input bytes of a block of documents, whose equal super-k-mers travel once.
BLOCK_BYTES = 1 << 24
#: A minimiser with more than this share of all super-k-mers is hot: its windows travel one by one. So there are few hot ones at any size.
HOT_SHARE = 1 / 10_000
#: A task reports minimisers of at least so many super-k-mers.
REPORTED = 16
LAST = np.iinfo(np.int64).max


class Runs:
    """A unit's super-k-mers: runs of consecutive windows of one row that share a minimiser."""

    def __init__(self, words: list[bytes], parts: list[tuple[int, int, int]], hot: np.ndarray):
        n = len(words)
        lengths = np.array([p[2] for p in parts])
        part = np.repeat(np.arange(len(parts)), lengths)
        windows = np.arange(max(n - WINDOW + 1, 0))
        valid = part[: len(windows)] == part[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
        self.text = Text(b" ".join(words))
        if not valid.any():
            self.first = self.size = self.row = self.place = np.zeros(0, np.int64)
            self.minimiser = self.route = np.zeros(0, np.uint64)
            return
        grams = np.arange(n - GRAM + 1)
        least, width = self.text.hashes(grams, grams + GRAM - 1), 1
        while width < WINDOW - GRAM + 1:
            step = min(width, WINDOW - GRAM + 1 - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        new = np.append(True, (least[1:] != least[:-1]) | (part[1 : len(windows)] != part[: len(windows) - 1]) | ~valid[:-1])
        if len(hot):
            single = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
            new |= single
            new[1:] |= single[:-1]
        new |= ~valid
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(windows)))
        keep = valid[at]
        self.first, self.size = at[keep], size[keep]
        self.minimiser = least[self.first]
        self.route = self.minimiser
        if len(hot):
            self.route = np.where(single[self.first], self.text.hashes(self.first, self.first + WINDOW - 1), self.route)
        rows, places = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        own = part[self.first]
        starts = np.append(0, np.cumsum(lengths)[:-1])
        self.row, self.place = rows[own], places[own] + self.first - starts[own]

    def packed(self) -> list[bytes]:
        """Each super-k-mer as one string."""
        joined = self.text.joined
        return [joined[a:b] for a, b in zip(self.text.starts[self.first].tolist(), self.text.ends[self.first + self.size + WINDOW - 2].tolist(), strict=True)]


def _split(batch: pa.RecordBatch | pa.Table) -> Iterator[list[bytes]]:
    return (t.as_py().encode().split() for t in batch.column("text"))


def hot_minimisers(docs: DataFrame) -> list[int]:
    """Minimisers with more than HOT_SHARE of all super-k-mers, 1 / HOT_SHARE at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)] + [Runs(*u, np.zeros(0, np.uint64)).minimiser for u in units(_split(batch), WINDOW - 1)]
            value, n = np.unique(np.concatenate(found), return_counts=True)
            often = n >= REPORTED
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value[often].view(np.int64), 0)), pa.array(np.append(n[often], n.sum())), pa.array([*[False] * int(often.sum()), True])], ["minimiser", "n", "total"])

    seen = stored(docs.mapInArrow(count, "minimiser long, n long, total boolean").groupBy("minimiser", "total").agg(F.sum("n").alias("n")), "minimisers")
    total = seen.where("total").agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in seen.where(~F.col("total") & (F.col("n") > max(total * HOT_SHARE, REPORTED))).select("minimiser").collect()]


class Block:
    """A block's distinct super-k-mers, numbered as they come, and where each occurs."""

    def __init__(self, table: pa.Table, hot: np.ndarray):
        # a shuffle's rows come in any order, and the numbers must be the same each time that the block is read
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table.column("doc_id").combine_chunks()
        self.docs = np.asarray(ids.fill_null(LAST)) if len(ids) else np.zeros(0, np.int64)
        self.joined: list[bytes] = []
        self.known: dict[bytes, int] = {}
        number, row, place, size, route = [], [], [], [], []

        def rows() -> Iterator[list[bytes]]:
            for words in _split(table):
                self.joined.append(b" ".join(words))
                yield words

        for words, parts in units(rows(), WINDOW - 1):
            runs = Runs(words, parts, hot)
            known = self.known
            number.append(np.array([known.setdefault(p, len(known)) for p in runs.packed()], np.int64))
            for to, x in ((row, runs.row), (place, runs.place), (size, runs.size), (route, runs.route)):
                to.append(x)
        self.number, self.row, self.place, self.size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (number, row, place, size))
        self.least, self.most = np.full(len(self.known), LAST), np.full(len(self.known), np.iinfo(np.int64).min)
        own = self.docs[self.row]
        np.minimum.at(self.least, self.number, own)
        np.maximum.at(self.most, self.number, own)
        self.windows, self.route = np.zeros(len(self.known), np.int64), np.zeros(len(self.known), np.uint64)
        self.windows[self.number] = self.size
        self.route[self.number] = np.concatenate([np.zeros(0, np.uint64), *route])


def _pressed(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Arrays of one length, the first one as differences, and a text. Numbers go by their bytes' places, which compress better."""
    first, *rest = arrays
    planes = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(first, prepend=0), *rest)]
    return zstandard.ZstdCompressor(level=5).compress(np.int64(len(first)).tobytes() + b"".join(planes) + text)


def _opened(data: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = [np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8 + 8 * n * k).reshape(8, -1).T).view("<i8").ravel() for k in range(arrays)]
    out[0] = np.cumsum(out[0])
    return out, data[8 + 8 * n * arrays :]


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _send(buckets: int, hot: np.ndarray):
    def send(table: pa.Table) -> Entries:
        block = Block(table, hot)
        to = (mix(block.route) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        packed = list(block.known)
        return [(int(to[own[0]]), _pressed(own, block.windows[own], block.least[own], text=b"\n".join([packed[k] for k in own]))) for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(own)]

    return send


def _count(bucket: int, entries: Entries) -> Entries:
    """A bucket: its windows are sorted, and for those that occur in another block with a smaller document, that document is sent back."""
    source, sizes, joined, cols = [], [], [], []
    for k, (_, data) in enumerate(entries):
        (number, windows, least), raw = _opened(data, 3)
        text = Text(raw)
        first_word = np.append(0, np.cumsum(windows + WINDOW - 1)[:-1])
        run = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(len(run)) - np.append(0, np.cumsum(windows)[:-1])[run]
        first = first_word[run] + offset
        joined.append(raw)
        cols.append((text.hashes(first, first + WINDOW - 1), np.full(len(run), k), number[run], offset, least[run], text.starts[first], text.ends[first + WINDOW - 1]))
    h, source, number, offset, least, start, end = (np.concatenate(c) for c in zip(*cols, strict=True))
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1  # of a window that occurs once, nothing need be told
    order, new = order[often], new[often]
    if not len(order):
        return []
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    strings = [joined[k][a:b] for k, a, b in zip(source[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True)]
    lead = None
    unlike = set()
    for k, (is_new, s) in enumerate(zip(new.tolist(), strings, strict=True)):
        if is_new:
            lead = s
        elif s != lead:
            unlike.add(int(group[k]))
    minimum = np.minimum.reduceat(least[order], starts)[group]
    for g in unlike:  # one hash, several windows
        at = starts[g] + np.arange(np.count_nonzero(group == g))
        own: dict[bytes, int] = {}
        for k in at:
            own[strings[k]] = min(own.get(strings[k], LAST), int(least[order[k]]))
        for k in at:
            minimum[k] = own[strings[k]]
    told = minimum < least[order]
    order, minimum = order[told], minimum[told]
    block = np.array([k for k, _ in entries])[source[order]]
    by = np.argsort(block, kind="stable")
    return [(int(block[own[0]]), _pressed(number[order[own]], offset[order[own]], minimum[own])) for own in np.split(by, np.flatnonzero(np.diff(block[by])) + 1) if len(own)]


def _cut(hot: np.ndarray):
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(table, hot)
        opened = [_opened(data, 3)[0] for _, data in told(found)]
        number, offset, minimum = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*opened, strict=True) if opened else ((), (), ())))
        order = np.argsort(number, kind="stable")
        number, offset, minimum = number[order], offset[order], minimum[order]
        words = np.array([j.count(b" ") + 1 if j else 0 for j in block.joined], np.int64)
        base = np.append(0, np.cumsum(words))
        own, at = block.docs[block.row], base[block.row] + block.place
        step = np.zeros(base[-1] + 1, np.int64)
        here = block.least[block.number] < own  # a document of this block has all windows of the run
        np.add.at(step, at[here], 1)
        np.add.at(step, at[here] + block.size[here] + WINDOW - 1, -1)
        lo, hi = np.searchsorted(number, block.number, "left"), np.searchsorted(number, block.number, "right")
        n = np.where(here, 0, hi - lo)
        run = np.repeat(np.arange(len(n)), n)
        entry = lo[run] + np.arange(len(run)) - np.append(0, np.cumsum(n)[:-1])[run] if len(run) else np.zeros(0, np.int64)
        hit = minimum[entry] < own[run] if len(run) else np.zeros(0, bool)
        places = at[run[hit]] + offset[entry[hit]] if len(run) else np.zeros(0, np.int64)
        np.add.at(step, places, 1)
        np.add.at(step, places + WINDOW, -1)
        gone = np.cumsum(step)[:-1] > 0
        removed = np.diff(np.append(0, np.cumsum(gone))[base]) if len(words) else words
        kept = []
        for k, joined in enumerate(block.joined):
            if removed[k]:
                joined = b" ".join([w for w, g in zip(joined.split(b" "), gone[base[k] : base[k + 1]].tolist(), strict=True) if not g])
            kept.append(joined.decode())
        return pa.table([block.table.column("doc_id"), pa.array(words), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """Removes from each document the words in 13-word windows that also start in a document with a smaller doc_id.

    Returns a row per input row: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    Documents are dealt into blocks. A block sends each of its distinct super-k-mers once, as a packed string with the
    least document that has it, to the bucket of its minimiser; there windows are sorted by hash and compared as
    strings, and for each that a smaller document of another block has, the bucket sends this document back. So a passage
    that very many documents share comes to a bucket once for each block, and nothing grows with a group's square. Super-k-mers
    of hot minimisers (common lines among changing words) travel window by window, each to the bucket of its own hash.

    Words are what ASCII white space parts; null and empty texts have none. Fewer than 13 words are no window. Rows with equal
    doc_id don't cut each other. A null doc_id counts as larger than any other. Repeated rows each give a row; those that repeat
    both id and text are one block's. Very long texts are read whole, by one task. An empty table gives no rows. Only the two columns are read, so others may have any names.
    """
    docs = texts(docs, id_col, text_col)
    hot = np.sort(np.array(hot_minimisers(docs), np.int64).view(np.uint64))
    n = blocks(docs, BLOCK_BYTES)
    dealt = in_blocks(docs, n)
    found = exchanged(dealt, _send(2 * n, hot), _count, n, 2 * n, fan)
    return answered(dealt, found, n, _cut(hot), KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN p USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
