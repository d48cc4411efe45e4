"""Substring deduplication of bytes by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, read, stored, texts
from .exchange import FAN, Entries, answered, exchanged, in_blocks, told
from .suffix_array import suffix_array
from .tally import asked, lots, numbers, places, planes, replier, replies, squeezed
from .wordhash import mix

#: Bytes of a string that counts.
WINDOW = 50
#: Bytes of an anchor: of the grams in a window the one with the least hash.
GRAM = 24
#: Bytes that are hashed at once; a place within them fits into PLACE_BITS.
UNIT, PLACE_BITS = 1 << 16, 18
#: Odd numbers.
MULTIPLIERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)))
#: Input bytes of a block of documents.
BLOCK_BYTES = 1 << 23
#: The windows of an anchor with more strings than this, those of each block counted by themselves, travel one by one.
HOT = 16_384
#: Blocks tell an anchor's strings and whether one or several rows have it in one number: strings * SEVERAL + rows, 2 rows at most. Their sum is exact up to half as many blocks.
SEVERAL = 1 << 20
#: Bytes that are sorted at once. Only the strings of one anchor, HOT of them and fewer than 2 * WINDOW bytes each, may be more.
LOT = 1 << 20
LAST = np.iinfo(np.int64).max
DEDUPED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _mixed(words: np.ndarray, n: int, places: range) -> np.ndarray:
    """A hash, at each of n places, of the 8-byte words that start so many bytes on."""
    out = words[:n] * MULTIPLIERS[0]
    for k, at in enumerate(places, 1):
        out ^= out >> np.uint64(29)
        out += words[at : at + n]
        out *= MULTIPLIERS[k % len(MULTIPLIERS)]
    return out


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each place, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, size, hash) of the runs of consecutive windows of each part with one anchor. A window's anchor follows from its bytes alone."""
    return _anchored(parts)[:4]


def _anchored(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors(), and a hash of each run's bytes."""
    data = b"".join(parts)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    words = _words(data) * MULTIPLIERS[-1]
    words ^= words >> np.uint64(31)
    grams = _mixed(words, len(data) - GRAM + 1, range(8, GRAM - 7, 8))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = grams & ~low
    least |= np.arange(len(grams), dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while width < span:
        step = min(width, span - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    sizes = np.array([len(x) for x in parts])
    ends = np.cumsum(sizes)
    new = np.append(True, least[1:] != least[:-1])
    edges = np.concatenate([ends - sizes, ends - WINDOW + 1])  # from its last window on, a part's windows reach into the next one
    new[edges[(edges >= 0) & (edges < n)]] = True
    first = np.flatnonzero(new)
    part = np.searchsorted(ends, first, "right")
    own = first + WINDOW <= ends[part]
    size = np.diff(np.append(first, n))[own]
    first, part = first[own], part[own]
    string, last = grams[first], first + size + WINDOW - 1 - GRAM
    for at in (first + GRAM, np.minimum(first + 2 * GRAM, last), last):  # no run has more bytes than four grams
        string ^= string >> np.uint64(29)
        string *= MULTIPLIERS[0]
        string += grams[at]
    return part, first - (ends - sizes)[part], size, grams[(least[first] & low).astype(np.int64)], string


class Rows:
    """A block's rows, in a fixed order."""

    def __init__(self, table: pa.Table):
        # a shuffle's rows come in any order, and the numbers must be the same each time that the block is read
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table.column("doc_id").combine_chunks()
        self.docs = np.asarray(ids.fill_null(LAST)) if len(ids) else np.zeros(0, np.int64)

    def texts(self) -> Iterator[bytes]:
        return (t.as_buffer().to_pybytes() for t in self.table.column("text").cast(pa.binary()))


class Runs(Rows):
    """The runs of a block's rows: row, first byte in the row, windows, anchor hash, hash of its bytes."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for rows, starts, parts in self._units():
            part, first, size, anchor, string = _anchored(parts)
            for to, x in zip(cols, (rows[part], starts[part] + first, size, anchor, string), strict=True):
                to.append(x)
        self.row, self.first, self.size, self.anchor, self.string = map(np.concatenate, cols)

    def _units(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Texts, or overlapping parts of long ones, of about UNIT bytes together: their rows, where each starts, and their bytes."""
        rows: list[int] = []
        starts: list[int] = []
        parts: list[bytes] = []
        total = 0
        for k, data in enumerate(self.texts()):
            for at in range(0, max(len(data) - WINDOW + 1, 0), UNIT):
                part = data[at : at + UNIT + WINDOW - 1] if len(data) > UNIT else data
                rows.append(k)
                starts.append(at)
                parts.append(part)
                total += len(part)
                if total >= UNIT:
                    yield np.array(rows), np.array(starts), parts
                    rows, starts, parts, total = [], [], [], 0
        if parts:
            yield np.array(rows), np.array(starts), parts

    def of_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors, sorted; each run's number among them; how many rows have each."""
        order = np.argsort(self.anchor, kind="stable")  # rows rise within an anchor
        anchor, row = self.anchor[order], self.row[order]
        new = np.append(True, anchor[1:] != anchor[:-1])[: len(order)]
        place = np.cumsum(new) - 1
        number = np.empty(len(order), np.int64)
        number[order] = place
        other = new | np.append(True, row[1:] != row[:-1])[: len(order)]
        return anchor[new], number, np.bincount(place[other], minlength=int(new.sum()))


def _ask(buckets: int, hot: int):
    """Blocks ask whether several rows have each of their anchors, and how many strings. Copies in a block are one string."""

    def ask(table: pa.Table) -> Entries:
        own = Runs(table)
        distinct, number, rows = own.of_anchors()
        _, at = np.unique(own.string, return_index=True)
        strings = np.bincount(number[at], minlength=len(distinct))
        return asked(distinct, np.minimum(strings, hot + 1) * SEVERAL + np.minimum(rows, 2), buckets)

    return ask


def _state(hot: int):
    """0: one row has the anchor, 1: several, 2: several, and there are more than `hot` strings."""

    def state(told: np.ndarray) -> np.ndarray:
        told = told.astype(np.int64)
        several = told % SEVERAL > 1
        return several.astype(np.uint8) + (several & (told // SEVERAL > hot))

    return state


class Strings(Runs):
    """Of the runs whose anchor several rows have, the distinct strings, and where each occurs. A hot anchor's run is a string for each window."""

    def __init__(self, table: pa.Table, answers: Entries, buckets: int):
        super().__init__(table)
        distinct, number, _ = self.of_anchors()
        state = replies(distinct, answers, buckets)[number]
        own, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        each = np.repeat(hot, self.size[hot])
        offset = np.arange(len(each)) - np.repeat(np.cumsum(self.size[hot]) - self.size[hot], self.size[hot])
        run, size = np.append(own, each), np.append(self.size[own], np.ones(len(each), np.int64))
        first, single = self.first[run] + np.append(np.zeros(len(own), np.int64), offset), np.arange(len(run)) >= len(own)
        order = np.lexsort((first, self.row[run]))
        self.at_row, self.at, self.windows = self.row[run][order], first[order], size[order]
        known: dict[bytes, int] = {}
        ends = np.searchsorted(self.at_row, np.arange(len(self.docs) + 1))
        number = np.zeros(len(order), np.int64)
        for k, data in enumerate(self.texts()):
            a, b = ends[k], ends[k + 1]
            if a < b:
                number[a:b] = [known.setdefault(data[x : x + w + WINDOW - 1], len(known)) for x, w in zip(self.at[a:b].tolist(), self.windows[a:b].tolist(), strict=True)]
        self.number, self.strings = number, list(known)
        self.least = np.full(len(known), LAST)
        np.minimum.at(self.least, number, self.docs[self.at_row])
        anchor, alone = np.zeros(len(known), np.uint64), np.zeros(len(known), bool)
        anchor[number], alone[number] = self.anchor[run][order], single[order]
        self.to, self.bits = places(anchor, buckets)
        if len(k := np.flatnonzero(alone)):  # a hot anchor's windows spread by all their bytes
            data = np.zeros((len(k), -(-WINDOW // 8) * 8), np.uint8)
            data[:, :WINDOW] = np.frombuffer(b"".join([self.strings[j] for j in k.tolist()]), np.uint8).reshape(-1, WINDOW)
            h = mix(data.view("<u8") + np.arange(data.shape[1] // 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
            self.to[k], self.bits[k] = places(h, buckets)

    def noted(self) -> bytes:
        """Which string is where, for _cut()."""
        return b"s" + squeezed(planes(self.at_row, np.diff(self.at, prepend=0), self.windows, np.diff(self.number, prepend=0)))


def _tell(buckets: int):
    """Blocks send each of their strings once, with the least document that has it, to its anchor's bucket; and to some bucket, which sends it back, where their strings are."""

    def tell(table: pa.Table, earlier: pa.Table) -> Entries:
        own = Strings(table, told(earlier), buckets)
        sizes = np.array([len(s) for s in own.strings], np.int64)
        out = [(int(own.to[k[0]]), squeezed(planes(k, own.bits[k], own.least[k], sizes[k]) + b"".join([own.strings[j] for j in k.tolist()]))) for k in lots(own.to)]
        return [*out, (table.column("block")[0].as_py() % buckets, own.noted())]

    return tell


def _repeated(strings: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The stretches of the strings whose windows' hashes are there twice or more, their strings, and where they start. No other window can have an equal."""
    joined = b"".join(strings)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    h = _mixed(_words(joined), len(joined) - WINDOW + 1, [*range(8, WINDOW - 8, 8), WINDOW - 8])
    at = np.arange(len(h))
    string = np.searchsorted(starts, at, "right") - 1
    own = np.flatnonzero(at + WINDOW <= (starts + sizes)[string])
    order = np.argsort(h[own], kind="stable")
    equal = h[own][order][1:] == h[own][order][:-1]
    often = np.zeros(len(own), bool)
    often[order[1:][equal]] = often[order[:-1][equal]] = True
    first = own[often]
    new = np.append(True, (first[1:] != first[:-1] + 1) | (string[first[1:]] != string[first[:-1]]))[: len(first)]
    begin, end = first[new], np.append(first[:-1][new[1:]], first[-1:]) + WINDOW
    return [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], string[begin], begin - starts[string[begin]]


def equal_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of the windows that the strings have twice or more: equal ones have one class. By the suffix array of all stretches that may be repeated."""
    parts, owner, start = _repeated(strings)
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    joined = b"\0".join(parts) + b"\0"
    sizes = np.array([len(s) for s in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(joined, np.uint8).astype(np.int32) + 2
    text[starts + sizes] = 1
    text[-1] = 0
    part = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(text)) - starts[part]
    order = suffix_array(text)
    order = order[offset[order] + WINDOW <= sizes[part[order]]]
    words = _words(joined)
    same = np.ones(len(order) - 1, bool)
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        here = words[order + k]
        same &= here[1:] == here[:-1]
    part, offset = part[order], offset[order]
    return owner[part], start[part] + offset, np.cumsum(np.append(True, ~same)) - 1


def _meet(lot_bytes: int):
    def meet(bucket: int, entries: Entries) -> Entries:
        """A bucket: which windows of a block's strings a smaller document has too, as (string, first window, windows, document); and the blocks' notes as they are."""
        notes = [x for x in entries if x[1][:1] == b"s"]
        entries = [x for x in entries if x[1][:1] != b"s"]
        if not entries:
            return notes
        opened = [numbers(zstandard.decompress(data), 4) for _, data in entries]
        number, bits, least, size = (np.concatenate([o[0][k] for o in opened]) for k in range(4))
        source = np.repeat(np.arange(len(entries)), [len(o[0][0]) for o in opened])
        known: dict[bytes, int] = {}
        same = np.zeros(len(number), np.int64)
        k = 0
        for (_, _, _, sizes), raw in opened:
            at = 0
            for n in sizes.tolist():
                same[k] = known.setdefault(raw[at : at + n], len(known))
                k, at = k + 1, at + n
        strings = list(known)
        first = np.full(len(strings), LAST)
        np.minimum.at(first, same, least)
        anchor = np.zeros(len(strings), np.int64)
        anchor[same] = bits
        found = [(np.arange(len(strings)), np.zeros(len(strings), np.int64), np.array([len(s) for s in strings], np.int64) - WINDOW + 1, first)]
        # strings of one anchor may share windows, others can't
        sorted_together, total = [[]], 0
        for own in lots(anchor):
            if len(own) > 1:
                if total > lot_bytes:
                    sorted_together.append([])
                    total = 0
                sorted_together[-1] += own.tolist()
                total += sum(len(strings[j]) + 1 for j in own.tolist())
        for lot in sorted_together:
            if lot:
                string, offset, group = equal_windows([strings[j] for j in lot])
                string = np.array(lot)[string]
                least_of = np.full(group[-1] + 1 if len(group) else 0, LAST)
                np.minimum.at(least_of, group, first[string])
                smaller = least_of[group] < first[string]
                string, offset, doc = string[smaller], offset[smaller], least_of[group][smaller]
                order = np.lexsort((offset, string))
                string, offset, doc = string[order], offset[order], doc[order]
                new = np.flatnonzero(np.append(True, (np.diff(string) != 0) | (np.diff(offset) != 1) | (np.diff(doc) != 0))) if len(string) else np.zeros(0, np.int64)
                found.append((string[new], offset[new], np.diff(np.append(new, len(string))), doc[new]))
        string, offset, windows, doc = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(string, kind="stable")
        string, offset, windows, doc = string[order], offset[order], windows[order], doc[order]
        lo, hi = np.searchsorted(string, same, "left"), np.searchsorted(string, same, "right")
        entry = np.repeat(np.arange(len(same)), hi - lo)
        at = lo[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        useful = doc[at] < least[entry]
        entry, at = entry[useful], at[useful]
        return notes + [(entries[source[entry[own[0]]]][0], b"w" + squeezed(planes(number[entry[own]], offset[at[own]], windows[at[own]], doc[at[own]]))) for own in lots(source[entry])]

    return meet


def _cut():
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        said, own = told(found), Rows(table)
        noted = [numbers(zstandard.decompress(x[1:]), 4)[0] for _, x in said if x[:1] == b"s"]
        at_row, at, runs, string = noted[0] if noted else (np.zeros(0, np.int64),) * 4
        at, string = np.cumsum(at), np.cumsum(string)
        least = np.full(len(string), LAST)
        np.minimum.at(least, string, own.docs[at_row])
        opened = [numbers(zstandard.decompress(x[1:]), 4)[0] for _, x in said if x[:1] == b"w"]
        number, offset, windows, doc = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*opened, strict=True) if opened else ((), (), (), ())))
        order = np.argsort(number, kind="stable")
        number, offset, windows, doc = number[order], offset[order], windows[order], doc[order]
        mine = own.docs[at_row]
        here = least[string] < mine  # a document of this block has all windows of the string
        lo, hi = np.searchsorted(number, string, "left"), np.searchsorted(number, string, "right")
        n = np.where(here, 0, hi - lo)
        run = np.repeat(np.arange(len(n)), n)
        entry = lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hit = doc[entry] < mine[run]
        run, entry = run[hit], entry[hit]
        row = np.append(at_row[here], at_row[run])
        first = np.append(at[here], at[run] + offset[entry])
        last = first + np.append(runs[here], windows[entry]) + WINDOW - 1
        order = np.argsort(row, kind="stable")
        row, first, last = row[order], first[order], last[order]
        ends = np.searchsorted(row, np.arange(len(own.docs) + 1))
        cols: list[list] = [[], [], [], []]
        for k, data in enumerate(own.texts()):
            a, b = ends[k], ends[k + 1]
            removed = spans = 0
            kept = data
            if a < b:
                step = np.bincount(first[a:b], minlength=len(data) + 1) - np.bincount(last[a:b], minlength=len(data) + 1)
                gone = np.cumsum(step)[:-1] > 0
                removed, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for to, x in zip(cols, (len(data), removed, spans, kept), strict=True):
                to.append(x)
        return pa.table([own.table.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN, hot: int = HOT, lot: int = LOT) -> DataFrame:
    """Removes from each text the bytes in 50-byte strings that also start in a document with a smaller doc_id.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay; a cut may part a
    character).

    Documents are dealt into blocks. A window's anchor is the gram of it with the least hash, so equal windows have equal anchors. Blocks first
    ask the anchors' buckets which are in several rows; most aren't, and nothing else of their windows travels. Of the others a block sends each distinct run of
    windows once, as a string with the least document that has it. A bucket sorts the suffixes of one anchor's strings by the linear grouping
    construction (see suffix_array()); neighbours that agree in 50 bytes are one window, and each block is told of the windows that
    a smaller document has. Where a block's strings are is noted once, and comes back with that. Nothing grows with a group's square: copies come to a bucket once for each block, and the windows of an anchor with very many
    strings travel one by one, to buckets by all their bytes.

    Null and empty texts have no bytes. Texts of fewer than 50 bytes lose none. Rows with equal doc_id don't cut each other. A null doc_id counts as larger
    than any other. Repeated rows each give a row; those that repeat both id and text are one block's. Very long texts are read whole, by one task. Only
    the two columns are read, so others may have any names. An empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col)
    n = blocks(docs, BLOCK_BYTES)
    dealt = in_blocks(docs, n)
    buckets = fan if n <= fan < 2 * n else 2 * n  # no second level of the exchange where somewhat larger buckets do
    said = stored(exchanged(dealt, _ask(buckets, hot), replier(_state(hot)), n, buckets, fan), "anchors")
    found = exchanged(dealt, _tell(buckets), _meet(lot), n, buckets, fan, before=said)
    return answered(dealt, found, n, _cut(), DEDUPED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are cut from pieces of 500 bytes and 49 more, so that no window is sought in a whole text.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, k * 500 AS base, substr(x, 1000 * k + 1, 1098) AS x FROM (SELECT *, unnest(range(0, n // 500 + 1)) AS k FROM d)),
g AS (SELECT doc_id, base + i AS i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(500, n - base - 49))) AS i FROM c WHERE n - base >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
h AS (SELECT doc_id, i FROM g JOIN m USING (s) WHERE first < doc_id),
a AS (SELECT doc_id, i, i - coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS gap FROM h),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT *, count(*) FILTER (gap > 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a) GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after, row_number() OVER (PARTITION BY doc_id ORDER BY lo DESC) AS last FROM r),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * after + 1, 2 * (lo - after)) || CASE WHEN last = 1 THEN substr(x, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
