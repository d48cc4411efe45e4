"""Near copies by the Jaccard similarity of word shingles: links of SimHash fingerprints, each checked, and for what these miss a set join by prefixes, exact, with shingles in the order of their true counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.operators.lineage import components

from . import simhash
from .common import blocks, dropped, lacking, perhaps, sha, stored
from .exchange import Entries, answered, exchanged, in_blocks, told
from .tally import asked, replier, replies

SHINGLE = 5
#: The least similarity, as a fraction: two sets of a and b shingles, c of them shared, are linked if c / (a + b - c) is this at least.
UPPER, LOWER = 4, 5
#: Input bytes of a block of documents.
BLOCK_BYTES = 1 << 23
#: Counts are told exactly up to EXACT, beyond that STEPS to a doubling, in a byte. Any order gives the same links.
EXACT, STEPS = 64, 12
#: Turns in which a token's rows are compared with one of them, before all are.
TURNS = 1
ROWS = "doc_id long, sha string, sig string, n int, fp long, at array<int>, prefix array<long>"


def shingles(text: bytes) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes, as op3_simhash
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def prefix(own: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles by their counts, rarest first; two linked sets share one of them.

    Linked sets share UPPER / LOWER of each of them at least, so of both prefixes, which are longer than what may be missing, the least shared shingle is part.
    """
    n = len(own)
    return own[np.argsort(count, kind="stable")][: n + 1 - -(-n * UPPER // LOWER)] if n else own


def _coded(rows: np.ndarray) -> np.ndarray:
    return np.where(rows <= EXACT, rows, np.minimum(EXACT + STEPS * np.log2(np.maximum(rows, EXACT) / EXACT), 255)).astype(np.uint8)


class Sets:
    """A block's rows, in a fixed order, with their shingles."""

    def __init__(self, table: pa.Table):
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.own = [shingles(t) for t in self.texts()]
        self.distinct, self.number = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.own]), return_inverse=True)

    def texts(self) -> Iterator[bytes]:
        return (t.as_buffer().to_pybytes() for t in self.table.column("text").cast(pa.binary()))


def _ask(buckets: int):
    def ask(table: pa.Table) -> Entries:
        sets = Sets(table)
        return asked(sets.distinct, np.bincount(sets.number, minlength=len(sets.distinct)), buckets)

    return ask


def _rows(buckets: int):
    """Each row with its shingles' signature, its text's SimHash fingerprint, and its prefix: of the shingles that other rows have too, what they are and at which places they stand."""

    def rows(table: pa.Table, found: pa.Table) -> pa.Table:
        sets = Sets(table)
        counts = replies(sets.distinct, told(found), buckets)[sets.number]
        prints = np.fromiter(map(simhash.fingerprint, sets.texts()), np.uint64, len(sets.own)).view(np.int64)
        cols: list[list] = [[], [], [], []]
        for own, count in zip(sets.own, np.split(counts, np.cumsum([len(x) for x in sets.own])[:-1]), strict=True):
            order = np.argsort(count, kind="stable")[: len(prefix(own, count))]
            at = np.flatnonzero(count[order] > 1)
            for to, x in zip(cols, (xxhash.xxh3_128_hexdigest(own.tobytes()), len(own), at.astype(np.int32), own[order][at].view(np.int64)), strict=True):
                to.append(x)
        sig, n, at, first = (pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True))
        return pa.table([sets.table.column("doc_id"), sets.table.column("sha"), sig, n, pa.array(prints), at, first], names=["doc_id", "sha", "sig", "n", "fp", "at", "prefix"])

    return rows


def _data(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.encode("text", "utf-8").alias("data"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            own = [shingles(t.as_buffer().to_pybytes()).view(np.int64) for t in part.column("data")]
            yield pa.RecordBatch.from_arrays([part.column("sha"), pa.array(own, pa.list_(pa.int64()))], ["sha", "shingles"])


def _possible(a: str, b: str) -> Column:
    """Whether two sets of n shingles can be similar enough if the first that they share, in the common order, is the i-th of each.

    Of a later one that they share less is left, so that a pair passes by its first one if by any.
    """
    shared = F.least(F.col(f"{a}.n") - F.col(f"{a}.i"), F.col(f"{b}.n") - F.col(f"{b}.i"))
    return shared * (UPPER + LOWER) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * UPPER


def similar(docs: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose sets of shingles are similar enough, by all their shingles. Only the texts of such rows are read again."""
    pairs = stored(pairs.distinct(), "near-pairs")
    rows = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = stored(own.select("row", "sha").join(rows, "row", "left_semi"), "near-wanted")
    some = perhaps(docs, ["sha"], wanted).join(wanted.select("sha").distinct(), "sha", "left_semi").dropDuplicates(["sha"])
    sets = stored(wanted.join(_data(some, "sha").mapInArrow(_sets, "sha string, shingles array<long>"), "sha").select("row", "shingles"), "near-sets")
    side = lambda c: sets.select(F.col("row").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    counted = both.select("a", "b", F.size("of_a").alias("x"), F.size("of_b").alias("y"), F.size(F.array_intersect("of_a", "of_b")).alias("c"))
    out = stored(counted.where(f"c * {UPPER + LOWER} >= (x + y) * {UPPER}").select("a", "b"), "near-similar")
    for t in (pairs, wanted, sets):
        dropped(t)
    return out


def _placed(tokens: DataFrame, links_: DataFrame) -> DataFrame:
    """Of tokens that rows of several parts have, (token, row, i, n, part); parts are what the links connect."""
    parts = stored(components(links_), "near-parts")
    placed = tokens.drop("part").join(parts, F.col("row") == F.col("node"), "left").select("token", "row", "i", "n", F.coalesce("root", "row").alias("part"))
    placed = stored(placed, "near-placed")
    several = placed.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("token")
    out = stored(placed.join(several, "token", "left_semi"), "near-several")
    for t in (parts, placed):
        dropped(t)
    return out


def across(tokens: DataFrame) -> DataFrame:
    """(a, b): the rows of different parts that share a token and may be similar enough by where it stands in each.

    Of a token's rows only those outside of its largest part meet all others, so one large part costs its size and not its square.
    """
    sizes = tokens.groupBy("token", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    one, other = (F.struct("row", "i", "n", "part").alias(c) for c in ("own", "next"))
    few = tokens.join(largest, "token").where("part <> largest").select("token", one)
    met = few.join(tokens.select("token", other), "token").where((F.col("own.part") != F.col("next.part")) & _possible("own", "next"))
    return met.select(F.least("own.row", "next.row").alias("a"), F.greatest("own.row", "next.row").alias("b"))


def by_fingerprints(heads: DataFrame) -> DataFrame:
    """(a, b): the rows (row, fp) that op3_simhash's method links: those of one fingerprint with the first of them, and the first ones of fingerprints that it links."""
    prints = stored(heads.select("row", "fp"), "near-prints")
    first = stored(prints.groupBy("fp").agg(F.min("row").alias("first")), "near-fingerprints")
    out = prints.join(first, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    if (found := simhash.links(first)) is not None:
        side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
        met = found.distinct().join(side("a"), "a").join(side("b"), "b")
        out = out.unionByName(met.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))
    return out


def links(docs: DataFrame, own: DataFrame, tokens: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): links enough to connect all rows that are similar enough, from near, the pairs of by_fingerprints(), and (token, row, i, n) of the rows' prefixes.

    The pairs of near are compared by all their shingles like any others. In TURNS turns the rows of each token are compared with one of them, that with the fewest rarer shingles before it: among
    variants of a text it is nearest the text, so that this connects most groups with no more pairs than rows. Those of tokens that this leaves in
    several parts are then compared across the parts, as far as what follows the shared token in both is enough (see _possible()): as the rarest
    shingles come first, variants with more of their own than linked sets may lack drop out.
    """
    # most shingles that a row shares aren't in others' prefixes: their counting shuffles nothing but them
    shared = stored(tokens.select("token").groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "near-shared")
    met = perhaps(tokens, ["token"], shared).join(shared, "token", "left_semi").select("token", "row", "i", "n")
    tokens = stored(met.withColumn("part", F.col("row")), "near-tokens")
    dropped(shared)
    out = None
    for turn in range(TURNS):
        mine = F.struct("row", "i", "n", "part")
        heads = stored(tokens.groupBy("token").agg(F.min_by(mine, F.struct("i", F.xxhash64(F.lit(turn), "token", "row"), "row")).alias("head")), "near-heads")
        met = tokens.select("token", mine.alias("own")).join(heads, "token").where((F.col("own.part") != F.col("head.part")) & _possible("own", "head"))
        pairs = met.select(F.least("own.row", "head.row").alias("a"), F.greatest("own.row", "head.row").alias("b"))
        found = similar(docs, own, pairs if turn else pairs.unionByName(near))
        out = found if out is None else out.unionByName(found)
        before, tokens = tokens, _placed(tokens, out)
        for t in (heads, before):
            dropped(t)
    more = similar(docs, own, across(tokens))
    dropped(tokens)
    return out.unionByName(more)


def redundant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha256) of the documents that groups of near copies can do without, and of those that stay but are there several times.

    A group is what links of similarity 0.8 at least, over 5-word shingles, connect. Of it the document with the least doc_id
    stays (a null one only if there is no other; of equal ids, the one with the least hash of its text).

    Equal sets of shingles are one class. Classes whose texts' SimHash fingerprints (3-word shingles) differ in 3 bits or fewer meet as in simhash_dedup(), and are
    compared by all their shingles. Most linked texts' fingerprints differ in more bits; so blocks of documents also ask in how many rows each of their shingles is; classes meet by the rarest shingles,
    their prefixes (see prefix()), which no linked pair escapes; those that can be similar by where the shared shingle stands are compared by
    all their shingles, as 64-bit hashes. No pair is left out by a sketch or a chance. Null and empty texts, and those of white space, are one class. Very
    long texts are read whole, by one task. An empty table has no near copies.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), sha(text_col).alias("sha"))
    n = blocks(docs, BLOCK_BYTES)
    dealt = in_blocks(docs, n)
    said = stored(exchanged(dealt, _ask(2 * n), replier(_coded), n, 2 * n), "near-counts")
    own = stored(answered(dealt, said, n, _rows(2 * n), ROWS).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    dropped(said)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "row")
    classes = stored(own.groupBy("sig").agg(F.min(rank).alias("best"), F.count("*").alias("size")), "near-classes")
    copies = stored(own.select("row", "doc_id", "sha", "sig").join(classes.where("size > 1").select("sig", "best"), "sig").where("row <> best.row"), "near-copies")
    heads = lacking(own.select("row", "n", "fp", "at", "prefix"), ["row"], copies)
    tokens = heads.select("row", "n", F.explode(F.arrays_zip("at", "prefix")).alias("x")).select("row", "n", F.col("x.at").alias("i"), F.col("x.prefix").alias("token"))
    linked = links(docs, own, tokens, by_fingerprints(heads))
    found = stored(components(linked), "near-groups")
    ranked = stored(found.join(classes.select("best.row", "best"), F.col("node") == F.col("row")).select("root", "best"), "near-ranked")
    stays = stored(ranked.groupBy("root").agg(F.min("best").alias("stays")), "near-stays")
    others = ranked.join(stays, "root").where("best.row <> stays.row").select("best.doc_id", "best.sha")
    again = F.expr("doc_id <=> best.doc_id and sha = best.sha")
    key = lambda df: df.select("doc_id", F.col("sha").alias("text_sha256")).distinct()
    out = stored(key(copies.where(~again).select("doc_id", "sha").unionByName(others)), "near-redundant"), stored(key(copies.where(again)), "near-repeated")
    for t in (own, classes, copies, found, ranked, stays):
        dropped(t)
    return out
