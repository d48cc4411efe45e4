"""SimHash near-duplicates with the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.operators.lineage import components

from .common import read, stored, texts

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: A bucket of more fingerprints is dealt anew by further bits.
BUCKET = 512
#: With so few free bits a bucket holds at most BUCKET fingerprints.
FREE_BITS = BUCKET.bit_length() - 1
#: What a probe costs, in candidates that are verified.
PROBE_COST = 20.0
ALL_BITS = (1 << 64) - 1


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash over the text's shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return majority(np.fromiter((digest(g, seed) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    return int(np.packbits(_bit_counts(h) * 2 > len(h), bitorder="little").view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit, least bit first. Bytes of a word count eight bits at once, 255 values at most."""
    lanes = np.uint64(0x0101010101010101)
    out = np.zeros(64, np.int64)
    starts = np.arange(0, len(h), 255)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, starts)
        out[bit::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("data")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode("text", "utf-8").alias("data")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, over a task's fingerprints."""
    total = np.zeros((64, 64), np.int64)
    n = 0
    for batch in batches:
        bits = np.unpackbits(np.asarray(batch.column("fp")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
        n += batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often each two bits are set together: 4097 numbers, whatever the input."""
    cells = {r["cell"]: r["n"] for r in prints.select("fp").mapInArrow(_together, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return cells.get(4096, 0), np.array([cells.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def partitions(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of like size: each group takes, bit by bit, the free bit that is most correlated with its bits, on average."""
    p = together.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for k in range(parts):
        group: list[int] = []
        for _ in range(len(free) // (parts - k)):
            b = max(sorted(free), key=lambda b, own=group: related[b, own].mean() if own else p[b] * (1 - p[b]) + related[b].sum() / 1e3)
            group.append(b)
            free.discard(b)
        out.append(group)
    return out


def _close(n: int, together: np.ndarray, group: list[int]) -> list[float]:
    """The estimated share of pairs that differ in at most 0, 1, 2, ... bits of the group. Each bit is taken to depend on the bit before it."""
    p = together / n
    agree = lambda b: p[b, b] ** 2 + (1 - p[b, b]) ** 2
    odds = []
    for k, b in enumerate(group):
        if not k:
            odds.append(agree(b))
            continue
        a = group[k - 1]
        cells = (p[a, b], p[a, a] - p[a, b], p[b, b] - p[a, b], 1 - p[a, a] - p[b, b] + p[a, b])
        odds.append(min(1.0, sum(max(x, 0) ** 2 for x in cells) / max(agree(a), 1e-12)))
    chance = [1.0]
    for q in odds:
        chance = [(chance[i] if i < len(chance) else 0) * q + (chance[i - 1] * (1 - q) if i else 0) for i in range(len(chance) + 1)]
    return list(np.cumsum(chance))


def allocate(n: int, together: np.ndarray, distance: int) -> list[int]:
    """Masks of the bits by which fingerprints are dealt: any two within `distance` agree on all bits of one.

    With m parts and thresholds that sum to distance - m + 1 (-1: the part is left out), two such fingerprints
    differ in some part by its threshold at most. For each m, dynamic programming finds the thresholds
    with the least cost, of probes and estimated candidates; the least of all m is taken. A part with threshold t is
    probed by all ways to leave out t of its bits.
    """
    best: tuple[float, list[int]] = (math.inf, [])
    for m in range(1, distance + 2):
        groups = partitions(n, together, m)
        cost = []
        for g in groups:
            close = _close(n, together, g)
            cost.append({-1: 0.0} | {t: n * math.comb(len(g), t) * PROBE_COST + n * n / 2 * close[t] for t in range(min(distance, len(g)) + 1)})
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # by the sum of thresholds so far
        for c in cost:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (spent, chosen) in table.items():
                for t, x in c.items():
                    if total + t not in after or spent + x < after[total + t][0]:
                        after[total + t] = (spent + x, (*chosen, t))
            table = after
        if distance - m + 1 in table and (found := table[distance - m + 1])[0] < best[0]:
            masks = [sum(1 << b for b in g if b not in out) for g, t in zip(groups, found[1], strict=True) if t >= 0 for out in combinations(g, t)]
            best = (found[0], masks)
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int, distance: int) -> list[int]:
    """Masks with more bits than mask: two fingerprints that agree on mask and differ in `distance` bits agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: distance + 1]) for k in range(distance + 1)]


def dealt(prints: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """(mask, value, fp): fingerprints in buckets of at most BUCKET; two within `distance` share one.

    A larger bucket goes, whole, into finer ones, by the pigeonhole principle over its free bits; each level
    fixes a quarter of these, until FREE_BITS are left or no bucket is too large.
    """
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for m in masks])).alias("k")).select("k.mask", "k.value", "fp")
    done = None
    while True:
        keyed = stored(keyed, "buckets")
        large = stored(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("mask", "value"), "large")
        own = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks, of which a level has 4 for each of the last one's
        rest = keyed.join(large, ["mask", "value"], "left_anti") if own else keyed
        done = rest if done is None else done.unionByName(rest)
        if not own:
            return done
        spread = [(m, _signed(f)) for m in own for f in finer(m & ALL_BITS, distance) if 64 - (m & ALL_BITS).bit_count() > FREE_BITS]
        finest = keyed.sparkSession.createDataFrame(spread, "mask long, fine long")
        keyed = keyed.join(large, ["mask", "value"], "left_semi").join(F.broadcast(finest), "mask").select(F.col("fine").alias("mask"), F.col("fp").bitwiseAND(F.col("fine")).alias("value"), "fp").distinct()


def _star(own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a bucket's connected parts, each to its least fingerprint; as many as there are fingerprints at most."""
    out, left = [], np.sort(own)
    while len(left):
        root, front, rest = left[0], left[:1], left[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front:
                near |= np.bitwise_count(rest ^ x) <= distance
            front, rest = rest[near], rest[~near]
            out += [(int(root), int(x)) for x in front]
        left = rest
    return out


def linked(buckets: DataFrame, distance: int) -> DataFrame:
    """(a, b): in each bucket, links enough to connect what links of at most `distance` connect."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last bucket may go on in the next batch
        for batch in batches:
            table = np.stack([np.asarray(batch.column(n)) for n in ("mask", "value", "fp")])
            table = table if kept is None else np.concatenate([kept, table], axis=1)
            ends = np.flatnonzero((table[0, 1:] != table[0, :-1]) | (table[1, 1:] != table[1, :-1])) + 1
            kept = table[:, ends[-1] :] if len(ends) else table
            if len(ends):
                yield found_in(table[:, : ends[-1]])
        if kept is not None:
            yield found_in(kept)

    def found_in(table: np.ndarray) -> pa.RecordBatch:
        fp = table[2].view(np.uint64)
        new = np.append(True, (table[0, 1:] != table[0, :-1]) | (table[1, 1:] != table[1, :-1]))
        starts = np.flatnonzero(new)
        bucket, sizes, found = np.cumsum(new) - 1, np.diff(np.append(starts, len(fp))), []
        hit = sizes > 32  # of small buckets, only those with a link, found by comparing all with their d-th next
        for d in range(1, int(min(32, sizes.max(initial=0)))):
            same = (bucket[d:] == bucket[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance)
            hit[bucket[d:][same]] = True
        for k in np.flatnonzero(hit):
            found += _star(fp[starts[k] : starts[k] + sizes[k]], distance)
        a, b = np.array(found, np.uint64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return buckets.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(verify, "a long, b long")


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame | None:
    """linked() over the distinct fingerprints of a table (fp, ...); None for fewer than two."""
    n, together = bit_statistics(classes)
    return linked(dealt(classes.select("fp"), allocate(n, together, distance), distance), distance) if n > 1 else None


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Documents whose SimHash fingerprints, over 3-word shingles, are connected by links of at most `distance` differing bits.

    Returns a row per input row: doc_id, fp (the fingerprint as a signed long), component_id (the least doc_id reachable).

    Equal fingerprints are one class; classes meet in buckets chosen by the generalised pigeonhole principle (see
    allocate()), large buckets are dealt anew (see dealt()), and links within them, at most one for each
    member, are contracted to components. No document pairs are made.

    Null and empty texts, and those of white space, have fingerprint 0 and link like others. Null ids are never
    a component's id unless it has no other. A very long text is read whole, by one task. Repeated rows each give a row. An empty table gives an empty result.
    Only the two columns are read, so others may have any names.
    """
    prints = stored(fingerprints(texts(docs, id_col, text_col)), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = links(classes, distance)
    if found is None:
        return prints.join(classes, "fp").select("doc_id", "fp", F.col("first_id").alias("component_id"))
    roots = stored(components(found), "components")
    members = roots.select(F.col("node").alias("fp"), "root").join(classes, "fp")
    least = members.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked_ids = members.join(least, "root").select("fp", "least_id")
    # stored, so that both sides of the last join are plain exchanges, of which Spark splits a hot fingerprint
    ids = stored(classes.join(linked_ids, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
