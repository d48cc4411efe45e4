"""The group bootstrap with replicates as vectors: scores are sorted once, and weights of all replicates are summed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.functions.hashing import unit
from vetra.operators.metrics import BY_ERROR_RATE, HEADS
from vetra.operators.ordinals import ranged
from vetra.operators.sampling import POISSON
from vetra.storage import stored

PARTS = "head string, range long, p array<double>, n array<double>"
FOUND = "head string, range long, area array<double>, gap array<double>, score array<double>, rate array<double>, pos array<double>, neg array<double>"
#: Rows whose weights are held as a matrix at once.
ROWS = 4_096


def poisson_vectors(keys: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(key, weights): each key's Poisson(1) counts in all replicates, by a hash: the weights of sampling.poisson_weights() as one array."""
    u = lambda r: unit(F.concat_ws("|", F.lit(str(seed)), r.cast("string"), F.col(key).cast("string")))
    count = lambda v: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda e: e <= v)).cast("byte")
    return keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("weights", F.transform(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), u), count))


def _matrices(table: pa.Table, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, p, n) of runs of rows: distinct scores, and for each the positive and negative weights of all replicates."""
    for at in range(0, table.num_rows, ROWS):
        part = table.slice(at, ROWS)
        w = np.asarray(part.column("weights").combine_chunks().flatten(), np.float64).reshape(-1, replicates)
        w *= np.asarray(part.column("count"), np.float64)[:, None]
        y = np.asarray(part.column("label"), np.float64)[:, None]
        yield np.asarray(part.column("score"), np.float64), w * y, w * (1 - y)


def _sums(replicates: int):
    def sums(table: pa.Table) -> pa.Table:
        p, n = np.zeros(replicates), np.zeros(replicates)
        for _, a, b in _matrices(table, replicates):
            p, n = p + a.sum(0), n + b.sum(0)
        return pa.table([table.column("head").slice(0, 1), table.column("range").slice(0, 1), pa.array([p]), pa.array([n])], names=["head", "range", "p", "n"])

    return sums


def _scan(replicates: int):
    """A range, from its greatest score on, with what the ranges before it sum to: its part of the area, and the threshold at which the two error rates are nearest."""

    def scan(table: pa.Table, before: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(FOUND.split(", "), (pa.string(), pa.int64(), *[pa.list_(pa.float64())] * 6), strict=True)})
        tp, fp, pos, neg = (np.array(before.column(c)[0].as_py(), np.float64) for c in ("ap", "an", "pos", "neg"))
        area, gap, score, rate = np.zeros(replicates), np.full(replicates, np.inf), np.zeros(replicates), np.zeros(replicates)
        order = np.argsort(-np.asarray(table.column("score"), np.float64), kind="stable")
        with np.errstate(divide="ignore", invalid="ignore"):
            held = None  # rows of the last score may go on in the next run
            for s, p, n in [*_matrices(table.take(pa.array(order)), replicates), (np.array([-1.0]), np.zeros((1, replicates)), np.zeros((1, replicates)))]:
                if held is not None:
                    s, p, n = np.append(held[0], s), np.vstack([held[1], p]), np.vstack([held[2], n])
                first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                s, p, n = s[first], np.add.reduceat(p, first), np.add.reduceat(n, first)
                held = s[-1:], p[-1:], n[-1:]
                s, p, n = s[:-1], p[:-1], n[:-1]
                if not len(s):
                    continue
                tps, fps = tp + np.cumsum(p, 0), fp + np.cumsum(n, 0)
                area += (p * (neg - fps + n / 2)).sum(0)
                fpr, fnr = fps / neg, 1 - tps / pos
                gaps = np.where(p + n > 0, np.abs(fpr - fnr), np.inf)  # a score that a replicate doesn't draw isn't there
                at = np.argmin(gaps, 0)
                best = gaps[at, np.arange(replicates)]
                better = best < gap
                gap, score = np.where(better, best, gap), np.where(better, s[at], score)
                rate = np.where(better, ((fpr + fnr) / 2)[at, np.arange(replicates)], rate)
                tp, fp = tps[-1], fps[-1]
        cols = [table.column("head").slice(0, 1), table.column("range").slice(0, 1), *(pa.array([x]) for x in (area, gap, score, rate, pos, neg))]
        return pa.table(cols, names=[f.split()[0] for f in FOUND.split(", ")])

    return scan


def bootstrap(long: DataFrame, group: str, vectors: DataFrame, replicates: int) -> DataFrame:
    """Composite and components of each replicate in which all heads have both classes, as sampling.group_bootstrap(). long: head, label, score and the group; vectors: poisson_vectors().

    Equal rows of a group are one with a count. They are dealt by ranges of falling scores, once for all replicates: a range sums its weights as vectors of
    replicates, gets what the ranges before it sum to, and in one pass finds its part of each replicate's area under the curve and its nearest error rates. So there
    is a row for a range and head, not for a replicate's score. Rows without a known label or a group are left out; other labels or scores fail.
    """
    y, s = F.col("label").cast("double"), F.col("score").cast("double")
    fine = F.when(y.isin(0.0, 1.0) & s.between(0, 1) & ~F.isnan(s), s).otherwise(F.raise_error(F.lit("labels must be 0 or 1, and scores in [0, 1]")).cast("double"))
    packed = long.where(F.col("label").isNotNull()).groupBy(group, "head", y.alias("label"), (fine + F.lit(0.0)).alias("score")).agg(F.count("*").alias("count"))
    rows, _ = ranged(packed.join(vectors, group).select("head", "score", "label", "count", "weights"), [F.desc("score")], ["head"])
    placed = stored(rows.select("_row.*", F.col("_range").alias("range")), "replicate-rows")
    parts = stored(placed.groupBy("head", "range").applyInArrow(_sums(replicates), PARTS), "replicate-sums")

    def before(table: pa.Table) -> pa.Table:  # a head's ranges
        table = table.sort_by("range")
        p, n = (np.array(table.column(c).to_pylist(), np.float64) for c in ("p", "n"))
        cols = [np.cumsum(p, 0) - p, np.cumsum(n, 0) - n, np.tile(p.sum(0), (len(p), 1)), np.tile(n.sum(0), (len(n), 1))]
        return pa.table([table.column("head"), table.column("range"), *(pa.array(list(c)) for c in cols)], names=["head", "range", "ap", "an", "pos", "neg"])

    starts = parts.groupBy("head").applyInArrow(before, "head string, range long, ap array<double>, an array<double>, pos array<double>, neg array<double>")
    found = placed.groupBy("head", "range").cogroup(starts.groupBy("head", "range")).applyInArrow(_scan(replicates), FOUND)
    each = found.select("head", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(replicates - 1)).alias("replicate"), "area", "gap", "score", "rate", "pos", "neg")).alias("x")).select("head", "x.*")
    by_head = each.groupBy("replicate", "head").agg(F.sum("area").alias("area"), F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.min_by("rate", F.struct("gap", -F.col("score"))).alias("eer"))
    fits = (F.col("pos") > 0) & (F.col("neg") > 0)
    component = F.when(fits, F.when(F.col("head").isin(*BY_ERROR_RATE), 1 - F.col("eer")).otherwise(F.col("area") / (F.col("pos") * F.col("neg"))))
    wide = by_head.groupBy("replicate").agg(*[F.max(F.when(F.col("head") == h, component)).alias(h) for h in HEADS])
    a, b, c, d, e = map(F.col, HEADS)
    out = wide.withColumns({"ads": 0.5 * a + 0.2 * b + 0.3 * c, "cps": 0.5 * d + 0.5 * e}).withColumn("score", 0.9 * F.col("ads") + 0.1 * F.col("cps"))
    return out.where("score is not null").select("replicate", *HEADS, "ads", "cps", "score")
