"""Groups across splits, connected components, and held-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.storage import dropped, stored


def crossings(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split: the group, and its splits sorted and joined by |. Only the two columns are read."""
    out = df.select(group, split).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("_s")).where("size(_s) > 1")
    return out.select(group, F.array_join("_s", "|").alias("splits"))


def strict_crossings(df: DataFrame, group: str, split: str, held: str) -> DataFrame:
    """crossings() of a projection that must be exactly the two columns, all of the held split, with a group each; anything else fails."""
    if sorted(df.columns) != sorted([group, split]):
        raise ValueError(f"columns {df.columns}, not {[group, split]} alone")
    fine = F.coalesce((F.col(split) == held) & (F.col(group) != ""), F.lit(False))
    return df.select(F.when(fine, F.col(group)).otherwise(F.raise_error(F.lit(f"a row that isn't of {held}, or has no group")).cast(dict(df.dtypes)[group])).alias(group), split)


def leakage_matrix(df: DataFrame, group: str, split: str, names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """One row: groups, groups in each two splits and in all three, rows of the groups that cross, rows with null group or split."""
    a, b, c = names
    own = df.select(F.col(group).alias("g"), F.col(split).alias("s"))
    by = own.groupBy("g").agg(F.count_if(F.col("s").isNull() | F.col("g").isNull()).alias("missing"), F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("n"), F.count_distinct(F.when(F.col("g").isNotNull(), F.col("s"))).alias("k"), *[F.coalesce(F.bool_or(F.col("g").isNotNull() & (F.col("s") == x)), F.lit(False)).alias(x) for x in names])
    both = lambda *x: F.count_if(sum((F.col(v).cast("int") for v in x), F.lit(0)) == len(x))
    return by.agg(
        F.count_if(F.col("n") > 0).alias("group_count"), both(a, b).alias(f"{a}_{b}"), both(a, c).alias(f"{a}_{c}"), both(b, c).alias(f"{b}_{c}"), both(a, b, c).alias("all_three"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("affected_rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_rows"),
    )


def _least_neighbours(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): of all nodes within two edges, the one that comes first in an order drawn anew each turn."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("place"), F.col(c).alias("node"))
    near = stored(both.groupBy("node").agg(F.min(place("other")).alias("least")).select("node", F.least("least", place("node")).alias("least")), "near")
    beyond = both.join(near.select(F.col("node").alias("other"), "least"), "other").groupBy("node").agg(F.min("least").alias("least"))
    return beyond.select("node", F.col("least")["node"].alias("to"))


def _followed(step: DataFrame) -> DataFrame:
    """Each node mapped to what its image maps to."""
    after = step.select(F.col("node").alias("via"), F.col("to").alias("end"))
    return step.join(after, F.col("to") == F.col("via")).select("node", F.col("end").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it reaches.

    Each turn maps every node to the first one near it in a random order, follows that map once, and puts the edges between the
    images in place of the edges, until none joins two nodes. A turn leaves less than half the nodes, on average, so turns
    grow with the logarithm of the nodes, also along a path; a star takes one turn. All is partial aggregation and
    equi-joins; tables of a turn are written to the shared folder. Null ends are left out; a node whose edges all join
    it to itself has no row.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        maps.append(stored(_followed(_least_neighbours(edges, len(maps))), "images"))
        image = lambda c, to, own=maps[-1]: own.select(F.col("node").alias(c), F.col("to").alias(to))
        moved = edges.join(image("a", "x"), "a").join(image("b", "y"), "b").where("x <> y")
        after = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(edges)
        edges = after
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    ends = maps[-1]
    for step in reversed(maps[:-1]):  # the smallest first: each map has less than half the nodes of the one before
        last = ends.select(F.col("node").alias("via"), F.col("to").alias("end"))
        ends = stored(step.join(last, F.col("to") == F.col("via"), "left").select("node", F.coalesce("end", "to").alias("to")), "ends")
    least = stored(ends.groupBy("to").agg(F.min("node").alias("root")), "least")
    return ends.join(least, "to").select("node", "root")


def bipartite_components(df: DataFrame, record: str, left: str, right: str) -> DataFrame:
    """(record, component): records that share a left or a right value, directly or by others, are one component, named by its least record.

    Every record is tied to the least record of its left value and to that of its right value, so a value of many records is a star,
    not all its pairs.
    """
    own = df.select(F.col(record).alias("r"), F.col(left).alias("l"), F.col(right).alias("k"))
    star = lambda c: own.where(F.col(c).isNotNull()).join(own.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("r").alias("least")), c).select(F.col("r").alias("a"), F.col("least").alias("b"))
    roots = components(star("l").unionByName(star("k")))
    out = own.join(roots, F.col("r") == F.col("node"), "left")
    return out.select(F.col("r").alias(record), F.coalesce("root", "r").alias("component"))


def component_summary(df: DataFrame, component: str, record: str, left: str, right: str, split: str) -> DataFrame:
    """Of each component: records, distinct values of both sides, its splits joined by ;, whether it crosses them, and its least and greatest record."""
    out = df.groupBy(component).agg(F.count("*").alias("record_count"), F.count_distinct(left).alias("left_count"), F.count_distinct(right).alias("right_count"), F.array_sort(F.collect_set(split)).alias("_s"), F.min(record).alias("least_record"), F.max(record).alias("greatest_record"))
    return out.withColumns({"splits": F.array_join("_s", ";"), "split_count": F.size("_s"), "crosses": F.size("_s") > 1}).drop("_s")


def leave_one_out(df: DataFrame, holdout: str, values: list[str] | None = None) -> DataFrame:
    """Rows once for each fold: a fold holds out one value; `role` is held_out or train. Give the values where they are known; else they are read first."""
    if values is None:
        values = [r[0] for r in df.select(holdout).where(F.col(holdout).isNotNull()).distinct().orderBy(holdout).collect()]
    return df.withColumn("fold", F.explode(F.array(*map(F.lit, values)))).withColumn("role", F.when(F.col(holdout) == F.col("fold"), "held_out").otherwise("train"))
