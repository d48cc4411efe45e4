"""Lookups, pairings and comparisons of tables. All are equi-joins; Catalyst picks broadcast or shuffle by size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.operators.ordinals import numbered
from vetra.operators.pages import PAGE, paged


def _same(keys: list[str], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. As an aggregate, which combines before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def first_wins(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left lookup; of several rows with the key, the first in the order counts."""
    return left.join(one_per_key(right, keys, order), keys, "left")


def last_wins(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return left.join(last_per_key(right, keys, order), keys, "left")


def multiplicity(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """left with match_count, match_ids (sorted) and status: UNIQUE, AMBIGUOUS or EXTRA (no match)."""
    found = right.groupBy(key).agg(F.count("*").alias("match_count"), F.array_sort(F.collect_list(right_id)).alias("match_ids"))
    n = F.coalesce("match_count", F.lit(0))
    return left.join(found, key, "left").withColumns({"match_count": n, "status": F.when(n == 1, "UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("EXTRA")})


def two_tiers(left: DataFrame, right: DataFrame, exact: tuple[str, str], normal: tuple[str, str], right_id: str) -> DataFrame:
    """Looks up by an exact key, and where that finds nothing by a normalised one.

    exact, normal: the keys' columns in left and right. Adds tier (EXACT, NORMALIZED, NONE), match_count, match_id (of a single match)
    and status (UNIQUE, AMBIGUOUS, UNMATCHED). An empty normalised key matches nothing.
    """
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)  # noqa: E731 long texts meet by their digests
    tier = lambda k, n: right.where(F.col(k[1]).isNotNull() & (F.col(k[1]) != "")).groupBy(digest(k[1]).alias(f"_{n}")).agg(F.count("*").alias(f"_{n}_n"), F.min(right_id).alias(f"_{n}_id"))
    out = left.join(tier(exact, "e"), digest(exact[0]) == F.col("_e"), "left").join(tier(normal, "m"), digest(normal[0]) == F.col("_m"), "left")
    n = F.coalesce("_e_n", "_m_n", F.lit(0))
    out = out.withColumns({
        "tier": F.when(F.col("_e_n").isNotNull(), "EXACT").when(F.col("_m_n").isNotNull(), "NORMALIZED").otherwise("NONE"),
        "match_count": n,
        "match_id": F.when(n == 1, F.coalesce("_e_id", "_m_id")),
        "status": F.when(n == 1, "UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("UNMATCHED"),
    })
    return out.drop("_e", "_e_n", "_e_id", "_m", "_m_n", "_m_id")


def inverted_pages(df: DataFrame, key: str, value: str, size: int = PAGE) -> DataFrame:
    """inverted_index() in pages of so many values, for keys of any number."""
    return paged(df, key, value, size, distinct=True)


def match_pages(left: DataFrame, right: DataFrame, key: str, right_id: str, size: int = PAGE) -> DataFrame:
    """multiplicity() with the ids in pages: match_count and status of each row of left, a row for each page of ids; without a match, one with no page."""
    found = paged(right, key, right_id, size).select(F.col(key).alias("_key"), "page", F.col("member_count").alias("match_count"), F.col("members").alias("match_ids"))
    out = left.join(found, F.col(key) == F.col("_key"), "left").drop("_key")
    n = F.coalesce("match_count", F.lit(0))
    return out.withColumns({"match_count": n, "status": F.when(n == 1, "UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("EXTRA")})


def inverted_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key, the sorted distinct values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("members"))


def checksums(expected: DataFrame, actual: DataFrame, name: str, digest: str) -> DataFrame:
    """Each actual file against the expected list: OK, MISMATCH or NOT_LISTED; digests compare without letter case."""
    own = expected.select(F.col(name), F.lower(digest).alias("expected_digest"))
    out = actual.join(own, name, "left")
    return out.withColumn("status", F.when(F.col("expected_digest").isNull(), "NOT_LISTED").when(F.lower(digest) == F.col("expected_digest"), "OK").otherwise("MISMATCH"))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in a alone, in b alone, in both; and whether the sets are equal, and a is a subset of b."""
    sides = a.select(key).distinct().withColumn("a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("a", F.lit(2)))
    seen = sides.groupBy(key).agg(F.sum("a").alias("in"))
    out = seen.agg(*[F.count_if(F.col("in") == k).alias(n) for k, n in ((1, "only_a"), (2, "only_b"), (3, "both"))])
    return out.withColumns({"sets_equal": F.expr("only_a = 0 and only_b = 0"), "a_in_b": F.expr("only_a = 0")})


def pairing(real: DataFrame, generated: DataFrame, key: str, directory: str, member: str, order: Column, directories: list[str]) -> DataFrame:
    """Each real key with its member of each directory, the last in the order, n_paired, and complete."""
    wide = generated.groupBy(key).pivot(directory, directories).agg(F.max_by(member, order))
    out = real.select(key).join(wide, key, "left")
    n = sum((F.col(f"`{d}`").isNotNull().cast("int") for d in directories), F.lit(0))
    return out.withColumn("n_paired", n).withColumn("complete", n == len(directories))


def copies_equal(originals: DataFrame, copies: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: originals, copies, pairs, and whether each copy has an original with equal values."""
    pairs = originals.alias("a").join(copies.alias("b"), _same(keys))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    counts = originals.agg(F.count("*").alias("originals")).crossJoin(copies.agg(F.count("*").alias("copies"))).crossJoin(pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.bool_and(same), F.lit(True)).alias("all_equal")))  # one row each
    return counts.withColumn("passed", F.expr("copies = pairs and all_equal"))


def positional(a: DataFrame, b: DataFrame, ordinal: str, values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of two tables with equal ordinal that differ, or that one of them lacks: ordinal and issues."""
    numeric = {c for c, t in a.dtypes if t in ("double", "float")}
    out = a.alias("a").join(b.alias("b"), F.col(f"a.{ordinal}") == F.col(f"b.{ordinal}"), "full")
    differ = lambda v: F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) > tolerance if v in numeric else ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    issue = [F.when(F.col(f"a.{ordinal}").isNull(), "missing_a"), F.when(F.col(f"b.{ordinal}").isNull(), "missing_b")]
    both = F.col(f"a.{ordinal}").isNotNull() & F.col(f"b.{ordinal}").isNotNull()
    issue += [F.when(both & F.coalesce(differ(v), ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))), v) for v in values]
    return out.select(F.coalesce(f"a.{ordinal}", f"b.{ordinal}").alias(ordinal), F.array_compact(F.array(*issue)).alias("issues")).where("size(issues) > 0")


def keyed_comparison(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Every key and value of two metric tables with both numbers, and whether they agree (two nulls do)."""
    long = lambda df, n: df.unpivot(keys, values, "metric", n)
    out = long(a, "left_value").join(long(b, "right_value"), [*keys, "metric"], "full")
    x, y = F.col("left_value"), F.col("right_value")
    return out.withColumn("agrees", F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull()))


def by_ordinal(locators: DataFrame, rows: DataFrame, file: str, ordinal: str, base: int, asserted: tuple[str, str]) -> DataFrame:
    """Locators joined to rows by file and ordinal, where locators count from `base` and rows from 0; status OK, ID_MISMATCH or NO_ROW by the asserted id."""
    own = locators.withColumn("_row", F.col(ordinal) - base).alias("a")
    out = own.join(rows.select(F.col(file).alias("_file"), F.col(ordinal).alias("_at"), F.col(asserted[1]).alias("resolved_id")), (F.col(f"a.{file}") == F.col("_file")) & (F.col("_row") == F.col("_at")), "left")
    status = F.when(F.col("_at").isNull(), "NO_ROW").when(F.col("resolved_id").eqNullSafe(F.col(f"a.{asserted[0]}")), "OK").otherwise("ID_MISMATCH")
    return out.withColumn("status", status).withColumnRenamed("_row", "zero_based_row").drop("_file", "_at")


def probe(df: DataFrame, group: str, order: Column) -> DataFrame:
    """The first row of each group."""
    return one_per_key(df, [group], [order])


def ordinals(df: DataFrame, group: list[str], order: list[Column], name: str = "ordinal", base: int = 1) -> DataFrame:
    """Rows numbered within their group, a large group by several tasks."""
    return numbered(df, order, group, name, base)


def pairing_summary(generated: DataFrame, real: DataFrame, directory: str, key: str, expected: dict[str, int]) -> DataFrame:
    """Of each directory: members, distinct keys, repeated ones, keys without a real one, the number expected, and whether that many are there."""
    known = real.select(F.col(key).alias("_known")).distinct()
    by = generated.groupBy(directory, key).agg(F.count("*").alias("n")).join(known, F.col(key) == F.col("_known"), "left")
    need = F.try_element_at(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col(directory))
    out = by.groupBy(directory).agg(F.sum("n").alias("member_count"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("_known").isNull()).alias("unpaired_keys"))
    return out.withColumn("expected_count", need.cast("long")).withColumn("complete", F.coalesce(F.col("distinct_keys") == F.col("expected_count"), F.lit(False)))


def selection_audit(candidates: DataFrame, group: str, candidate: str, order: list[Column], digest: str, chosen: DataFrame) -> DataFrame:
    """Of each group: the candidate that the order puts first, the recorded choice, whether they agree, and whether all candidates have one digest."""
    best = candidates.groupBy(group).agg(F.min_by(candidate, F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("derived"), F.count_distinct(digest).alias("digest_count"))
    own = chosen.select(F.col(group).alias("_g"), F.col(candidate).alias("recorded"))
    return best.join(own, F.col(group) == F.col("_g"), "left").drop("_g").withColumns({"agrees": F.col("derived").eqNullSafe(F.col("recorded")), "one_digest": F.col("digest_count") == 1})


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join in which each key must be once on both sides; a key that is missing or repeated fails, and says which."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    counts = side(left, "_l").join(side(right, "_r").withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "full")
    fine = F.coalesce((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("not one to one: "), F.coalesce(F.coalesce(key, "_key").cast("string"), F.lit("null"))))
    checked = counts.select(F.when(fine, F.col(key)).otherwise(broken.cast(dict(left.dtypes)[key])).alias(key))
    return checked.join(left, key).join(right, key)


def three_way(a: DataFrame, b: DataFrame, c: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that all three tables have, each value of them, and for each whether all three agree: value_equal, and all_equal over all values."""
    side = lambda df, n: df.select(F.col(key).alias(f"_{n}"), *[F.col(v).alias(f"{v}_{n}") for v in values])
    out = side(a, "a").join(side(b, "b"), F.col("_a") == F.col("_b")).join(side(c, "c"), F.col("_a") == F.col("_c"))
    same = {f"{v}_equal": F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")) & F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_c")) for v in values}
    return out.withColumns(same).withColumn("all_equal", reduce(lambda x, y: x & y, [F.col(n) for n in same])).withColumnRenamed("_a", key).drop("_b", "_c")


def resolution_summary(resolved: DataFrame, file: str, ordinal: str) -> DataFrame:
    """One row over resolved locators: checked rows, distinct files, least and greatest ordinal, and how many are zero."""
    return resolved.agg(F.count("*").alias("checked_rows"), F.count_distinct(file).alias("distinct_files"), F.min(ordinal).alias("least_ordinal"), F.max(ordinal).alias("greatest_ordinal"), F.count_if(F.col(ordinal) == 0).alias("zero_ordinals"))
