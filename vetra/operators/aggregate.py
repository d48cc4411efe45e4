"""Aggregations over inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.functions.numbers import ratio
from vetra.operators.quantiles import quantiles as exact_quantiles

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"))


def group_summary(df: DataFrame, keys: list[str], seconds: str, group: str) -> DataFrame:
    """Rows, hours and distinct content groups of each key, in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), (F.sum(seconds) / 3600).alias("duration_hours"), F.count_distinct(group).alias("unique_group_count"))


def weighted_fraction(part: Column, whole: Column) -> Column:
    """Sum by sum; null where the whole is 0."""
    return ratio(F.sum(part), F.sum(whole))


def quantile_profile(df: DataFrame, keys: list[str], columns: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """A row for each key and column: n, minimum, quantiles by linear interpolation, maximum, mean, population deviation. Nulls are left out."""
    out = exact_quantiles(df, keys, columns, quantiles)
    return out.select(*keys, "column", "n", "minimum", "maximum", "mean", "deviation", *[F.col(f"q{k}").alias(f"p{round(x * 100):02d}") for k, x in enumerate(quantiles)])


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column, 0 where there are none; null rows are a row."""
    return df.groupBy(row).pivot(column, values).count().fillna(0, values)


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """For each column: rows, missing values (null or blank), their share, distinct values. One pass over the table, with partial aggregation."""
    columns = columns or df.columns
    text = {c for c, t in df.dtypes if t == "string"}
    value = lambda c: F.when(F.trim(c) != "", F.col(c)) if c in text else F.col(c)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    by_value = stacked.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = by_value.groupBy("column").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"), F.count("value").alias("distinct_count"))
    return out.withColumn("missing_fraction", ratio(F.col("missing_count"), F.col("row_count")))


def two_levels(df: DataFrame, upper: list[str], lower: list[str]) -> DataFrame:
    """Counts by the upper keys, and by upper and lower keys, in one table; record_type says which."""
    out = df.groupingSets([upper, upper + lower], *upper, *lower).agg(F.count("*").alias("row_count"), F.grouping_id().alias("_level"))
    return out.withColumn("record_type", F.when(F.col("_level") == 0, "detail").otherwise("summary")).drop("_level")


def merge_counters(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Sums of JSON counters by key and name."""
    long = df.select(*keys, F.explode(F.from_json(json, "map<string,long>")).alias("name", "n"))
    return long.groupBy(*keys, "name").agg(F.sum("n").alias("total"))


def counters_json(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of each key, how often it has each name, as a JSON object with sorted names."""
    n = df.where(F.col(name).isNotNull()).groupBy(*keys, F.col(name).cast("string").alias("_name")).agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("_name", "_n")))
    return n.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("counters"))


def contiguous(df: DataFrame, column: str) -> DataFrame:
    """One row: least, greatest and distinct values; whether they are 0, 1, 2, ... without a gap."""
    out = df.agg(F.min(column).alias("least"), F.max(column).alias("greatest"), F.count_distinct(column).alias("distinct_count"))
    return out.withColumn("contiguous", F.expr("coalesce(least = 0 and distinct_count = greatest + 1, false)"))


def segment_means(df: DataFrame, file: str, heads: list[str]) -> DataFrame:
    """A file's probabilities: the mean over its segments; a value that is null, no number or outside [0, 1] fails."""
    checked = lambda h: F.when(F.col(h).between(0, 1) & ~F.isnan(h), F.col(h)).otherwise(F.raise_error(F.lit(f"{h} must be in [0, 1]")).cast("double"))
    return df.groupBy(file).agg(F.count("*").alias("segment_count"), *[F.avg(checked(h)).alias(h) for h in heads])


def pure_groups(df: DataFrame, json: str, rows: str, least: int) -> DataFrame:
    """Rows whose JSON map has one key, and that count `least` rows at least; the key is `only`."""
    keys = F.map_keys(F.from_json(json, "map<string,long>"))
    return df.withColumn("only", F.when(F.size(keys) == 1, keys[0])).where(F.col("only").isNotNull() & (F.col(rows) >= least))


def table_profile(df: DataFrame, id_column: str, numeric: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: rows, repeated rows, repeated ids, blank cells, cells that are no number or out of range, constant columns.

    Rows are counted by a hash of 128 bits of all columns, ids apart from them, so that no row is repeated for a distinct count; constant columns show by the least and
    greatest hash of their values.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    number = lambda c: F.col(c).try_cast("double")
    total = lambda f, cols: sum((F.count_if(f(c)) for c in cols), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    value = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string")))
    constant = F.array_compact(F.array(*[F.when(F.min(value(c)).eqNullSafe(F.max(value(c))) & F.count(c).isin(0, F.count("*")), c) for c in df.columns]))
    rows = df.agg(
        F.count("*").alias("row_count"),
        F.count(id_column).alias("_ids"),
        total(blank, df.columns).alias("blank_cells"),
        total(lambda c: ~blank(c) & number(c).isNull(), numeric).alias("non_numeric_cells"),
        total(lambda c: number(c).isNotNull() & ~number(c).between(low, high), numeric).alias("out_of_range_cells"),
        F.array_join(constant, ";").alias("constant_columns"),
    )
    distinct = lambda own, name: own.distinct().agg(F.count("*").alias(name))
    kinds = distinct(df.select(F.xxhash64(F.lit(1), *texts).alias("a"), F.xxhash64(F.lit(2), *texts).alias("b")), "_kinds")
    ids = distinct(df.where(F.col(id_column).isNotNull()).select(id_column), "_distinct_ids")
    one = lambda own: own.withColumn("_one", F.lit(1))  # noqa: E731 one row each
    out = one(rows).join(one(kinds), "_one").join(one(ids), "_one")
    return out.select("row_count", (F.col("row_count") - F.col("_kinds")).alias("repeated_rows"), (F.col("_ids") - F.col("_distinct_ids")).alias("repeated_ids"), "blank_cells", "non_numeric_cells", "out_of_range_cells", "constant_columns")


def member_summary(df: DataFrame, group: str, member: str, kind: str, expected: dict[str, int], order: str, default: int = 1) -> DataFrame:
    """Of each group: members, distinct members, its first kind, and whether it has as many distinct members as its kind needs."""
    out = df.groupBy(group).agg(F.count("*").alias("member_count"), F.count_distinct(member).alias("distinct_members"), F.min_by(kind, order).alias("kind"), F.array_join(F.array_sort(F.collect_set(member)), ";").alias("members"))
    need = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col("kind")), F.lit(default))
    return out.withColumn("complete", F.col("distinct_members") >= need)


def first_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows by a full order, numbered from 1: examples for a report."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(k).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))  # k rows


def directory_summary(df: DataFrame, keys: list[str], size: str, duration: str, category: str, flags: dict[str, Column]) -> DataFrame:
    """Of each key: rows, bytes, duration (sum, least, median, greatest), counts of the flags, and of the category as JSON."""
    counted = df.groupBy(*keys, category).agg(F.count("*").alias("_n"))
    as_json = counted.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(category, F.lit("")), "_n"))))).alias("categories"))
    rows = df.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.sum(size).alias("total_bytes"), F.sum(duration).alias("total_duration"), F.min(duration).alias("least_duration"), F.max(duration).alias("greatest_duration"), *[F.count_if(c).alias(n) for n, c in flags.items()],
    )
    median = exact_quantiles(df, keys, [duration], (0.5,)).select(*keys, F.col("q0").alias("median_duration"))
    return rows.join(as_json, keys).join(median, keys, "left")
