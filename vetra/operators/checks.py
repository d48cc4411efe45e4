"""Expectations over tables, as tables: violations, and a ledger of named checks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "check string, status string, errors array<string>, evidence string"


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule string, key string, detail string")


def violations(df: DataFrame, key: list[str], required: list[str] = (), allowed: dict[str, tuple] | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """(rule, key, detail): blank required values, values outside their set, conditions that don't hold, repeated keys.

    One scan for all row rules, and one aggregate for the keys. A missing column is a violation itself.
    """
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    lacking = [c for c in [*required, *(allowed or {})] if c not in df.columns]
    rules = [(f"required:{c}", F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit("")) for c in required if c in df.columns]
    rules += [(f"allowed:{c}", ~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c, v in (allowed or {}).items() if c in df.columns]
    rules += [(f"condition:{n}", ~F.coalesce(c, F.lit(False)), F.lit("")) for n, c in (conditions or {}).items()]
    out = _nothing(df.sparkSession)
    if rules:
        found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("rule"), name.alias("key"), d.alias("detail"))) for n, bad, d in rules]))
        out = out.unionByName(df.select(F.explode(found).alias("v")).select("v.*"))
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), name.alias("key"), F.col("n").cast("string").alias("detail"))
    out = out.unionByName(repeated)
    if lacking:
        out = out.unionByName(df.sparkSession.createDataFrame([(f"column:{c}", "", "missing") for c in lacking], "rule string, key string, detail string"))
    return out


def expectations(observed: DataFrame, expected: dict[str, object]) -> DataFrame:
    """One-row table against pinned values: metric, expected, observed (as text), passed."""
    spark = observed.sparkSession
    long = observed.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, observed.columns)), F.array(*[F.col(c).cast("string") for c in observed.columns]))).alias("metric", "observed"))
    pins = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in expected.items()], "metric string, expected string")
    return pins.join(long, "metric", "left").withColumn("passed", F.col("expected").eqNullSafe(F.col("observed")))


def ledger(spark: SparkSession, checks: dict[str, tuple[list[str], dict]]) -> DataFrame:
    """A row for each named check: PASS without errors, else BLOCKED; evidence as JSON."""
    rows = [(n, "BLOCKED" if errors else "PASS", list(errors), strict_json(evidence)) for n, (errors, evidence) in checks.items()]
    return spark.createDataFrame(rows, LEDGER)


def gate(checks: DataFrame) -> DataFrame:
    """One row: checks, blocked ones, and READY or BLOCKED."""
    n = F.count_if(F.col("status") != "PASS")
    return checks.agg(F.count("*").alias("check_count"), n.alias("blocked_count"), F.when(n == 0, "READY").otherwise("BLOCKED").alias("readiness"))


def non_finite(df: DataFrame, key: str) -> DataFrame:
    """(key, column) of floating-point values that are NaN or infinite."""
    columns = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = F.array_compact(F.array(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), c) for c in columns]))
    return df.select(key, F.explode(bad).alias("column"))


def assert_finite(value: object, path: str = "$") -> None:
    """Fails at a NaN or infinite number, or a value that JSON has no form for, and says where."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"non-finite number at {path}")
    if isinstance(value, dict):
        for k, v in value.items():
            assert_finite(v, f"{path}.{k}")
    elif isinstance(value, (list, tuple)):
        for k, v in enumerate(value):
            assert_finite(v, f"{path}[{k}]")
    elif value is not None and not isinstance(value, (str, int, float, bool)):
        raise TypeError(f"{type(value).__name__} at {path}")


def strict_json(value: object) -> str:
    """Canonical JSON in one line, keys sorted."""
    assert_finite(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def refuse_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def load_strict_json(text: str) -> object:
    """JSON without NaN and Infinity."""
    return json.loads(text, parse_constant=refuse_constant)


def isolated(run: Callable[[DataFrame], DataFrame], table: DataFrame, forbidden: list[str], where: Column) -> DataFrame:
    """Rows in which run()'s results differ when the forbidden columns of some rows are overwritten; none if it never reads them."""
    changed = table.withColumns({c: F.when(where, F.lit(f"SENTINEL:{c}").cast(dict(table.dtypes)[c]) if dict(table.dtypes)[c] == "string" else F.lit(None).cast(dict(table.dtypes)[c])).otherwise(F.col(c)) for c in forbidden})
    a, b = run(table), run(changed)
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def columns_read(df: DataFrame) -> set[str]:
    """Columns that the physical plan's scans read: for proofs that a query doesn't touch others."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return {a.name() for k in range(leaves.size()) for a in _each(leaves.apply(k).output())}


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def isolation_split(df: DataFrame, split: str, held: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(held, rest): of the held split only the given columns; rows with a null split are in the rest."""
    return df.where(F.col(split) == held).select(*columns), df.where(F.coalesce(F.col(split) != held, F.lit(True)))


def compare_identity(expected: dict, observed: dict) -> list[str]:
    """Keys in which two run identities differ, sorted."""
    return sorted(k for k in expected.keys() | observed.keys() if expected.get(k, ...) != observed.get(k, ...))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def shard_integrity(observed: DataFrame, planned: DataFrame, shard: str, id_col: str) -> DataFrame:
    """Of each planned shard (expected_rows, first_id, last_id): whether rows, distinct ids, first and last id in the order `at` are as planned, and all of these."""
    own = observed.groupBy(shard).agg(F.count("*").alias("row_count"), F.count_distinct(id_col).alias("_ids"), F.min_by(id_col, "at").alias("_first"), F.max_by(id_col, "at").alias("_last"))
    out = planned.join(own, shard, "left").fillna(0, ["row_count", "_ids"])
    rules = {"rows_match": F.col("row_count") == F.col("expected_rows"), "ids_unique": F.col("_ids") == F.col("row_count"), "first_matches": F.col("_first").eqNullSafe(F.col("first_id")), "last_matches": F.col("_last").eqNullSafe(F.col("last_id"))}
    return out.select(shard, "row_count", *[c.alias(n) for n, c in rules.items()], all_of(*rules.values()).alias("intact"))
