"""Readers of delimited text, JSON, checksums and Parquet, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vetra.operators.ordinals import in_ranges


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def _fields(line: str) -> list[str]:
    import csv

    return next(csv.reader([line.lstrip("﻿")]))


def csv(spark: SparkSession, path: str, header: list[str] | None = None, partitions: int | None = None, multiline: bool = True) -> DataFrame:
    """A CSV file with a header, with or without byte order mark or gzip: all columns text, blanks null. Another header than the given one fails.

    Neither gzip nor a file that may have quoted line ends (multiline) is splittable: give partitions to spread what one task reads.
    """
    own = _fields(_first_lines(spark, path, 1)[0])
    if header is not None and own != header:
        raise ValueError(f"{path}: the header is {own}, not {header}")
    schema = StructType([StructField(c, StringType()) for c in own])
    out = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=multiline, quote='"', escape='"', mode="FAILFAST")
    return out.repartition(partitions) if partitions else out


def csv_if_there(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """csv(), or no rows where there is no file."""
    if exists(spark, path):
        return csv(spark, path)
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))


def piped(spark: SparkSession, path: str, columns: list[str], separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): lines of exactly the columns, without quoting; and the others, as text with their number of fields."""
    parts = F.split("value", f"\\Q{separator}\\E", -1)
    lines = spark.read.text(path).where("value <> ''").select("value", parts.alias("p"))
    good = lines.where(F.size("p") == len(columns)).select(*[F.col("p")[k].alias(c) for k, c in enumerate(columns)])
    return good, lines.where(F.size("p") != len(columns)).select(F.col("value").alias("line"), F.size("p").alias("field_count"))


def two_level_csv(spark: SparkSession, path: str, key: str = "track_id") -> DataFrame:
    """A CSV file with three header lines: upper names, lower names, and the key's name. Columns are key and upper.lower; all text."""
    upper, lower, _ = map(_fields, _first_lines(spark, path, 3))
    names = [key, *[f"{a}.{b}" for a, b in zip(upper[1:], lower[1:], strict=True)]]
    schema = StructType([StructField(c, StringType()) for c in names])
    rows = spark.read.csv(path, schema=schema, multiLine=True, quote='"', escape='"')
    return rows.where(F.col(f"`{key}`").rlike(r"^\d+$")).withColumn(key, F.col(f"`{key}`").cast("long"))


def numbered_csv(spark: SparkSession, path: str, header: list[str], multiline: bool = True) -> DataFrame:
    """csv() with line_number, from 2 for the first row behind a file's header.

    Quoted line ends make a file one task's work. Where there are none (multiline=False) a large file is split, and rows count through its splits. In a folder
    each file counts for itself.
    """
    rows = csv(spark, path, header, multiline=multiline)
    parts = rows.select(F.struct(*rows.columns).alias("_row"), F.col("_metadata.file_path").alias("_g0"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"))
    return in_ranges(parts, ["_g0"], "line_number", 2)


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of a list in the form that checksum tools write."""
    lines = spark.read.text(path)
    name = F.replace(F.regexp_extract("value", r"^\\?[0-9A-Fa-f]+\s+\*?(.+?)\s*$", 1), F.lit("\\"), F.lit("/"))
    return lines.select(name.alias("name"), F.lower(F.regexp_extract("value", r"^\\?([0-9A-Fa-f]+)\s", 1)).alias("digest")).where("name <> '' and digest <> ''")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of the schema, and lines that are no such JSON."""
    text = spark.read.text(path).where("trim(value) <> ''")
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    parsed = text.select("value", F.from_json("value", f"{kind}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select(F.col("value").alias("line"))


def parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Parquet files of one schema; a file of another one, or than the given one, fails. Only the columns asked for are read."""
    first = schema
    for path in paths:  # footers alone
        own = spark.read.parquet(path).schema
        if first is not None and [(f.name, f.dataType) for f in own] != [(f.name, f.dataType) for f in first]:
            raise ValueError(f"{path}: schema {own.simpleString()}, not {first.simpleString()}")
        first = own
    out = spark.read.schema(first).parquet(*paths)
    return out.select(*columns) if columns else out


def parquet_with_ordinals(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows with source_file and row_in_file, from 0, the row's place in its file: for joins with locators (see operators.lookup.by_ordinal)."""
    files = spark.read.parquet(path)
    return files.select(*columns, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").cast(LongType()).alias("row_in_file"))


def ragged_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """One row: lines behind the header, and those with another number of unquoted separators than it has."""
    lines = spark.read.text(path)
    plain = F.regexp_replace("value", '"([^"]|"")*"', "")
    n = F.size(F.split(plain, f"\\Q{separator}\\E", -1))
    width = len(_fields(_first_lines(spark, path, 1)[0]))
    return lines.select(n.alias("n"), F.col("_metadata.file_block_start")).agg((F.count("*") - 1).alias("row_count"), F.count_if(F.col("n") != width).alias("ragged_count"))
