"""Text cleaning, parsing and formatting, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_bool(x: Column) -> Column:
    """'true' in any letter case; all else, null too, is false."""
    return F.coalesce(F.lower(x), F.lit("")) == "true"


def parse_long(x: Column) -> Column:
    """Blank and null are 0; what is no number fails."""
    return F.coalesce(blank_to_null(x).cast("bigint"), F.lit(0).cast("bigint"))


def parse_double(x: Column) -> Column:
    return F.coalesce(blank_to_null(x).cast("double"), F.lit(0.0))


def token(x: Column) -> Column:
    """Lower case; runs of what is no ASCII letter or digit are one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def clean_path(x: Column) -> Column:
    """Slashes forward, without any run of dots and slashes at the start."""
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "^[./]+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)


def parse_hms(x: Column) -> Column:
    """Seconds of 'h:m:s', 'm:s' or 's'; null if it is none of them."""
    parts = F.transform(F.split(F.trim(x), ":"), lambda p: p.try_cast("double"))
    value = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(F.size(parts).between(1, 3), value)


def format_hms(seconds: Column) -> Column:
    """HH:MM:SS of seconds rounded half to even; hours go on beyond 24."""
    s = F.rint(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    return F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(s % 3600 / 60).cast("long")), two(s % 60))


def fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def zero_padded(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def has_non_ascii(x: Column) -> Column:
    return x.rlike(r"[^\x00-\x7F]")


def join_list(x: Column, by: str = ";") -> Column:
    """Distinct values, sorted, joined."""
    return F.array_join(F.array_sort(F.array_distinct(x)), by)


def split_list(x: Column, by: str = ";") -> Column:
    return F.filter(F.split(x, re.escape(by)), lambda v: v != "")


def tags(*cases: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order, joined by ;."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in cases])), ";")


def without_tag(x: Column, tag: str) -> Column:
    return F.array_join(F.array_remove(split_list(x), tag), ";")


def with_tag(x: Column, tag: str) -> Column:
    own = split_list(x)
    return F.array_join(F.when(F.array_contains(own, tag), own).otherwise(F.array_append(own, F.lit(tag))), ";")


@F.pandas_udf(StringType())
def text_key(x: pd.Series) -> pd.Series:
    """SHA-256 of the case-folded text with white space collapsed. A UDF: Spark has no case folding."""
    import hashlib

    return x.map(lambda t: None if t is None else hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest())


@F.pandas_udf(StringType())
def reference_key(x: pd.Series) -> pd.Series:
    """ASCII letters and digits after compatibility decomposition, lower case, words joined by a space. A UDF: Spark has no normalisation."""
    plain = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold()
    return x.map(lambda t: None if t is None else " ".join(re.findall("[a-z0-9]+", plain(t))))


def decoder_report(x: Column) -> Column:
    """struct(duration_seconds, container_kbps, codec, sample_rate_hz, channel_layout, channels, stream_kbps) from what a decoder prints of an input; nulls where it says nothing."""
    clock = r"Duration:\s*(\d+:\d+:[0-9.]+)"
    line = F.regexp_extract(x, r"(?m)^.*Stream #0:.*Audio:(.*)$", 1)
    parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
    number = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).cast("int")
    layout = F.get(parts, F.lit(2))
    return F.struct(
        parse_hms(F.nullif(F.regexp_extract(x, clock, 1), F.lit(""))).alias("duration_seconds"),
        number(x, r"Duration:[^\n]*bitrate:\s*(\d+)\s*kb/s").alias("container_kbps"),
        F.nullif(F.regexp_extract(line, r"^\s*(\S+?)(?:[\s,]|$)", 1), F.lit("")).alias("codec"),
        number(F.get(parts, F.lit(1)), r"(\d+)\s*Hz").alias("sample_rate_hz"),
        layout.alias("channel_layout"),
        F.when(layout == "mono", 1).when(layout == "stereo", 2).otherwise(number(layout, r"(\d+)\s*channels")).alias("channels"),
        number(line, r"(\d+)\s*kb/s").alias("stream_kbps"),
    )
