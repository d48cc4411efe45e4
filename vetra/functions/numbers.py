"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite. NaN goes first: Spark has it equal to itself and above infinity."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) | (a.isNull() & b.isNull())


def gain(decibel: Column) -> Column:
    return F.pow(F.lit(10.0), decibel / 20)


def hertz_to_mel(f: Column) -> Column:
    return 2595.0 * F.log10(1 + f / 700.0)


def mel_to_hertz(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def segment_starts(samples: Column, length: int, most: int) -> Column:
    """Where a clip's segments start: evenly from 0 to the last that fits, rounded half to even, each once; [0] for a short clip."""
    last = F.greatest(samples - length, F.lit(0))
    n = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(samples / length))).cast("int")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rint(i * (last / (n - 1))).cast("long")))
    return F.when(samples <= length, F.array(F.lit(0).cast("long"))).otherwise(starts)


def segment_count(seconds: Column, length: float = 8.0, most: int = 8) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(seconds / length))).cast("long")


def cache_bytes(seconds: Column, rate: int = 16_000) -> Column:
    """Bytes of a float32 array file of a clip, with its header."""
    return F.greatest(F.lit(1), F.ceil(seconds * rate)).cast("long") * 4 + 128


def stream_seconds(samples: Column, rate: Column, channels: Column) -> Column:
    return ratio(samples, rate * channels)
