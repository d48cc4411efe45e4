"""Decoding and measuring audio: Arrow-batched functions over binary columns."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vetra.functions.numbers import ratio

SILENT, CLIPPED = 1e-4, 0.999
# MPEG layer III bitrates in kbit/s by index, of version 1 and of 2 and 2.5; sample rates by version bits.
MPEG1_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_RATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

WAVE = (
    "parse_status string, parse_error string, codec string, audio_format_tag int, channels int, sample_rate_hz int, bits_per_sample int, block_align int, byte_rate int, data_bytes long, frames long, duration_seconds double, "
    "pcm_sha256 string, sample_count long, nonfinite_count long, silent_count long, clipped_count long, sum_squares double, peak double"
)
_WAVE_NAMES = [x.split()[0] for x in WAVE.split(", ")]


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """RIFF chunks of a WAVE file; each starts at an even place."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    view, at = memoryview(data), 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise ValueError("a chunk ends behind the file")
        yield data[at : at + 4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def samples(data: bytes | memoryview, tag: int, bits: int) -> np.ndarray:
    """Normalised samples: integers of 8 (unsigned), 16, 24 and 32 bits, floats of 32 and 64."""
    if tag == 1 and bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").ravel() >> 8) / float(1 << 23)
    kinds = {(1, 8): ("u1", 128.0, 128.0), (1, 16): ("<i2", 0.0, 2.0**15), (1, 32): ("<i4", 0.0, 2.0**31), (3, 32): ("<f4", 0.0, 1.0), (3, 64): ("<f8", 0.0, 1.0)}
    if (tag, bits) not in kinds:
        raise ValueError(f"no decoder for format {tag} of {bits} bits")
    kind, zero, scale = kinds[tag, bits]
    return (np.frombuffer(data, kind).astype(np.float64) - zero) / scale


def quality(x: np.ndarray) -> dict[str, float]:
    """Counts and sums that add up over parts of a signal (the peak: the greatest)."""
    fine = x[np.isfinite(x)]
    size = np.abs(fine)
    return {"sample_count": len(x), "nonfinite_count": len(x) - len(fine), "silent_count": int((size < SILENT).sum()), "clipped_count": int((size >= CLIPPED).sum()), "sum_squares": float(fine @ fine), "peak": float(size.max(initial=0.0))}


def inspect_wave(data: bytes) -> dict:
    """A WAVE file's format, digest of its samples and quality; parse_status OK or ERROR."""
    out: dict = dict.fromkeys(_WAVE_NAMES) | {"parse_status": "OK"}
    try:
        parts = dict(reversed(list(chunks(data))))  # of repeated chunks, the first
        fmt, body = bytes(parts[b"fmt "]), parts[b"data"]
        tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", fmt)
        real = struct.unpack_from("<I", fmt, 24)[0] if tag == 0xFFFE else tag
        codec = {1: "pcm_u8" if bits == 8 else f"pcm_s{bits}le", 3: f"pcm_f{bits}le"}.get(real, f"wave_format_{real}")
        out |= {"codec": codec, "audio_format_tag": tag, "channels": channels, "sample_rate_hz": rate, "bits_per_sample": bits, "block_align": align, "byte_rate": byte_rate, "data_bytes": len(body)}
        if not align or len(body) % align:
            raise ValueError("data is no whole number of frames")
        out |= {"frames": len(body) // align, "duration_seconds": len(body) / align / rate if rate else None, "pcm_sha256": hashlib.sha256(body).hexdigest()} | quality(samples(body, real, bits))
    except (ValueError, KeyError, struct.error) as e:
        out |= {"parse_status": "ERROR", "parse_error": f"{type(e).__name__}: {e}"}
    return out


def wave_audit(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row for each file: the key, WAVE's columns, and rms, silent_fraction, clipped_fraction (by finite samples; null without any)."""

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [inspect_wave(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], f.type) for n, f in zip(_WAVE_NAMES, types, strict=True))], [key, *_WAVE_NAMES])

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [pa.field(n, kinds[t]) for n, t in (x.split() for x in WAVE.split(", "))]
    out = files.select(key, content).mapInArrow(audit, f"{key} {dict(files.dtypes)[key]}, {WAVE}")
    fine = F.col("sample_count") - F.col("nonfinite_count")
    return out.withColumns({"rms": F.sqrt(ratio(F.col("sum_squares"), fine)), "silent_fraction": ratio(F.col("silent_count"), fine), "clipped_fraction": ratio(F.col("clipped_count"), fine)})


def merge_quality(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Quality of wholes from that of their parts."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sample_count", "nonfinite_count", "silent_count", "clipped_count", "sum_squares")], F.max("peak").alias("peak"))


def array_quality(x: Column) -> Column:
    """quality() of an array column, as a struct, without Python."""
    values = F.transform(x, lambda v: v.cast("double"))
    fine = F.filter(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    total = lambda f: F.aggregate(fine, F.lit(0.0), lambda a, v: a + f(v))
    n = F.size(fine)
    return F.struct(
        F.size(values).alias("sample_count"), (F.size(values) - n).alias("nonfinite_count"),
        F.size(F.filter(fine, lambda v: F.abs(v) < SILENT)).alias("silent_count"), F.size(F.filter(fine, lambda v: F.abs(v) >= CLIPPED)).alias("clipped_count"),
        F.coalesce(F.array_max(F.transform(fine, F.abs)), F.lit(0.0)).alias("peak"), F.sqrt(ratio(total(lambda v: v * v), n)).alias("rms"),
    )


#: Fields of an MPEG frame header, a 32-bit number: the lowest bit and the bits of each.
HEADER = {"sync": (21, 11), "version": (19, 2), "layer": (17, 2), "rate": (12, 4), "hertz": (10, 2), "padding": (9, 1)}
#: By version bits: kbit/s by index, samples of a frame over 8, sample rates by index. Indices that the standard doesn't assign aren't there.
VERSIONS = {v: (MPEG1_RATES if v == 3 else MPEG2_RATES, 144 if v == 3 else 72, rates) for v, rates in SAMPLE_RATES.items()}


def frame_length(data: bytes, at: int) -> int | None:
    """Bytes of the MPEG layer III frame whose header is there, or null."""
    number = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
    h = {name: number >> low & (1 << bits) - 1 for name, (low, bits) in HEADER.items()}
    kbit, samples_8th, hertz = VERSIONS.get(h["version"], ((), 0, ()))
    known = h["sync"] == 0x7FF and h["layer"] == 1 and 0 < h["rate"] < len(kbit) and h["hertz"] < len(hertz)
    return samples_8th * 1000 * kbit[h["rate"]] // hertz[h["hertz"]] + h["padding"] if known else None


def audio_status(name: str, data: bytes) -> str:
    """Whether the head of a file is what its name says: a WAVE header, or two MPEG frames in a row behind any ID3 tag."""
    if name.lower().endswith(".wav"):
        return "WAVE_VALIDATED" if data[:4] in (b"RIFF", b"RF64") and data[8:12] == b"WAVE" else "WAVE_SIGNATURE_INVALID"
    start = 0
    if data[:3] == b"ID3" and len(data) >= 10 and max(data[6:10]) < 128:
        start = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    at = data.find(b"\xff", start)
    while at >= 0:
        if (n := frame_length(data, at)) and frame_length(data, at + n):
            return "MP3_FRAMES_VALIDATED"
        at = data.find(b"\xff", at + 1)
    return "MP3_SIGNATURE_INVALID"


@F.pandas_udf(StringType())
def signature_status(name: pd.Series, content: pd.Series) -> pd.Series:
    """audio_status() of names and contents."""
    return pd.Series([audio_status(n or "", bytes(c or b"")[: 2 << 20]) for n, c in zip(name, content, strict=True)])


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation between the centres of samples, ends held."""
    if source == target:
        return x
    n = max(1, round(len(x) * target / source))
    at = np.maximum((np.arange(n) + 0.5) * len(x) / n - 0.5, 0)
    return np.interp(at, np.arange(len(x)), x)


def waveform(data: bytes, rate: int = 16_000) -> np.ndarray:
    """A WAVE file as mono float32 at the rate, within [-1, 1]; samples that aren't finite fail."""
    parts = dict(reversed(list(chunks(data))))
    fmt = bytes(parts[b"fmt "])
    tag, channels, own, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    tag = struct.unpack_from("<I", fmt, 24)[0] if tag == 0xFFFE else tag
    x = samples(parts[b"data"], tag, bits).reshape(-1, channels).mean(axis=1)
    if not np.isfinite(x).all():
        raise ValueError("samples that are not finite")
    return np.clip(resample(x, own, rate), -1, 1).astype(np.float32)


def decode_waves(files: DataFrame, key: str = "path", content: str = "content", rate: int = 16_000) -> DataFrame:
    """(key, samples array<float>) of WAVE files. What is no WAVE file fails; other codecs need an external decoder."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([waveform(x.as_py(), rate) for x in batch.column(1)], pa.list_(pa.float32()))], [key, "samples"])

    return files.select(key, content).mapInArrow(decode, f"{key} {dict(files.dtypes)[key]}, samples array<float>")


def segments(clips: DataFrame, samples_col: str, starts: Column, length: int) -> DataFrame:
    """A row for each start: segment (number), start, valid_count, and the samples, padded at the right with zeros to the length."""
    rest = [c for c in clips.columns if c != samples_col]
    rows = clips.select("*", F.posexplode(starts).alias("segment", "start"))
    part = F.slice(samples_col, (F.col("start") + 1).cast("int"), F.lit(length))
    rows = rows.select(*rest, "segment", "start", part.alias("_x"))
    return rows.select(*rest, "segment", "start", F.size("_x").alias("valid_count"), F.concat("_x", F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size("_x"))).alias("samples"))


def training_segment(clips: DataFrame, samples_col: str, offset: Column, length: int) -> DataFrame:
    """One segment of each clip: where the offset in [0, 1] says between the first and the last start, rounded half to even."""
    start = F.rint(offset * F.greatest(F.size(samples_col) - length, F.lit(0))).cast("int")
    return segments(clips, samples_col, F.array(start), length)


def mel_filter(rate: int = 16_000, size: int = 400, bins: int = 64, lowest: float = 20.0) -> np.ndarray:
    """Triangular filters (bins, size // 2 + 1) at even places on the mel scale, each with the sum 1.

    With whole places a < b < c of its corners, a filter rises from 0 at a to 1 at b - 1 and falls from 1 at b to 0 at c - 1.
    """
    mel = 2595 * np.log10(1 + np.array([lowest, rate / 2]) / 700)
    corners = 700 * (10 ** (np.linspace(*mel, bins + 2) / 2595) - 1)
    place = np.clip(((size + 1) * corners / rate).astype(int), 0, size // 2)[:, None]
    a = place[:-2]
    b = np.maximum(place[1:-1], a + 1)
    c = np.minimum(np.maximum(place[2:], b + 1), size // 2 + 1)
    k = np.arange(size // 2 + 1)
    rise, fall = (k - a) / np.maximum(b - a - 1, 1), 1 - (k - b) / np.maximum(c - b - 1, 1)
    out = np.select([(a <= k) & (k < b), (b <= k) & (k < c)], [rise, fall])
    return out / np.maximum(out.sum(1, keepdims=True), 1e-8)


def log_mel(x: np.ndarray, valid: int, filters: np.ndarray, size: int = 400, hop: int = 160) -> np.ndarray:
    """log(1 + mel power) of centred, mirrored frames, with mean 0 and sample deviation 1 over frames whose centre is valid; 0 on the others, so everywhere if none is."""
    x = np.where(np.arange(len(x)) < valid, x, 0).astype(float)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2, mode="reflect"), size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    out = np.log1p(np.abs(np.fft.rfft(frames * window)) ** 2 @ filters.T)
    inside = np.arange(len(out)) * hop < valid
    n = max(int(inside.sum()) * out.shape[1], 2)
    centred = (out - out[inside].sum() / n) * inside[:, None]
    return (centred / max(((centred**2).sum() / (n - 1)) ** 0.5, 1e-5)).T


def log_mel_features(clips: DataFrame, key: str, samples_col: str = "samples", valid: str = "valid_count", rate: int = 16_000, bins: int = 64) -> DataFrame:
    """(key, features array<array<float>>) by log_mel()."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = mel_filter(rate, bins=bins)
        for batch in batches:
            rows = [log_mel(np.asarray(x.values), n, filters).astype(np.float32).tolist() for x, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.list_(pa.float32())))], [key, "features"])

    return clips.select(key, samples_col, valid).mapInArrow(features, f"{key} {dict(clips.dtypes)[key]}, features array<array<float>>")
