"""Files and archives as tables."""

from __future__ import annotations

import io
import json
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.functions.classify import safe_member
from vetra.sources.containers import as_batches, locator_contents, walk

__all__ = ["archive_status", "files", "gzip_mtime", "id_lists", "json_config", "listing", "locator_contents", "npy_arrays", "zip_contents", "zip_members"]

MEMBERS = "archive string, member string, depth int, compressed_bytes long, uncompressed_bytes long, crc32 string, compression int, external_attributes long, is_dir boolean, status string"
CONTENTS = "archive string, member string, content binary, status string"


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length and modificationTime of all files below a folder; no contents."""
    return files(spark, path, pattern).select("path", "length", "modificationTime")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """listing() with content. A file is one value, so 2 GiB at most."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def zip_members(archives: DataFrame, nested: bool = False) -> DataFrame:
    """A row for each entry of ZIP files' directories (path, content), and of those within them, to any depth, if nested; with is_symlink and safe.

    status is OK; an archive that can't be read has one row without a member, BAD_ZIP, and one that holds itself is CYCLE. Here a file is one value; see containers.archives()
    for files of any size.
    """
    names = [f.split()[0] for f in MEMBERS.split(", ")]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found in as_batches(walk(io.BytesIO(data.as_py()), path, nested=nested, contents=False)):
                    yield found.select(names)

    out = archives.select("path", "content").mapInArrow(members, MEMBERS)
    return out.withColumns({"is_symlink": F.shiftright("external_attributes", 16).bitwiseAND(0o170000) == 0o120000, "safe": safe_member(F.col("member"))})


def zip_contents(archives: DataFrame, suffix: str = "") -> DataFrame:
    """Contents of ZIP files' members with the suffix; status OK, or CRC_FAILURE with a null content. A broken archive is a row BAD_ZIP without a member. Members go out in small batches."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(path, data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["archive", "member", "content", "status"])

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield (path, None, None, "BAD_ZIP")
            return
        for x in z.infolist():
            if not x.is_dir() and x.filename.endswith(suffix):
                try:
                    yield (path, x.filename, z.read(x), "OK")
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    yield (path, x.filename, None, "CRC_FAILURE")

    return archives.select("path", "content").mapInArrow(contents, CONTENTS)


def archive_status(archives: DataFrame) -> DataFrame:
    """(path, status, member_count, unsafe_members, corrupt_member); status NOT_ZIP, BAD_ZIP, CRC_FAILURE, UNSAFE_PATH or OK."""
    schema = "path string, is_zip boolean, opened boolean, members array<string>, corrupt_member string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = [path, path.lower().endswith(".zip"), False, [], None]
                if row[1]:
                    try:
                        with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                            row[2:] = [True, z.namelist(), z.testzip()]
                    except zipfile.BadZipFile:
                        pass
                rows.append(row)
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "is_zip", "opened", "members", "corrupt_member"])

    out = archives.select("path", "content").mapInArrow(look, schema).withColumn("unsafe_members", F.filter("members", lambda m: ~safe_member(m)))
    status = F.when(~F.col("is_zip"), "NOT_ZIP").when(~F.col("opened"), "BAD_ZIP").when(F.col("corrupt_member").isNotNull(), "CRC_FAILURE").when(F.size("unsafe_members") > 0, "UNSAFE_PATH").otherwise("OK")
    return out.select("path", status.alias("status"), F.size("members").alias("member_count"), "unsafe_members", "corrupt_member")


def npy_arrays(arrays: DataFrame) -> DataFrame:
    """(path, samples array<float>) of .npy files (path, content)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.load(io.BytesIO(x.as_py()), allow_pickle=False).astype(np.float32).ravel() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["path", "samples"])

    return arrays.select("path", "content").mapInArrow(load, "path string, samples array<float>")


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def id_lists(data: bytes) -> dict[str, list]:
    """A pickle of a dictionary of lists, on the driver: plain values alone, any class fails."""
    found = _Plain(io.BytesIO(data)).load()
    if not isinstance(found, dict) or not all(isinstance(k, str) and isinstance(v, (list, tuple, set)) for k, v in found.items()):
        raise ValueError("no dictionary of lists")
    return {k: list(v) for k, v in found.items()}


def gzip_mtime(data: bytes) -> int:
    """The time in a gzip header."""
    if data[:2] != b"\x1f\x8b":
        raise ValueError("no gzip data")
    return int.from_bytes(data[4:8], "little")


def json_config(text: str) -> dict:
    return json.loads(text)
