"""Archives by range: their directories and members as rows, read by many tasks; and what locators point at.

Files are opened by pyarrow's file systems (local, S3, GCS, HDFS), of which only the ranges that are needed are read: one task streams through a ZIP's directory
and cuts it into runs, and those that read members get the part of the directory that lists them. Archives are written in parts, by many tasks.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from vetra.functions.classify import locator, safe_member

MEMBERS = "archive string, member string, depth int, chunk int, compressed_bytes long, uncompressed_bytes long, crc32 string, compression int, external_attributes long, is_dir boolean, status string, content binary"
NAMES = [c.split()[0] for c in MEMBERS.split(", ")]
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
TYPES = [KINDS[c.split()[1]] for c in MEMBERS.split(", ")]
#: Members, and bytes of them, that one task reads from an archive, but for a larger single member.
RUN_MEMBERS, RUN_BYTES = 1_000, 1 << 28
#: Bytes of a row's content; a larger member is several rows, by `chunk`.
CHUNK_BYTES = 1 << 26
READ_BYTES = 1 << 20
#: Members, and bytes, of a part of a written archive, but for a larger last member. Places within it fit into 32 bits.
PART_MEMBERS, PART_BYTES = 50_000, 1 << 30
UNREADABLE = (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError)

Test = Callable[[str], bool]


class _Raw(io.RawIOBase):
    """A file of pyarrow's, with the errors of Python's."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.size)[whence]
        if to < 0:
            raise OSError("before the file's beginning")
        self.file.seek(min(to, self.size))
        return min(to, self.size)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _raw(path: str) -> _Raw:
    if "://" in path or path.startswith("file:/"):
        store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    else:
        store, name = fs.LocalFileSystem(), path
    return _Raw(store.open_input_file(name))


def opened(path: str) -> io.BufferedReader:
    """A file by its URI or path, for reads at any place; READ_BYTES of it come at once."""
    return io.BufferedReader(_raw(path), READ_BYTES)


def _directory(file: io.IOBase) -> tuple[int, int, int]:
    """(start, bytes, offset) of an archive's directory by its end record; the offset is the start less what the file has before the archive."""
    size = file.seek(0, 2)
    before = max(size - (1 << 16) - 98, 0)  # the end record, 65,535 bytes of comment, and the records of large archives
    file.seek(before)
    tail = file.read(size - before)
    at = len(tail) - 22 if tail[-22:-18] == b"PK\5\6" and tail[-2:] == b"\0\0" else tail.rfind(b"PK\5\6")
    if at < 0 or at + 22 > len(tail):
        raise zipfile.BadZipFile("no end record")
    length, offset = struct.unpack_from("<2L", tail, at + 12)
    if at >= 76 and tail[at - 20 : at - 16] == b"PK\6\7" and tail[at - 76 : at - 72] == b"PK\6\6":
        at -= 76
        length, offset = struct.unpack_from("<2Q", tail, at + 40)
    if before + at < length:
        raise zipfile.BadZipFile("no room for the directory")
    return before + at - length, length, offset


def _ending(count: int, length: int, offset: int) -> bytes:
    """The end records, in the form for large archives, of a directory of so many entries and bytes at this offset."""
    large = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, length, offset) + struct.pack("<4sLQL", b"PK\6\7", 0, offset + length, 1)
    return large + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(length, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def _entries(file: io.IOBase) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each entry of an archive's directory, as it streams by."""
    at, length, _ = _directory(file)
    end = at + length
    file.seek(at)
    while at < end:
        head = file.read(46)
        if len(head) < 46 or head[:4] != b"PK\1\2":
            raise zipfile.BadZipFile("no directory entry")
        rest = sum(struct.unpack_from("<3H", head, 28))
        yield at, head + file.read(rest)
        at += 46 + rest


def _name(entry: bytes) -> str:
    name = entry[46 : 46 + struct.unpack_from("<H", entry, 28)[0]]
    return name.decode("utf-8" if struct.unpack_from("<H", entry, 8)[0] & 0x800 else "cp437").split("\0")[0]


class _Part(io.RawIOBase):
    """An archive of whose directory only the entries between two places are there, so that its size doesn't matter to who reads them."""

    def __init__(self, file: _Raw, first: int, last: int):
        self.file, self.at = file, 0
        self.start, _, offset = _directory(file)
        file.seek(first)
        self.tail = file.read(last - first) + _ending(0, last - first, offset)  # readers go by bytes, not by the count

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.at, self.start + len(self.tail))[whence]
        if to < 0:
            raise OSError("before the file's beginning")
        self.at = to
        return to

    def readinto(self, buffer) -> int:
        if self.at < self.start:
            self.file.seek(self.at)
            data = self.file.read(min(len(buffer), self.start - self.at))
        else:
            data = self.tail[self.at - self.start : self.at - self.start + len(buffer)]
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _cut(file: io.IOBase, members: int, size: int, wanted: Test | None) -> Iterator[tuple[int, int]]:
    first = place = total = count = 0
    useful = False
    for at, entry in _entries(file):
        n = struct.unpack_from("<L", entry, 20)[0]
        if count and (total + n > size or count >= members):
            if useful:
                yield first, at
            total, count, useful = 0, 0, False
        if not count:
            first = at
        total, count, place = total + n, count + 1, at + len(entry)
        useful = useful or wanted is None or wanted(name := _name(entry)) or name.lower().endswith(".zip")
    if useful:
        yield first, place


def runs(archive: str, members: int = RUN_MEMBERS, size: int = RUN_BYTES, wanted: Test | None = None) -> list[tuple[int, int]]:
    """(first, last) places in the file, between which its directory lists the members of a run that tasks read; (-1, -1) if it has no directory. Runs without a wanted or nested member are left out."""
    try:
        with closing(opened(archive)) as file:
            return list(_cut(file, members, size, wanted))
    except (*UNREADABLE, OSError):
        return [(-1, -1)]


def _row(archive: str, x: zipfile.ZipInfo, depth: int, status: str, chunk: int = 0, content: bytes | None = None) -> tuple:
    return archive, x.filename, depth, chunk, x.compress_size, x.file_size, f"{x.CRC:08x}", x.compress_type, x.external_attr, x.is_dir(), status, content


def _chunks(z: zipfile.ZipFile, archive: str, x: zipfile.ZipInfo, depth: int, chunk_bytes: int) -> Iterator[tuple]:
    """The member's content; one that can't be read, or whose checksum fails, has a last row without content that says so."""
    k = 0
    try:
        with z.open(x) as member:
            while (part := member.read(chunk_bytes)) or not k:
                yield _row(archive, x, depth, "OK", k, part)
                k += 1
    except UNREADABLE:
        yield _row(archive, x, depth, "CRC_FAILURE", k)


def _identity(x: zipfile.ZipInfo) -> tuple[int, int]:
    return x.CRC, x.file_size


def walk(file, archive: str, nested: bool = True, contents: bool = True, wanted: Test | None = None, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The rows of the members of an archive, and, if nested, of those in archives among them, to any depth.

    An archive within an archive is read as a stream, not held whole. One that has the checksum and size of an archive around it would go on for ever: its status is CYCLE.
    """
    try:
        top = zipfile.ZipFile(file)
    except UNREADABLE:
        yield (archive, *[None] * 9, "BAD_ZIP", None)
        return
    around: list[tuple[zipfile.ZipFile, Iterator[zipfile.ZipInfo], str, tuple]] = [(top, iter(top.infolist()), archive, ())]
    while around:
        z, entries, name, _ = around[-1]
        if (x := next(entries, None)) is None:
            around.pop()
            continue
        depth = len(around) - 1
        own, inner = _identity(x), nested and not x.is_dir() and x.filename.lower().endswith(".zip")
        cycle = inner and own in [a[3] for a in around]
        if wanted is None or wanted(x.filename):
            if cycle or x.is_dir() or not contents:
                yield _row(name, x, depth, "CYCLE" if cycle else "OK")
            else:
                yield from _chunks(z, name, x, depth, chunk_bytes)
        if inner and not cycle:
            try:
                under = zipfile.ZipFile(z.open(x))
                around.append((under, iter(under.infolist()), f"{name}!/{x.filename}", own))
            except UNREADABLE:
                yield (f"{name}!/{x.filename}", None, depth + 1, *[None] * 7, "BAD_ZIP", None)


def read_run(archive: str, first: int, last: int, **options) -> Iterator[tuple]:
    """walk() of a run of an archive by its path; a run from -1 is one of an archive without a directory."""
    if first < 0:
        yield (archive, *[None] * 9, "BAD_ZIP", None)
        return
    with closing(io.BufferedReader(_Part(_raw(archive), first, last), READ_BYTES)) as file:
        yield from walk(file, archive, **options)


def as_batches(rows: Iterable[tuple], rows_most: int = 512, bytes_most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if len(held) >= rows_most or size >= bytes_most:
            yield make()
            held, size = [], 0
    if held:
        yield make()


class _Run(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Names:
    """What pushed filters say of member names."""

    def __init__(self) -> None:
        self.parts: list[Filter] = []

    def take(self, f: Filter) -> bool:
        fits = isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("member",)
        if fits:
            self.parts.append(f)
        return fits

    def __call__(self, name: str) -> bool:
        return all(
            name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) if isinstance(f, StringStartsWith) else name.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in name
            for f in self.parts
        )


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.names = options["path"], _Names()
        yes = lambda k: options.get(k, "true").lower() == "true"
        self.nested, self.contents = yes("nested"), yes("contents")
        self.members, self.size, self.chunk = (int(options.get(k, v)) for k, v in (("runMembers", RUN_MEMBERS), ("runBytes", RUN_BYTES), ("chunkBytes", CHUNK_BYTES)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.names.take(f)]

    def partitions(self) -> list[_Run]:
        return [_Run(*r) for r in runs(self.path, self.members, self.size, self.names)] or [_Run(0, 0)]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        rows = read_run(self.path, partition.first, partition.last, nested=self.nested, contents=self.contents, wanted=self.names, chunk_bytes=self.chunk)
        return as_batches(rows if partition.last else ())


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path): the members of one ZIP file, a partition for each run of them, whatever its size.

    Options: nested, contents (true), runMembers, runBytes, chunkBytes. Filters on `member` reach the directory, so that members that they exclude are never
    read; spark.sql.python.filterPushdown.enabled must be true.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """One archive by ArchiveSource, with filters on members pushed to its directory."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def archives(paths: DataFrame, pattern: str | None = None, nested: bool = True, contents: bool = True, members: int = RUN_MEMBERS, size: int = RUN_BYTES) -> DataFrame:
    """The members of all archives of a table (path): tasks read directories and make runs, which are dealt anew, so a large archive is read by many tasks too.

    pattern: a glob that members' names must fit, judged before their contents are read. An archive that can't be read is a row BAD_ZIP. Nothing is gathered on the driver.
    """
    fits = (lambda name: fnmatch.fnmatchcase(name, pattern)) if pattern else None

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = runs(path, members, size, fits)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(pa.array([r[k] for r in found], pa.int64()) for k in (0, 1))], ["path", "first", "last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield from as_batches(read_run(path, first, last, nested=nested, contents=contents, wanted=fits))

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = paths.select("path").mapInArrow(plan, "path string, first long, last long")
    out = planned.repartition(n, "path", "first").mapInArrow(read, MEMBERS)
    return out.withColumns({"is_symlink": F.shiftright("external_attributes", 16).bitwiseAND(0o170000) == 0o120000, "safe": safe_member(F.col("member"))})


def _moved(entry: bytes, by: int) -> bytes:
    """A directory entry of a part for a place so many bytes on; one that 32 bits can't hold goes behind the sizes in the extra field, where only zipfile's own such field can be."""
    place = struct.unpack_from("<L", entry, 42)[0] + by
    if place < 0xFFFFFFFF:
        return entry[:42] + struct.pack("<L", place) + entry[46:]
    n, extra = struct.unpack_from("<2H", entry, 28)
    sizes = entry[50 + n : 46 + n + extra]
    large = struct.pack("<2H", 1, len(sizes) + 8) + sizes + struct.pack("<Q", place)
    return entry[:6] + struct.pack("<H", 45) + entry[8:30] + struct.pack("<H", len(large)) + entry[32:42] + b"\xff" * 4 + entry[46 : 46 + n] + large + entry[46 + n + extra :]


def _joined(out, parts: list[str]) -> int:
    """The archives at these paths as one: their members' bytes as they are, then a directory of all; how many members. One part's directory is held at a time."""
    places = []
    for path in parts:
        with closing(_raw(path)) as file:
            left = _directory(file)[0]
            places.append(out.tell())
            file.seek(0)
            while left:
                data = file.read(min(left, 1 << 24))
                out.write(data)
                left -= len(data)
    start, count = out.tell(), 0
    for path, by in zip(parts, places, strict=True):
        with closing(opened(path)) as file:
            entries = [_moved(entry, by) for _, entry in _entries(file)]
        out.write(b"".join(entries))
        count += len(entries)
    out.write(_ending(count, out.tell() - start, start))
    return count


def write_archives(df: DataFrame, folder: str, archive_col: str, member_col: str, content_col: str) -> DataFrame:
    """(archive, members, bytes) of ZIP files in a folder, one for each archive name, with members in the order of their names. A file appears whole, under its name, or not at all.

    Ranges of (archive, member) are compressed by tasks, each into parts of its own; then one task for an archive copies its parts' bytes one after the other.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        now = z = out = path = first = None
        count = turn = 0

        def close() -> pa.RecordBatch:
            z.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([turn], pa.int32()), pa.array([path])], ["a", "m", "turn", "part"])

        for batch in batches:
            for name, member, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != now or count >= PART_MEMBERS or out.tell() >= PART_BYTES:
                    if z is not None:
                        yield close()
                    now, first, count, turn, path = name, member, 0, turn + 1, f".{name}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(f"{base}/{path}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
                count += 1
        if z is not None:
            yield close()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        rows = ((name, part) for batch in batches for name, part in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True))
        for name, own in groupby(rows, key=lambda r: r[0]):
            parts, whole = [part for _, part in own], f"{base}/.{name}.{uuid.uuid4().hex}.whole"
            with store.open_output_stream(whole) as out:
                count = _joined(out, [f"{folder}/{part}" for part in parts])
                size = out.tell()
            store.move(whole, f"{base}/{name}")
            for part in parts:
                store.delete_file(f"{base}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["archive", "members", "bytes"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(archive_col).alias("a"), F.col(member_col).alias("m"), F.col(content_col).cast("binary").alias("c"))
    parts = rows.repartitionByRange(n, "a", "m").sortWithinPartitions("a", "m").mapInArrow(write, "a string, m string, turn int, part string")
    return parts.repartition("a").sortWithinPartitions("a", "m", "turn").mapInArrow(join, "archive string, members long, bytes long")


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of locators, which come sorted by container; the last container stays open."""
    import pyarrow.parquet as pq

    name = held = None
    group: tuple = ()

    def fetch(kind: str, container: str, member: str | None, row: int | None) -> bytes | None:
        nonlocal name, held, group
        if kind == "file":
            with closing(opened(container)) as file:
                return file.read()
        if (kind, container) != name:
            name, held, group = None, None, ()
            file = opened(container)
            held = zipfile.ZipFile(file) if kind == "zip" else pq.ParquetFile(file)
            name = (kind, container)
        if kind == "zip":
            return held.read(member)
        if not (group and group[0] <= row < group[1]):
            start = 0
            for k in range(held.metadata.num_row_groups):
                n = held.metadata.row_group(k).num_rows
                if start <= row < start + n:
                    group = (start, start + n, held.read_row_group(k, columns=["audio.bytes"]).column("audio"))
                    break
                start += n
            else:
                return None
        return group[2][row - group[0]].as_py()["bytes"]

    for batch in batches:
        for k in range(batch.num_rows):
            place, kind, container, member, row = (batch.column(c)[k].as_py() for c in range(5))
            try:
                content, status = fetch(kind, container, member, row), "OK"
            except (KeyError, OSError, *UNREADABLE) as e:
                content, status = None, "MISSING" if isinstance(e, (KeyError, OSError)) else "CRC_FAILURE"
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([content], pa.binary()), pa.array(["MISSING" if content is None and status == "OK" else status])], ["_place", "content", "status"])


def locator_contents(spark: SparkSession, locators: DataFrame, column: str = "source_locator") -> DataFrame:
    """Locators (paths, zip://container!/member, parquet://path#row=n) with kind, container, the bytes they point at, and status: OK, MISSING or CRC_FAILURE.

    Locators are dealt by range of (container, member or row), so neighbours share an open container, and one container of very many goes to many tasks. Only
    the ranges of the members asked for are read. Parquet rows count from 0; their bytes are audio.bytes. Repeated locators have a row each.
    """
    parts = locator(F.col(column))
    own = locators.select(F.struct("*").alias("_own"), parts.alias("_l"))
    by: list[Column] = [F.col("_l.container"), F.col("_l.row"), F.col("_l.member")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = own.select("_l").distinct().repartitionByRange(n, *by).sortWithinPartitions(*by)
    keys = keys.select(F.xxhash64("_l.kind", "_l.container", "_l.member", "_l.row").alias("_place"), "_l.kind", "_l.container", "_l.member", "_l.row")
    found = keys.mapInArrow(_fetched, "_place long, content binary, status string")
    out = own.join(found, F.xxhash64("_l.kind", "_l.container", "_l.member", "_l.row") == F.col("_place"), "left")
    return out.select("_own.*", F.col("_l.kind").alias("kind"), F.col("_l.container").alias("container"), "content", "status")
