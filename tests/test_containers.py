"""Archives by range, and locators."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vetra.sources import containers as c


def zipped(members, kind=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def deep(levels):
    data = zipped({"end.txt": b"bottom"})
    for k in range(levels):
        data = zipped({f"{k}.zip": data, f"{k}.txt": str(k).encode()})
    return data


def test_many_members_by_many_tasks(spark, tmp_path):
    """100,000 members: many partitions, each member once."""
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(100_000):
            z.writestr(f"d{k % 7}/{k}.txt", str(k))
    out = c.archive(spark, str(path), runMembers=5_000)
    assert out.rdd.getNumPartitions() == 20
    assert out.select(F.countDistinct("member"), F.sum(F.col("content").cast("string").cast("long"))).first() == (100_000, sum(range(100_000)))
    table = spark.createDataFrame([(str(path),)], "path string")
    dealt = c.archives(table, "*.txt", members=5_000)
    seen = dealt.select("member", F.spark_partition_id().alias("task")).agg(F.countDistinct("member"), F.countDistinct("task")).first()
    assert seen[0] == 100_000 and seen[1] > 1


def test_an_archive_of_over_two_gigabytes(spark, tmp_path):
    """Sparse, so that it takes no disk: the directory and the last members are beyond what one value can hold."""
    path = tmp_path / "huge.zip"
    inner = zipped({"a.txt": b"first", "b.txt": b"second"}, zipfile.ZIP_STORED)
    with open(path, "wb") as f:
        f.seek(3 << 30)
        f.write(inner)  # a ZIP file may have anything before it
    assert os.path.getsize(path) > 1 << 31
    out = c.archive(spark, str(path), runMembers=1)
    assert out.rdd.getNumPartitions() == 2
    assert {(r.member, bytes(r.content)) for r in out.collect()} == {("a.txt", b"first"), ("b.txt", b"second")}


def test_any_depth_and_cycles(spark, tmp_path, monkeypatch):
    (tmp_path / "deep.zip").write_bytes(deep(9))
    rows = c.archive(spark, str(tmp_path / "deep.zip"), runMembers=1).collect()
    assert max(r.depth for r in rows) == 9 and [bytes(r.content) for r in rows if r.member == "end.txt"] == [b"bottom"]
    assert c.archive(spark, str(tmp_path / "deep.zip"), nested=False).count() == 2
    # an archive with the checksum and size of the one around it
    found = list(c.walk(io.BytesIO(deep(2)), "x", contents=False))
    assert [r[10] for r in found] == ["OK"] * len(found)
    monkeypatch.setattr(c, "_identity", lambda x: (7, 7))
    assert [(r[1], r[10]) for r in c.walk(io.BytesIO(deep(3)), "x", contents=False)] == [("2.zip", "OK"), ("1.zip", "CYCLE"), ("1.txt", "OK"), ("2.txt", "OK")]


def test_filters_reach_the_directory(spark, tmp_path):
    (tmp_path / "f.zip").write_bytes(zipped({f"{k:03}.{'txt' if k % 2 else 'bin'}": str(k) * 10 for k in range(100)}))
    out = c.archive(spark, str(tmp_path / "f.zip"), runMembers=10)
    assert out.rdd.getNumPartitions() == 10 and out.where("member = '042.bin'").rdd.getNumPartitions() == 1
    assert [bytes(r.content) for r in out.where("member = '042.bin'").collect()] == [b"42" * 10]
    assert out.where("member like '09%' and member like '%txt' and depth = 0").count() == 5
    assert out.where("member in ('001.txt', '099.txt')").count() == 2 and out.where("member like '%3.t%'").count() == 10
    assert out.where("member = 'none'").count() == 0 and out.where("uncompressed_bytes = 10").count() == 10


def test_broken_archives(spark, tmp_path):
    good = zipped({"a.txt": b"hello" * 100, "b.txt": b"x"}, zipfile.ZIP_STORED)
    at = good.index(b"hello")
    (tmp_path / "crc.zip").write_bytes(good[:at] + b"j" + good[at + 1 :])
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    (tmp_path / "empty.zip").write_bytes(zipped({}))
    (tmp_path / "inner.zip").write_bytes(zipped({"in.zip": b"no archive", "d/": b""}))
    paths = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.zip"))] + [(str(tmp_path / "none.zip"),)], "path string").repartition(3)
    got = sorted((os.path.basename(r.archive), r.member or "", r.status) for r in c.archives(paths).collect())
    assert got == [
        ("bad.zip", "", "BAD_ZIP"), ("crc.zip", "a.txt", "CRC_FAILURE"), ("crc.zip", "b.txt", "OK"), ("in.zip", "", "BAD_ZIP"), ("inner.zip", "d/", "OK"), ("inner.zip", "in.zip", "OK"), ("none.zip", "", "BAD_ZIP"),
    ]
    assert c.archive(spark, str(tmp_path / "empty.zip")).count() == 0


def test_chunks(spark, tmp_path):
    data = os.urandom(1000)
    (tmp_path / "a.zip").write_bytes(zipped({"a": data, "b": b""}))
    rows = sorted((r.member, r.chunk, bytes(r.content)) for r in c.archive(spark, str(tmp_path / "a.zip"), chunkBytes=300).collect())
    assert [r[:2] for r in rows] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)] and b"".join(r[2] for r in rows) == data


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"{k % 3}.zip", f"m{k:02}", f"text {k}" if k else None) for k in range(20)], "a string, m string, t string").repartition(4)
    written = c.write_archives(df, f"file://{tmp_path}/out", "a", "m", "t")
    assert sorted((r.archive, r.members) for r in written.collect()) == [("0.zip", 7), ("1.zip", 7), ("2.zip", 6)]
    assert sorted(os.listdir(tmp_path / "out")) == ["0.zip", "1.zip", "2.zip"]
    paths = spark.createDataFrame([(f"file://{tmp_path}/out/{k}.zip",) for k in range(3)], "path string")
    assert {(r.member, bytes(r.content).decode()) for r in c.archives(paths).collect()} == {(r.m, r.t or "") for r in df.collect()}


def test_locators_of_one_hot_container(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(zipped({f"{k}.wav": str(k) for k in range(500)}))
    rows = [(k, f"zip://{tmp_path}/z.zip!/{k}.wav") for k in range(500)] + [(500, f"zip://{tmp_path}/z.zip!/none"), (501, f"{tmp_path}/none.wav"), (502, f"zip://{tmp_path}/z.zip!/7.wav"), (503, f"zip://{tmp_path}/no.zip!/a")]
    docs = spark.createDataFrame(rows, "id int, source_locator string")
    got = {r.id: (r.status, r.content and bytes(r.content)) for r in c.locator_contents(spark, docs).collect()}
    assert got == {**{k: ("OK", str(k).encode()) for k in range(500)}, 500: ("MISSING", None), 501: ("MISSING", None), 502: ("OK", b"7"), 503: ("MISSING", None)}
    with pytest.raises(Exception, match="broken locator"):
        c.locator_contents(spark, spark.createDataFrame([("zip://x",)], "source_locator string")).collect()


def test_a_run_reads_its_part_of_the_directory(tmp_path, monkeypatch):
    """Of 20,000 members a run of 100 makes no more than these, whatever comes before the archive."""
    path = tmp_path / "many.zip"
    path.write_bytes(b"before" + zipped({f"{k:05}.txt": str(k) for k in range(20_000)}))
    found = list(c.runs(str(path), 100))
    assert len(found) == 200
    made = []

    class Counted(zipfile.ZipInfo):
        def __init__(self, *a, **k):
            made.append(1)
            super().__init__(*a, **k)

    monkeypatch.setattr(zipfile, "ZipInfo", Counted)
    rows = list(c.read_run(str(path), *found[150]))
    assert [(r[1], bytes(r[-1])) for r in rows] == [(f"{k:05}.txt", str(k).encode()) for k in range(15_000, 15_100)] and len(made) == 100


def test_one_archive_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(30_000).select(F.lit("a.zip").alias("a"), F.format_string("ä%05d", "id").alias("m"), F.col("id").cast("string").alias("t")).repartition(3)
    out = c.write_archives(df, f"file://{tmp_path}/out", "a", "m", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(a" in plan
    assert [tuple(r)[:2] for r in out.collect()] == [("a.zip", 30_000)] and os.listdir(tmp_path / "out") == ["a.zip"]
    with zipfile.ZipFile(tmp_path / "out/a.zip") as z:
        assert z.testzip() is None and z.namelist() == [f"ä{k:05}" for k in range(30_000)] and z.read("ä12345") == b"12345"


def test_places_beyond_four_gigabytes(spark, tmp_path):
    """A part that is joined so far on, in a sparse file."""
    part, path, far = tmp_path / "part.zip", tmp_path / "far.zip", 5 << 30
    part.write_bytes(zipped({"a.txt": b"first", "b.txt": b"second" * 99}))
    with open(part, "rb") as f, open(path, "wb") as out:
        size = c._directory(f)[0]
        entries = b"".join(c._moved(entry, far) for _, entry in c._entries(f))
        f.seek(0)
        out.seek(far)
        out.write(f.read(size))
        out.write(entries + c._ending(2, len(entries), far + size))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("b.txt") == b"second" * 99
    assert {(r.member, bytes(r.content)) for r in c.archive(spark, str(path), runMembers=1).collect()} == {("a.txt", b"first"), ("b.txt", b"second" * 99)}
