import gzip
import io
import json
import math
import pickle
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vetra.functions import numbers
from vetra.operators import audio
from vetra.sources import files, sinks, tables
from vetra.streaming import resume


def sine(seconds=0.25, rate=16000, channels=1):
    n = int(seconds * rate)
    body = struct.pack(f"<{n * channels}h", *[round(10000 * math.sin(2 * math.pi * 440 * k / rate)) for k in range(n) for _ in range(channels)])
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def test_csv(spark, tmp_path):
    plain, packed = tmp_path / "a.csv", tmp_path / "a.csv.gz"
    data = "\ufeffid,name\n1,\"x,\"\"y\"\"\"\n2,\n".encode()
    plain.write_bytes(data)
    packed.write_bytes(gzip.compress(data))
    for p in (plain, packed):
        assert rows(tables.csv(spark, str(p), ["id", "name"])) == [("1", 'x,"y"'), ("2", None)]
    with pytest.raises(ValueError, match="header"):
        tables.csv(spark, str(plain), ["id"])
    assert tables.csv_if_there(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0
    assert rows(tables.numbered_csv(spark, str(plain), ["id", "name"]).select("line_number")) == [(2,), (3,)]


def test_odd_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text('a|b "q|c\nbroken|line\n')
    good, bad = tables.piped(spark, str(tmp_path / "p.txt"), ["i", "j", "k"])
    assert rows(good) == [("a", 'b "q', "c")] and rows(bad) == [("broken|line", 2)]
    (tmp_path / "t.csv").write_text(",track,set\n,title,split\ntrack_id,,\n7,x,train\n")
    assert rows(tables.two_level_csv(spark, str(tmp_path / "t.csv"))) == [(7, "x", "train")]
    (tmp_path / "c.txt").write_text("AB12  a/b.mp3\n\\cd34 *c\\d.mp3\n")
    assert rows(tables.checksum_list(spark, str(tmp_path / "c.txt"))) == [("a/b.mp3", "ab12"), ("c/d.mp3", "cd34")]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnope\n')
    good, bad = tables.json_lines(spark, str(tmp_path / "j.jsonl"), "a int")
    assert rows(good) == [(1,)] and rows(bad) == [("nope",)]
    (tmp_path / "r.csv").write_text('a,b\n1,"x,y"\n1,2,3\n')
    assert tuple(tables.ragged_lines(spark, str(tmp_path / "r.csv")).first()) == (2, 1)


def test_parquet(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(a)
    spark.range(3).select(F.col("id").cast("string")).write.parquet(b)
    assert tables.parquet(spark, [a], ["id"]).count() == 3
    with pytest.raises(ValueError, match="schema"):
        tables.parquet(spark, [a, b])
    one = tables.parquet_with_ordinals(spark.newSession(), a, ["id"])
    assert one.count() == 3 and one.where("row_in_file = 0").count() >= 1


def test_archives(spark, tmp_path):
    inner = zipped(y_dot_txt=b"deep")
    (tmp_path / "o.zip").write_bytes(zipped(x_dot_txt=b"hello", in_dot_zip=inner, **{"..__evil": b"!"}))
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    (tmp_path / "n.txt").write_bytes(b"text")
    found = files.files(spark, str(tmp_path))
    members = files.zip_members(found.where("path like '%o.zip'"), nested=True)
    assert sorted((r.member, r.depth, r.safe) for r in members.collect()) == [("../evil", 0, False), ("in.zip", 0, True), ("x.txt", 0, True), ("y.txt", 1, True)]
    assert {r.member: bytes(r.content) for r in files.zip_contents(found.where("path like '%o.zip'"), ".txt").collect()} == {"x.txt": b"hello"}
    assert sorted(r.status for r in files.archive_status(found).collect()) == ["BAD_ZIP", "NOT_ZIP", "UNSAFE_PATH"]
    assert files.listing(spark, str(tmp_path), "*.zip").count() == 2


def test_side_files(spark, tmp_path):
    assert files.id_lists(pickle.dumps({"a": [1, 2]})) == {"a": [1, 2]}
    with pytest.raises(pickle.UnpicklingError):
        files.id_lists(pickle.dumps({"a": io.BytesIO}))
    packed = sinks.gzip_bytes(b"x" * 100)
    assert packed == sinks.gzip_bytes(b"x" * 100) and files.gzip_mtime(packed) == 0
    sinks.write_atomic(str(tmp_path / "f"), b"1", exclusive=True)
    with pytest.raises(FileExistsError):
        sinks.write_atomic(str(tmp_path / "f"), b"2", exclusive=True)
    with pytest.raises(FileExistsError):
        sinks.absent([str(tmp_path / "f")])
    df = spark.createDataFrame([(1, True, None)], "b int, a boolean, c string")
    assert sinks.csv_bytes(df) == b"b,a,c\r\n1,true,\r\n"
    assert [json.loads(r[0]) for r in sinks.json_rows(df).collect()] == [{"a": True, "b": 1, "c": None}]
    sinks.write_csv(df, str(tmp_path / "out"), ["b"])
    assert rows(tables.csv(spark, str(tmp_path / "out"))) == [("1",)]
    with pytest.raises(ValueError, match="without a field"):
        sinks.write_csv(df, str(tmp_path / "out2"), ["b"], extras="raise")
    assert "| 1 | True |  |" in sinks.markdown("T", {"s": df})


def test_wave(spark):
    df = spark.createDataFrame([("ok", bytearray(sine())), ("stereo", bytearray(sine(channels=2))), ("bad", bytearray(b"RIFF....WAVEfmt ")), ("none", None)], "path string, content binary")
    got = {r.path: r for r in audio.wave_audit(df).collect()}
    assert (got["ok"].frames, got["ok"].duration_seconds, got["ok"].codec, got["ok"].nonfinite_count) == (4000, 0.25, "pcm_s16le", 0)
    assert got["ok"].peak == pytest.approx(10000 / 32768, abs=1e-4) and got["ok"].rms == pytest.approx(10000 / 32768 / 2**0.5, abs=1e-3)
    assert got["stereo"].sample_count == 8000 and got["bad"].parse_status == got["none"].parse_status == "ERROR"
    clips = audio.decode_waves(df.where("path in ('ok', 'stereo')"), rate=8000)
    assert {r.path: len(r.samples) for r in clips.collect()} == {"ok": 2000, "stereo": 2000}
    cut = audio.segments(clips.where("path = 'ok'"), "samples", numbers.segment_starts(F.size("samples"), 1500, 8), 1500)
    assert rows(cut.select("start", "valid_count", F.size("samples"))) == [(0, 1500, 1500), (500, 1500, 1500)]
    short = audio.training_segment(clips.where("path = 'ok'"), "samples", F.lit(0.5), 3000).first()
    assert short.valid_count == 2000 and len(short.samples) == 3000
    features = audio.log_mel_features(cut, "start", rate=8000, bins=16).first().features
    assert len(features) == 16 and abs(np.mean(features)) < 1e-3


@pytest.mark.parametrize(("tag", "bits", "data", "want"), [(1, 8, bytes([128, 255]), [0, 127 / 128]), (1, 24, b"\x00\x00\x80\xff\xff\x7f", [-1, 1 - 2**-23]), (1, 32, struct.pack("<i", -(2**31)), [-1]), (3, 32, struct.pack("<f", 0.5), [0.5]), (3, 64, struct.pack("<d", 0.25), [0.25])])
def test_samples(tag, bits, data, want):
    assert audio.samples(data, tag, bits).tolist() == pytest.approx(want)


def test_frames(spark):
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    assert audio.frame_length(frame, 0) == 417
    df = spark.createDataFrame([("a.mp3", bytearray(frame * 2)), ("b.mp3", bytearray(frame)), ("c.mp3", bytearray(b"ID3\x03\x00\x00\x00\x00\x00\x02xx" + frame * 2)), ("d.wav", bytearray(sine()))], "n string, c binary")
    assert [r[0] for r in df.select(audio.signature_status("n", "c")).collect()] == ["MP3_FRAMES_VALIDATED", "MP3_SIGNATURE_INVALID", "MP3_FRAMES_VALIDATED", "WAVE_VALIDATED"]


def test_locators(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(sine())
    (tmp_path / "z.zip").write_bytes(zipped(m__b_dot_wav=sine(0.5)))
    spark.createDataFrame([("i", (bytearray(b"one"), "p")), ("j", (bytearray(b"two"), "p"))], "id string, audio struct<bytes: binary, path: string>").coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("part-*"))
    df = spark.createDataFrame([(f"{tmp_path}/a.wav",), (f"zip://{tmp_path}/z.zip!/m/b.wav",), (f"parquet://{part}#row=1",)], "source_locator string")
    got = {r.kind: bytes(r.content) for r in files.locator_contents(spark, df).collect()}
    assert got == {"file": sine(), "zip": sine(0.5), "parquet": b"two"}


def test_npy(spark):
    out = io.BytesIO()
    np.save(out, np.array([0.5, -1], np.float32))
    df = spark.createDataFrame([("x", bytearray(out.getvalue()))], "path string, content binary")
    assert files.npy_arrays(df).first().samples == [0.5, -1.0]


def test_resume(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    work = lambda df: df.withColumn("x", F.col("id") * 2)
    assert resume.append_pending(spark, spark.range(5), sink, ["id"], work) == 5
    assert resume.append_pending(spark, spark.range(7), sink, ["id"], work) == 2
    stream_sink, state = str(tmp_path / "s"), str(tmp_path / "c")
    for n in (5, 8):
        resume.process_new_files(spark, "id long", source, stream_sink, state, work).awaitTermination()
        assert spark.read.parquet(stream_sink).count() == n
        spark.range(5, 8).write.mode("append").parquet(source)
    before = resume.snapshot(spark, sink)
    before = spark.createDataFrame(before.collect(), before.schema)
    spark.range(1).write.mode("append").parquet(sink)
    assert {r.change for r in resume.changed(before, resume.snapshot(spark, sink)).collect()} == {"added"}


def test_progress():
    got = resume.progress(250, 1000, 50, 2.0, 100.0)
    assert got == {"percent": 25.0, "rate": 25.0, "eta_seconds": 30.0}
