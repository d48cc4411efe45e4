import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vetra.functions import classify, hashing, numbers, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("key", ["", "a", "ä|b", "42"])
def test_stable_unit_is_sha256(spark, key):
    want = int.from_bytes(hashlib.sha256(f"s|{key}".encode()).digest()[:8], "big") / 2**64
    assert one(spark, hashing.stable_unit(F.col("k"), "s"), k=key) == want
    split = "train" if want < 0.8 else "validation" if want < 0.9 else "test"
    assert one(spark, hashing.stable_split(F.col("k"), "s"), k=key) == split


def test_hashes(spark):
    assert one(spark, hashing.crc32_hex(F.encode("k", "utf-8")), k="abc") == f"{zlib.crc32(b'abc'):08x}"
    assert one(spark, hashing.composite_key(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"x\0").hexdigest()


@pytest.mark.parametrize(("said", "want"), [("1:02:03", 3723.0), ("2:03", 123.0), ("4.5", 4.5), ("x", None), ("1:x", None), ("1:2:3:4", None), (None, None)])
def test_parse_hms(spark, said, want):
    assert one(spark, text.parse_hms(F.col("k").cast("string")), k=said) == want


@pytest.mark.parametrize(("seconds", "want"), [(30.0, "00:00:30"), (3723.5, "01:02:04"), (0.5, "00:00:00"), (1.5, "00:00:02"), (360000.0, "100:00:00")])
def test_format_hms(spark, seconds, want):
    assert one(spark, text.format_hms(F.col("k")), k=seconds) == want


def test_text(spark):
    assert one(spark, text.clean_path(F.col("k")), k="./../a\\b") == "a/b"
    assert one(spark, text.token(F.col("k")), k="--A b!C--") == "a_b_c"
    assert one(spark, text.parse_bool(F.col("k")), k="TRUE") is True
    assert one(spark, text.parse_bool(F.col("k")), k=" true") is False
    assert one(spark, text.parse_long(F.col("k")), k="") == 0
    assert one(spark, text.suffix(F.col("k")), k="a/.hidden") == ""
    assert one(spark, text.stem(F.col("k")), k="a/x.tar.gz") == "x.tar"
    assert one(spark, text.with_tag(text.without_tag(F.col("k"), "a"), "c"), k="a;b") == "b;c"
    assert one(spark, text.text_key(F.col("k")), k="Straße  X") == hashlib.sha256(b"strasse x").hexdigest()
    assert one(spark, text.reference_key(F.col("k")), k="Café – 12!") == "cafe 12"


@pytest.mark.parametrize(
    ("title", "url", "want"),
    [
        ("CC0 1.0", "", "ALLOW_CC0"), ("", "http://x/publicdomain/zero/1.0", "ALLOW_CC0"), ("", "http://x/licenses/by-nc-sa/3.0", "ALLOW_BY_NC_SA"), ("", "http://x/licenses/by-nc-nd/3.0", "EXCLUDE_ND"),
        ("", "http://x/licenses/by-nd/3.0", "EXCLUDE_ND"), ("", "http://x/licenses/by-nc/3.0", "ALLOW_BY_NC"), ("", "http://x/licenses/by-sa/3.0", "ALLOW_BY_SA"), ("", "http://x/licenses/by/3.0", "ALLOW_BY"),
        ("", "http://x/licenses/by/", "ALLOW_BY"), ("", "  ", "EXCLUDE_UNKNOWN"), (None, None, "EXCLUDE_UNKNOWN"), ("", "http://x/FMA_License", "EXCLUDE_RESTRICTED"), ("", "http://x/licenses/by/x", "EXCLUDE_CUSTOM"),
    ],
)
def test_license(spark, title, url, want):
    assert one(spark, classify.license_category(F.col("t").cast("string"), F.col("u").cast("string")), t=title, u=url) == want


@pytest.mark.parametrize(("path", "safe"), [("a/b", True), ("/a", False), ("a/../b", False), ("C:/a", False), ("a/b:c", True), ("\\x", False), ("", True), ("./a", True)])
def test_safe_member(spark, path, safe):
    assert one(spark, classify.safe_member(F.col("k")), k=path) is safe


@pytest.mark.parametrize(
    ("head", "want"),
    [(b"RIFF1234WAVEfmt ", "WAV"), (b"fLaC", "FLAC"), (b"ID3\x03", "MP3_ID3"), (b"\xff\xfb", "MP3_FRAME"), (b"", "EMPTY"), (b"PK\x03\x04", "ZIP"), (b"\x80\x04", "PYTHON_PICKLE_OR_TORCH"), (b"{}", "JSON_TEXT"), (b"a,b", "UTF8_TEXT"), (b"hello", "UTF8_TEXT_OR_EMPTY"), (b"\x01\x02\x03\x04", "BINARY_UNKNOWN"), ("Просто текст. ".encode() * 9, "UTF8_TEXT_OR_EMPTY"), ("春眠不覺曉".encode() * 9, "UTF8_TEXT_OR_EMPTY"), (b"\xef\xbb\xbfa,b", "UTF8_TEXT"), (b" \n# x", "UTF8_TEXT"), (b"\xff\x00\xfe\x01", "BINARY_UNKNOWN"), (b"x" * 64 + b"\x01" * 999, "UTF8_TEXT_OR_EMPTY")],
)
def test_signature(spark, head, want):
    assert one(spark, classify.file_signature(F.col("k")), k=bytearray(head)) == want


def test_classifiers(spark):
    assert [one(spark, classify.duration_bucket(F.col("k")), k=v) for v in (4.0, 4.1, 15.0, 30.0, 31.0)] == ["00_to_04", "04_to_08", "08_to_15", "15_to_30", "30_plus"]
    assert one(spark, classify.extension_matches(F.col("k"), F.lit("MP3_ID3")), k="x.MP3") == "MATCH"
    assert one(spark, classify.extension_matches(F.col("k"), F.lit("ZIP")), k="x.mp3") == "MISMATCH"
    assert one(spark, classify.extension_matches(F.col("k"), F.lit("ZIP")), k="x.xyz") == "NO_SIGNATURE_RULE"
    assert one(spark, classify.extension_matches(F.col("k"), F.lit("ZIP")), k="w.bin") == "MATCH"
    assert one(spark, classify.is_symlink(F.col("k")), k=0o120777 << 16) is True
    assert [one(spark, classify.compression_name(F.col("k")), k=v) for v in (0, 8, 99)] == ["STORED", "DEFLATED", "UNKNOWN_99"]
    strata = {"a": "x", "b": "y"}
    assert one(spark, classify.stratum(F.col("k"), F.lit("f"), strata), k="b") == "y"
    assert one(spark, classify.stratum(F.col("k"), F.lit("held"), strata, ("held",)), k="b") is None
    with pytest.raises(Exception, match="no stratum"):
        one(spark, classify.stratum(F.col("k"), F.lit("f"), strata), k="c")
    got = one(spark, classify.rights(F.col("k"), ((("p",), {"tier": "OPEN", "ok": True}),), {"tier": "?", "ok": False}), k="q")
    assert got.asDict() == {"tier": "?", "ok": False}


def test_locator(spark):
    parse = lambda v: tuple(one(spark, classify.locator(F.col("k")), k=v))
    assert parse("/a/b.wav") == ("file", "/a/b.wav", None, None)
    assert parse("zip:///x.zip!/a!/b") == ("zip", "/x.zip", "a!/b", None)
    assert parse("parquet:///p.parquet#row=7") == ("parquet", "/p.parquet", None, 7)
    for broken in ("zip://x", "parquet:///p#row=-1"):
        with pytest.raises(Exception, match="broken locator"):
            parse(broken)


def test_segments(spark):
    starts = one(spark, numbers.segment_starts(F.col("k"), 8 * 16000, 8), k=60 * 16000)
    assert len(starts) == 8 and starts[0] == 0 and starts[-1] == 52 * 16000
    assert one(spark, numbers.segment_starts(F.col("k"), 10, 8), k=10) == [0]
    assert one(spark, numbers.segment_starts(F.col("k"), 10, 8), k=11) == [0, 1]
    assert [one(spark, numbers.segment_count(F.col("k")), k=v) for v in (0.0, 8.0, 8.1, 100.0)] == [1, 1, 2, 8]


def test_finite(spark):
    assert [one(spark, numbers.finite(F.col("k").cast("double")), k=v) for v in (1.0, float("nan"), float("inf"), float("-inf"), None)] == [True, False, False, False, False]


def test_decoder_report(spark):
    said = "Input #0\n  Duration: 00:00:30.02, start: 0.025, bitrate: 256 kb/s\n  Stream #0:0: Audio: mp3 (mp3float), 44100 Hz, stereo, fltp, 256 kb/s\n"
    assert tuple(one(spark, text.decoder_report(F.col("k")), k=said)) == (30.02, 256, "mp3", 44100, "stereo", 2, 256)
    assert tuple(one(spark, text.decoder_report(F.col("k")), k="nothing")) == (None,) * 7
