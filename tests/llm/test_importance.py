import hashlib
import math
import random
import re
import zlib

import pytest

from vetra.llm import importance as m

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    return len(words), [*words, *map(" ".join, zip(words, words[1:]))]


def brute(rows, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for to, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for g in features(text)[1]:
                to[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + 10000) / ((s[k] + 1) * (sum(t) + 10000)))) for k in range(10000)]
    out = []
    for doc, text in rows:
        n, own = features(text)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted([r for r in out if r[1] >= 20], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = 25 * len(able) // 100
    return out, [(r[4], r[0]) for r in able[:k]]


def check(df, rows, target):
    got = df.collect()
    want, drawn = brute(rows, target)
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert [(r.score, r.doc_id) for r in sorted([r for r in got if r["rank"]], key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: r.choice(["the", "cat", "Sat", "ÉTÉ", "x1", "42", "on", "mat"]) + r.choice(["", "s", "ed", "1"])
    rows = [(r.choice([k, k // 3]), r.choice([None, ""]) if r.random() < 0.05 else r.choice([" ", ", ", "-"]).join(word() for _ in range(r.randint(0, 60)))) for k in range(120)]
    target = [" ".join(r.choice(["the", "cats", "sat"]) for _ in range(30)) for _ in range(5)] + [None]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, words string, rank int").repartition(5)
    check(m.importance_resample(docs, spark.createDataFrame([(x,) for x in target], "text string")), rows, target)


def test_odd_documents(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(m.importance_resample(odd, odd), rows, [t for _, t in rows])
    check(m.importance_resample(odd, nothing), rows, [])
    assert m.importance_resample(nothing, odd).count() == 0


def test_ties_are_drawn_by_id(spark):
    rows = [(1, "a b " * 20), *[(None, "a b " * 20)] * 7]
    got = m.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).collect()
    assert len({r.score for r in got if r.doc_id is None}) == 1
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_slices(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "SLICE_BYTES", size)
    texts = ["abc", "", "é" * 200, "x", "y" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(m._slices(batch))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p.column("text").to_pylist()) <= size for p in parts)


@pytest.mark.parametrize("size", [1, 50, 1000])
def test_long_texts_in_pieces(size, monkeypatch):
    """Pairs across pieces count, separators and long words at the edges don't."""
    import duckdb
    import numpy as np

    monkeypatch.setattr(m, "SLICE_BYTES", size)
    r = random.Random(size)
    with duckdb.connect() as db:
        db.create_function("zlib_crc32", m.crc32, ["VARCHAR"], "BIGINT", type="arrow")
        for text in ("", "...", "one", "  A-b  c ", "x" * 3000, "Été " * 300, " ".join("w" * r.randint(1, 90) + r.choice([" ", "--", "Z"]) for _ in range(200)), "  " * 800 + "end", "a" + " " * 2500 + "b"):
            want = np.zeros(m.BUCKETS, np.int64)
            for g in features(text)[1]:
                want[zlib.crc32(g.encode()) % 10000] += 1
            assert (m._long(db, text.encode()) == want).all(), text[:50]
