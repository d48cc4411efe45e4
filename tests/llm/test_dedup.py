import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vetra.llm import common
from vetra.llm import exact_dedup as e
from vetra.llm import simhash as s


def test_combine_equals_whole():
    powers = e._powers()
    data = random.Random(1).randbytes(3 * e.CHUNK + 123)
    parts = [e.chunk_hash(data[k : k + e.CHUNK], powers) for k in range(0, len(data), e.CHUNK)]
    left = parts[0]
    for p in parts[1:]:
        left = e.combine(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = e.combine(p, right)
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4")
    want = []
    for p, b in zip(e.PRIMES, e.BASES, strict=True):
        h = 0
        for w in words.tolist():
            h = (h * b + w) % p
        want.append(h)
    assert left == right == (*want, len(words))


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        own = groups[t or ""]
        keep = max([x for x in own if x is not None], default=None) if len(own) > 1 else d
        out.append((d, keep, len(own), d == keep))
    return sorted(out, key=repr)


def test_exact(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = e.exact_dedup(odd)
    assert sorted([tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept").collect()], key=repr) == brute_exact(rows)
    assert e.exact_dedup(nothing).count() == 0


def test_collision_is_parted(spark, monkeypatch):
    """All texts of one length share a fingerprint here; the comparison must tell them apart."""
    real = e.fingerprints
    monkeypatch.setattr(e, "fingerprints", lambda docs: real(docs).withColumn("fp", F.lit(1).cast("long")))
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "x"), (5, None), (6, ""), (7, "y" * 70_000), (8, "y" * 69_999 + "z"), (9, "y" * 70_000)]
    out = e.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept").collect()], key=repr) == brute_exact(rows)


def brute_print(text):
    table = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += table.get(c, c)
    words += [now] if now else []
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A B C", "a b c d", "É é\u00a0x y\u2003z w", "x " * 700, " ".join(f"t{k % 37}" for k in range(2000))])
def test_fingerprint(text):
    assert s.fingerprint((text or "").encode()) == brute_print(text)


def test_fingerprint_is_sparks_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == s.fingerprint(b"A b\nC")


def brute_components(prints, distance=3):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def planted(seed, n, dense):
    r = random.Random(seed)
    out = {}
    centres = [r.getrandbits(64) for _ in range(5)]
    for k in range(n):
        x = r.choice(centres) if k % 2 else r.getrandbits(64)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64 if not dense else 12)
        out[k] = x
    return out


@pytest.mark.parametrize(("seed", "dense", "bucket"), [(1, False, 512), (2, True, 512), (3, True, 16), (4, False, 8)])
def test_links_by_brute_force(spark, monkeypatch, seed, dense, bucket):
    monkeypatch.setattr(s, "BUCKET", bucket)
    monkeypatch.setattr(s, "FREE_BITS", bucket.bit_length() - 1)
    prints = planted(seed, 260, dense)
    monkeypatch.setattr(s, "fingerprints", lambda docs: spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()], "doc_id long, fp long"))
    out = s.simhash_dedup(spark.createDataFrame([(k, "") for k in prints], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == brute_components(prints)


@pytest.mark.parametrize("n", [1e3, 1e6, 1e9, 1e12])
def test_masks_cover_every_link(n):
    """Whatever parts and thresholds the costs lead to, any three differing bits leave one mask untouched."""
    rng = np.random.default_rng(int(n) % 97)
    bits = rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)
    bits[:, 1] = bits[:, 0]
    together = (bits.T.astype(float) @ bits) * (n / 500)
    masks = s.allocate(n, together, 3)
    for _ in range(3000):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & flip for m in masks)
    for m in masks[:3]:
        for _ in range(300):
            flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not f & ~m & flip for f in s.finer(m, 3)) or flip & m


def test_simhash_odd(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = s.simhash_dedup(odd)
    assert out.count() == len(rows)
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in out.collect()}
    prints = {k: brute_print(t) for k, (_, t) in enumerate(rows)}
    for k, root in brute_components(prints).items():
        own = [rows[i][0] for i, x in brute_components(prints).items() if x == root and rows[i][0] is not None]
        assert got[rows[k][0], prints[k]] == min(own, default=None)
    assert s.simhash_dedup(nothing).count() == 0
    assert s.simhash_dedup(odd.where("doc_id = 4")).first().component_id == 4


def test_sf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    out = s.query(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints)


def test_bitmap_of_ids_passes_every_member_and_few_others(spark):
    docs = spark.range(-5, 2000).selectExpr("id as doc_id", "'t' as text").union(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    members = [-3, 0, 63, 64, 65, 1999]
    own = spark.createDataFrame([(k,) for k in [*members, *members]], "doc_id long")
    passed = [r[0] for r in common.perhaps(docs, ["doc_id"], own).collect()]
    rest = [r[0] for r in common.perhaps(docs, ["doc_id"], own, others=True).collect()]
    assert set(members) <= set(passed) and len(passed) < 20 and not set(passed) & set(rest) and len(passed) + len(rest) == docs.count()
    nothing = spark.createDataFrame([], "doc_id long")
    assert common.perhaps(docs, ["doc_id"], nothing).isEmpty() and common.perhaps(docs, ["doc_id"], nothing, others=True).count() == docs.count()
