"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vetra.llm import jaccard


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    """Of (doc_id, text), the places of those that stay; no ids repeat."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * shared >= 4 * both:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return sorted(min(rows[k][0] for k in g) for g in groups.values())


def made(seed):
    """Copies with few or many changed words, chains of them, a line and a passage that all share, and short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    common = " ".join(word() for _ in range(40))
    out = []
    for _ in range(14):
        base = [word() for _ in range(r.choice((8, 30, 120)))]
        for _ in range(r.randrange(1, 8)):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text) + r.choice(("", " " + common, " " + common)))
            base = text if r.random() < 0.5 else base
    out += [common + " " + word() for _ in range(12)] + ["a b", "A  b", "", " ", None, "one"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, sf, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()) == brute_kept(rows)


def test_near_copies_on_sf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_prefixes_meet():
    """Whatever counts the shingles have, two sets of similarity 0.8 share one of their prefixes."""
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 10 :], rng.integers(0, 1 << 60, len(a) // 10).astype(np.uint64)]))
        count = {x: rng.integers(1, 5) for x in np.union1d(a, b).tolist()}
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(*(jaccard.prefix(x, np.array([count[v] for v in x.tolist()])) for x in (a, b))))


def families(count, size, words=400, changed=10):
    """Variants of texts that are near the text, and not near each other."""
    r = random.Random(count * size)
    out = []
    for f in range(count):
        base = [f"f{f}w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for k in r.sample(range(words), changed):
                text[k] = f"c{r.randrange(10**9)}"
            out.append(" ".join(text))
    return list(enumerate(out))


@pytest.mark.parametrize(("count", "size"), [(20, 30), (1, 100), (1, 400)])
def test_families_meet_few_times(spark, monkeypatch, count, size):
    """The pairs compared grow with the texts, not with the square of a family."""
    compared = []
    similar = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda docs, own, pairs: compared.append(pairs.distinct().count()) or similar(docs, own, pairs))
    gone, again = jaccard.redundant(spark.createDataFrame(families(count, size), "doc_id long, text string"))
    assert gone.count() == again.count() == 0
    assert sum(compared) <= 10 * count * size


def test_near_odd(spark, sf, nothing):
    assert corpus_pipeline.near_dedup_stage(spark, nothing.select("doc_id", "text"), sf).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (3, "a B c"), (None, "x y"), (4, "z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()), key=repr) == [(3, "a B c"), (4, "z"), (None, "x y")]


def test_fingerprints_link_first(spark, sf, monkeypatch):
    """Rows whose SimHash fingerprints differ in 3 bits or fewer are compared, by links that connect them; what isn't similar enough stays."""
    r = random.Random(4)
    rows = []
    for _ in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(600)]
        rows += [" ".join(base), " ".join([*base[:300], "other", *base[301:]])]
    rows += [" ".join(f"p{k}" for k in range(12)), " ".join(f"p{k}" for k in range(11))]
    prints = [int(p) for p in map(jaccard.simhash.fingerprint, (t.encode() for t in rows))]
    near = {(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 3}
    assert len(near) > 20
    heads = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "row long, fp long")
    got = {(x.a, x.b) for x in jaccard.by_fingerprints(heads).collect()}
    assert got == near  # pairs alone, so that links enough are all links
    seen = []
    similar = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda docs, own, pairs: seen.append(pairs.count()) or similar(docs, own, pairs))
    monkeypatch.setattr(jaccard, "by_fingerprints", lambda heads: seen.append(True) or heads.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()) == brute_kept(list(enumerate(rows)))
    without_prints = seen[1]
    monkeypatch.undo()
    seen.clear()
    monkeypatch.setattr(jaccard, "similar", lambda docs, own, pairs: seen.append(pairs.count()) or similar(docs, own, pairs))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()) == brute_kept(list(enumerate(rows)))
    assert seen[0] == without_prints + len(near)  # they are compared by all their shingles
