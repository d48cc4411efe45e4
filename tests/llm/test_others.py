import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.llm import chat, exchange, license_scan, lm_score, quality, substring_dedup, url_filter, wordhash


# ---- substring deduplication ----


def brute_cut(rows, n=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: math.inf if d is None else d
    for d, w in split:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, math.inf), key(d))
    out = []
    for d, w in split:
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < key(d) for p in range(k, k + n)}
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def cut(df):
    return sorted([tuple(r) for r in substring_dedup.substring_dedup(df).collect()], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_substrings(spark, seed, monkeypatch):
    r = random.Random(seed)
    passages = [" ".join(f"p{r.randrange(50)}" for _ in range(r.randrange(10, 40))) for _ in range(6)]
    rows = []
    for k in range(80):
        t = " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(40)))
        for _ in range(r.randrange(3)):
            t += "\n" + r.choice(passages) + "  " + " ".join(f"w{r.randrange(3)}" for _ in range(r.randrange(20)))
        rows.append((k, t))
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == brute_cut(rows)


def test_substrings_hot_and_cut(spark, monkeypatch):
    """All minimisers hot, and rows longer than a unit."""
    rows = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(300))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = np.unique(np.concatenate([substring_dedup.Runs(*u, np.zeros(0, np.uint64)).minimiser for u in wordhash.units([t.encode().split() for _, t in rows], 12)]))
    monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda docs: every.view(np.int64).tolist())
    assert cut(df) == brute_cut(rows)
    monkeypatch.undo()
    parts = list(wordhash.units([[b"x"] * 120_000, [b"y"] * 5], 12))
    assert sum(p[2] - 12 for u in parts for p in u[1] if p[0] == 0) >= 120_000 - 12 and [p for u in parts for p in u[1]][-1] == (1, 0, 5)


def test_substrings_odd(spark, odd, nothing):
    assert cut(odd) == brute_cut([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert cut(nothing) == []


def test_run_hashes():
    text = wordhash.Text(b"a bc d a bc d")
    h = text.hashes(np.arange(4), np.arange(4) + 2)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


# ---- language model ----


def test_lm_on_sf(spark, sf):
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    part = {d: zlib.crc32(str(d).encode()) % 7 for d in docs}
    count = Counter(w for d, t in docs.items() if part[d] != 2 for w in t)
    total, known = sum(count.values()), len(count)
    held = [0.0, 0.0]
    for r in lm_score.query(spark, sf).collect():
        t = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part[r.doc_id] == 2, len(t), sum(count[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + known + 1)) for w in t))
        assert r.score < 0
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > held[0]


def test_lm_learns_nothing_from_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2
    changed = docs.withColumn("text", F.when(out, F.lit("entirely other words")).otherwise(F.col("text")))
    score = lambda df: {r.doc_id: (r.base_score, r.score) for r in lm_score.lm_score(df).where("not held_out").collect()}
    a, b = score(docs), score(changed)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_lm_probabilities_sum_to_one():
    """Over all words, the end and one unknown word, behind known and unknown contexts and at a text's start."""
    r = np.random.default_rng(4)
    pairs = r.integers(0, 5, (20, 20)) * (r.random((20, 20)) < 0.4)  # a row for each context; words are columns
    pairs[7] = 0
    word = pairs.sum(0) + 1
    known, tokens = len(word), int(word.sum())
    cells = np.stack([np.repeat(np.arange(lm_score.LEVELS + 1), 4), np.tile([2, 9, 20, lm_score.NEVER], lm_score.LEVELS + 1), np.full(4 * lm_score.LEVELS + 4, 30)])
    for tokens, docs in ((tokens, 9), (tokens, 0), (0, 0)):
        weights = lm_score.usable(lm_score.learn(cells, np.ones(cells.shape[1]), known), tokens, docs)
        for context in range(20):
            seen = int(pairs[context].sum())
            own = np.append(pairs[context], 0)
            for lv in {int(lm_score.level(np.array([seen]))[0]), *([lm_score.LEVELS] if seen or not docs else [])}:
                p = lm_score.mixed(weights, np.full(21, lv), own, np.full(21, seen if docs or lv < lm_score.LEVELS else 0), np.append(word, 0) * (tokens > 0), tokens, known)
                assert p.sum() == pytest.approx(1) or (lv == lm_score.LEVELS and not docs and tokens and p.sum() == pytest.approx(1))


def brute_lm(rows):
    """(doc_id, score) by plain counting and expectation-maximisation over tokens, without steps or blocks."""
    docs = [(d, zlib.crc32(str(d).encode()) % 7, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    grams = lambda some: (Counter(w for _, _, t in some for w in t), Counter(p for _, _, t in some for p in zip(["<s>", *t[:-1]], t)))
    bucket = lambda n: min(n.bit_length(), 40)
    train, held = [x for x in docs if x[1] != 2], [x for x in docs if x[1] == 3]
    (word, pair), (left_word, left_pair) = grams(train), grams([x for x in train if x[1] != 3])
    known = len(word)

    def estimates(t, word, pair, n_docs):
        total, out = sum(word.values()), []
        for h, w in zip(["<s>", *t[:-1]], t):
            c = n_docs if h == "<s>" else word[h]
            out.append((41 if h == "<s>" else bucket(c), (pair[h, w] / c if c else 0, word[w] / total if total else 0, 1 / (known + 1))))
        return out

    seen = [e for _, _, t in held for e in estimates(t, left_word, left_pair, len(train) - len(held))]
    weights, every = {k: np.full(3, 1 / 3) for k in range(42)}, np.full(3, 1 / 3)
    for _ in range(60):
        by, whole = {k: np.zeros(3) for k in range(42)}, np.zeros(3)
        for k, p in seen:
            s = weights[k] * p
            by[k] += s / s.sum()
            s = every * p
            whole += s / s.sum()
        every = whole / whole.sum()
        for k in by:
            w = by[k] + every + 1e-6
            w[0] *= k > 0
            weights[k] = w / w.sum()
    return {d: sum(math.log10(weights[k] @ np.array(p)) for k, p in estimates(t, word, pair, len(train))) for d, _, t in docs}


def test_lm_score_by_brute_force(spark):
    r = random.Random(8)
    rows = []
    for d in range(150):
        w = ["start"]
        while len(w) < r.randrange(2, 40):
            w.append(f"w{(int(w[-1][1:]) * 3 + r.randrange(3)) % 40}" if w[-1][0] == "w" and r.random() < 0.8 else f"w{r.randrange(60)}")
        rows.append((d, " ".join(w)))
    want = brute_lm(rows)
    for fan in (lm_score.FAN, 2):
        got = {x.doc_id: x.score for x in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), fan=fan).collect()}
        # the weights are learnt from estimates in steps of a quarter of a power of two
        off = [abs(got[d] - want[d]) / abs(want[d]) for d in want]
        assert got.keys() == want.keys() and max(off) < 0.03 and sum(off) / len(off) < 0.003


def test_blocks_share_out_rows_without_an_id(spark):
    """Rows without an id, or with the same one, go to all blocks, and each block to a task of its own; two levels of buckets give the same rows."""
    rows = [(None if k % 3 else 5, f"common passage of more than thirteen words that many of these rows have in common {k} " * 2) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = exchange.in_blocks(df, 12).select("block", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == 12 and len({x.task for x in dealt}) == 12
    assert cut(df) == brute_cut(rows)
    deep = lambda f, **kw: sorted([tuple(x) for x in f(df, **kw).collect()], key=repr)
    assert deep(substring_dedup.substring_dedup, fan=2) == cut(df)
    a, b = deep(lm_score.lm_score), deep(lm_score.lm_score, fan=3)
    assert len(a) == 240 and a == b


def test_boxes():
    entries = [(3, b"abc"), (0, b""), (7, b"\0" * 9)]
    assert list(exchange.unboxed(exchange.boxed(entries))) == entries and list(exchange.unboxed(exchange.boxed([]))) == []


def test_weights_find_the_better_estimate():
    n = np.array([100, 100])
    cells = np.stack([[3, 3], [4, lm_score.NEVER], [40, 20]])
    w = lm_score.learn(cells, n, 1000)
    assert w.sum(1) == pytest.approx(np.ones(len(w))) and (w[1:] > 0).all() and w[0, 0] == 0 and w[3, 0] > w[3, 2]


def test_lm_odd(spark, odd, nothing):
    out = lm_score.lm_score(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert lm_score.lm_score(nothing).count() == 0
    lone = lm_score.lm_score(odd.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2)).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in lone)


# ---- chat ----


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\<s>", "<s></s>[INST]<<SYS>>", "<|turn|><|text|><|end|>", "[\\INST]", "a\\/s", "\\n\n"])
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_chat(spark):
    turns = [(1, 1, "assistant", "</s> hi\n"), (1, 0, "user", "<|text|>\\ é"), (1, 2, "assistant", "再见"), (2, None, None, None), (None, 0, "user", "x"), (2, 5, "assistant", ""), (2, 5, "assistant", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, ids int")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = "user\n<|text|>\\ é\nassistant\n</s> hi\n\nassistant\n再见\n"
    assert (got[1].n_turns, got[1].turns_sha256) == (3, hashlib.sha256(want.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (len("</s> hi\n再见"), hashlib.sha256("</s> hi\n再见".encode()).hexdigest())
    assert got[2].n_turns == 3 and got[2].loss_chars == 0 and got[None].n_turns == 1
    for r in formatted.collect():
        assert len(r.ids) == len(r.loss_mask) and got[r.conv_id].formatted_chars == len(r.formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- URLs ----


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:k]), rest[k:]
        k = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:k]
    best = None
    for r, h, p, act in (("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best[0])):
            best = (r, act)
    return host, path, best


URLS = [None, "", "nothing", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://example.net/en/1", "http://m.example.net/en", "http://m.EXAMPLE.net/en/", "x://example.com/de/a?b", "http://example.com/DE/a", "http://a.org/fr/", "http://spam-farm.org/fr/x", "http://www.spam-farm.org/de", "http://b.cheap-pills.com", "http://a.b?x=/://c.net/", "://net/", "http://http://a.net/", "http://é.net/é", "http://a.com\n/x", "http://a.net:80/x", "http://u@a.net/"]


def test_urls(spark):
    rows = [(k, u, "h", "r") for k, u in enumerate(URLS)] + [(5, URLS[5], "h", "r")]
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, best = judge(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        if best:
            assert (r.rule, r.verdict, r["rank"]) == (*best, 1)
        else:
            spam = any(s in host for s in ("spam-farm", "cheap-pills"))
            assert r.verdict == ("block" if spam else "allow")
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_run_only_where_their_token_is(spark):
    pages = spark.createDataFrame([(1, "http://a.com/casino/x"), (2, "http://a.com/b")], "page_id long, url string").select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit("a.com/casino/x").alias("place"))
    index = {r.rule: r.token for r in url_filter.index(pages, url_filter.PATTERN_RULES).collect()}
    assert index["casino"] == "casino" and index["link-farm"] == "" and index["spam-farm"] in ("spam", "farm")


# ---- licences ----


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("x.\nReleased under the MIT License.\ny", ["MIT"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3"]), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["Apache-2.0"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", []),
        ("MIT licences are nice", []), (None, []), ("", []), ("Released under the MIT License. Released under the MIT License.", ["MIT"]),
    ],
)
def test_license(spark, text, want):
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == want


def brute_rules(ids):
    out, rest, at = [], [], 0
    while at < len(ids):
        for name, run in license_scan.RULES:
            if tuple(ids[at : at + len(run)]) == run:
                out += [name] if name not in out else []
                at += len(run)
                break
        else:
            rest.append(ids[at])
            at += 1
    return out, rest


def test_license_rules_by_brute_force(spark):
    r = random.Random(5)
    known = list(license_scan.SENTENCES.items())
    rows = []
    for k in range(60):
        own = [r.choice(known) for _ in range(r.randrange(6))]
        said = [s.replace("V", "1.0").capitalize() if r.random() < 0.5 else s.replace("V", "1.0").upper() for s, _ in own]
        rows.append((k, "Some text here.\n" + r.choice(("\n", ".\n", "\n\n")).join(said), [i for _, i in own]))
    out = {x.doc_id: x for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, sentence_ids array<string>")).collect()}
    for k, _, ids in rows:
        names, rest = brute_rules(ids)
        assert out[k].sentence_ids == ids and out[k].unmatched == rest
        assert [n.replace("-1.0", "-V") for n in out[k].licenses] == names


def test_license_odd(spark, odd, nothing):
    assert license_scan.license_scan(odd).count() == odd.count()
    assert license_scan.license_scan(nothing).count() == 0


# ---- quality ----


def synthetic(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        g = r.choice((0, 1, 2, 2, 2))
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 120))]
        if g == 0:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(("nasty", "vile", "awful"))
        if g == 1:
            w = [x + "%%%" if r.random() < 0.6 else x for x in w]
        rows.append((k, " ".join(w), g))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_quality_on_held_out(spark):
    train, test = synthetic(spark, 1500, 1), synthetic(spark, 400, 2)
    model = quality.fit(train, train.select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = quality.grade(test, model).join(test.select("doc_id", "grade"), "doc_id")
    kept = {r.grade: r.k for r in out.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0] < 0.1 and kept[1] < 0.1 and kept[2] > 0.95
    means = {r.grade: r.e for r in out.groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()}
    assert means[0] < means[1] < means[2]
    assert out.where("p_above_1 > p_above_0").count() == 0


def test_quality_fit_is_repeatable_and_bounded(spark):
    train = synthetic(spark, 300, 3)
    grades = train.select("doc_id", "grade")
    a, b = (quality.fit(df, grades, 100) for df in (train, train.repartition(7)))
    assert np.array_equal(a.index, b.index) and np.allclose(a.weight, b.weight)


def test_quality_odd(spark, odd, nothing):
    model = quality.fit(odd, spark.createDataFrame([(4, 2), (5, 0), (99, 1), (None, 1), (10, None)], "doc_id long, grade int"))
    assert quality.grade(odd, model).count() == odd.count()
    assert quality.grade(nothing, model).count() == 0
    empty = quality.fit(nothing, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.grade(odd, empty).count() == odd.count()
