import random
import re
import zlib
from collections import Counter

import pytest

from vetra.llm import spelling as s


def count(rows):
    n = Counter()
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows):
    n = count(rows)
    near = {w: [x for x in n if edit(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def rows_of(seed, letters="abé", size=400):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(60)] + [w + w[-1] * k for w in ("seven", "eights") for k in range(3)]
    often = [1 / (k % 20 + 1) ** 2 for k in range(60)] + [4, 0.5, 0.05] * 2
    text = lambda: " ".join(w.title() if r.random() < 0.2 else w for w in r.choices(words, often, k=r.randint(0, 40)))
    return [(r.choice([None, *range(300)]), text()) for _ in range(size)]


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_against_brute_force(spark, bucket):
    """With segments that hold one word at most, three, or all."""
    rows = rows_of(bucket)
    docs = spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n int, word string")
    got = s.spelling_variants(docs, bucket=bucket)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[3] and r[5] != r[3] for r in want)  # a form of a form


def test_all_pairs_within_one_edit(spark):
    """A word and its neighbours at each place, with two-byte and four-byte letters, and twins at which an edit has several places."""
    base = ["aaaaa", "abcde", "ééééé", "aàbàc", "\U0001f600bcde", "mississippi"]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "z" + w[k + 1 :], w[:k] + w[k : k + 1] + w[k:]}
    words = sorted(words)
    want = {(a, b) for a in words for b in words if a < b and edit(a, b)}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for bucket in (1, 5, 256):
        got = [tuple(r) for r in s.near_pairs(table, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_tried_grow_with_the_words(spark):
    """Words that share their first half: what is tried stays near the number of words, not its square."""
    r = random.Random(3)
    words = sorted({"abcdefgh" + "".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1 : k + 2] if edit(a, b)}
    got = {tuple(x) for x in s.near_pairs(table, 64).collect()}
    assert want <= got and all(edit(a, b) for a, b in got)


def test_roots(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(20)]
    got = {tuple(r) for r in s.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {(f"w{k}", "w20") for k in range(20)}


def test_odd_documents(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, s.spelling_variants(odd).collect())) == brute(rows)
    assert s.spelling_variants(nothing).count() == 0
