import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from vetra.llm import suffix_dedup as s
from vetra.llm.exchange import boxed
from vetra.llm.suffix_array import Groups, suffix_array
from vetra.llm.tally import replier


def by_comparison(text):
    data = bytes(text)
    return sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    r = random.Random(letters)
    for size in [*range(30), 100, 400, 1500]:
        own = [r.randint(1, letters) for _ in range(size)]
        for text in (own + [0], own[:20] * 15 + [0], own + own + [0]):
            assert suffix_array(np.array(text)).tolist() == by_comparison(text)


def test_groups_are_longest_lyndon_prefixes():
    r = random.Random(4)
    for _ in range(50):
        text = [r.randint(1, 3) for _ in range(60)] + [0]
        order = suffix_array(np.array(text))
        rank = {int(x): k for k, x in enumerate(order)}
        groups = Groups(np.array(text))
        for start, own in groups.members.items():
            for i in own:
                # the longest Lyndon prefix ends before the next smaller suffix
                assert groups.length[start] == next((j for j in range(i + 1, len(text)) if rank[j] < rank[i]), len(text)) - i
                assert groups.of[i] == start


def test_a_windows_anchor_follows_from_its_bytes():
    r = random.Random(5)
    data = bytes(r.choice(b"abcd ") for _ in range(5000))
    seen = {}
    for at in (0, 17, 1000):
        part, first, size, anchor = s.anchors([data[at:]])
        assert size.sum() == len(data) - at - s.WINDOW + 1
        for f, n, a in zip(first, size, anchor, strict=True):
            for k in range(f, f + n):
                assert seen.setdefault(at + k, a) == a
    part, first, size, anchor = s.anchors([data[:300], b"", data[300:320], data[320:1320], data[1320:1360]])
    assert size[part == 0].sum() == 251 and size[part == 3].sum() == 951 and set(part.tolist()) == {0, 3}
    for p, f, n, a in zip(part, first, size, anchor, strict=True):
        assert all(seen[(0, 0, 0, 320)[p] + k] == a for k in range(f, f + n))


def brute(rows):
    """By each window's least document."""
    own = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in own:
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], LAST), d)
    out = []
    for (d, _), (at, b) in zip(rows, own, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < at:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


LAST = 1 << 62


def found(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()], key=repr)


def passages(seed, docs=60):
    """Documents of passages that they share, shifted, cut within characters, and repeated within one document."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 9)))
    shared = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)] + ["x" * 300, "ab" * 200]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(r.randint(0, 6)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 2)
            text += p[a : r.randint(a, len(p))] + (" " + word()) * r.randint(0, 4)
        rows.append((r.choice([None, *range(40)]), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = passages(seed)
    assert found(s.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_anchors_and_two_levels(spark, monkeypatch):
    """With few rows to an anchor, small lots and few rows to a block's box, the same result."""
    monkeypatch.setattr(s, "BLOCK_BYTES", 2_000)
    rows = passages(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(s.suffix_dedup(docs, fan=3, hot=3, lot=500)) == brute(rows)


def test_equal_windows():
    strings = [b"a" * 60, b"b" + b"a" * 55, b"abc" * 20, b"cab" * 20]
    by = {}
    string, offset, group = s.equal_windows(strings)
    for k, o, g in zip(string.tolist(), offset.tolist(), group.tolist(), strict=True):
        assert by.setdefault(g, strings[k][o : o + 50]) == strings[k][o : o + 50]
    assert len(set(by.values())) == len(by)
    windows = [x[o : o + 50] for x in strings for o in range(len(x) - 49)]
    assert sorted(strings[k][o : o + 50] for k, o in zip(string, offset, strict=True)) == sorted(w for w in windows if windows.count(w) > 1)
    assert len(s.equal_windows([b"a" * 50, b"b" * 50])[0]) == 0


def test_odd_documents(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(s.suffix_dedup(odd)) == brute(rows)
    assert s.suffix_dedup(nothing).count() == 0
    assert s.suffix_dedup(odd).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]


def boxes(entries):
    return pa.table([pa.array([boxed(entries)], pa.binary())], names=["data"])


def test_copies_in_a_block_are_no_hot_strings(monkeypatch):
    """An anchor's strings count, not its rows: 40 copies travel as whole runs, once; 40 texts around one phrase travel window by window. Neither anchors nor strings are sought again for the cut."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(200))
    copy, phrase = word(), word()[:60]
    rows = [(k, copy) for k in range(40)] + [(40 + k, word() + phrase + word()) for k in range(40)]
    table = pa.table([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string()), pa.array([0] * len(rows), pa.int32())], names=["doc_id", "text", "block"])
    (_, asked), = s._ask(1, 10)(table)
    said = [(0, x) for _, x in replier(s._state(10))(0, [(0, asked)])]
    strings = s.Strings(table, said, 1).strings
    assert sum(len(x) == s.WINDOW for x in strings if x.decode() not in copy) > 40 and phrase[:50].encode() in strings
    assert sum(len(x) > s.WINDOW for x in strings) > 5 and sum(len(x) for x in strings if x.decode() in copy) < 2_000
    told = [(0, x) for _, x in s._meet(s.LOT)(0, [(0, x) for _, x in s._tell(1)(table, boxes(said))])]
    monkeypatch.delattr(s, "_anchored")
    out = s._cut()(table, boxes(told))
    want = {d: (n, gone) for d, n, gone, *_ in brute(rows)}
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"]) for x in out.to_pylist()} == want


def test_a_runs_hash_covers_all_its_bytes():
    r = random.Random(9)
    data = bytearray(r.choice(b"abcdefgh") for _ in range(400))
    *_, first, size, _, string = s._anchored([bytes(data)])
    for k in r.sample(range(len(data)), 60):
        other = bytearray(data)
        other[k] ^= 1
        _, first2, size2, _, string2 = s._anchored([bytes(other)])
        mine = {(f, n): h for f, n, h in zip(first.tolist(), size.tolist(), string.tolist(), strict=True)}
        for f, n, h in zip(first2.tolist(), size2.tolist(), string2.tolist(), strict=True):
            if (f, n) in mine:
                assert (mine[f, n] == h) == (not f <= k < f + n + s.WINDOW - 1)
