import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vetra.llm import packing as p
from vetra.llm.tokens import byte_bpe, byte_decode


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_fast_ids_are_the_tokenizers(exact):
    r = random.Random(1)
    texts = ["", " ", "a", "  lead", "tail  ", "\n\n\t x", "it's we'LL I'd", "naïve Straße 漢字 😀", "1234567 89", "<|endoftext|> x<|endoftext|>", "\x00\x7f\x85\u2028", "a" * 3000, "?!" * 500, "\u00a0x\u3000y"]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0x2FFF), 10, 32))) for _ in range(300)) for _ in range(60)]
    encode, decode = byte_bpe(), byte_decode()
    for t in texts:
        ids = encode(t)
        assert ids.tolist() == exact.encode(t, add_special_tokens=False).ids
        if "<|endoftext|>" not in t:
            assert decode(ids) == t


def test_fast_ids_of_all_documents(spark, exact):
    """Every text of the next table, and long ones without a break."""
    r = random.Random(2)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().collect()]
    texts += ["".join(r.choice(own) for _ in range(4_000)) for own in ("ab", "abcdefghijklmnopqrstuvwxyz", "漢字仮名", "0123456789", "=-_*", "aé\u0301\u200d😀")]
    encode = byte_bpe()
    for t, own in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t).tolist() == own.ids


@pytest.mark.parametrize(("size", "limit"), [(16, 3), (100, 10), (2048, 64)])
def test_best_fit(size, limit):
    r = random.Random(size)
    bins, fill, open_bins = p.BestFit(size, limit), {}, set()
    for _ in range(3000):
        n = r.randrange(1, size + 1)
        fits = [b for b in open_bins if size - fill[b] >= n]
        number, at = bins.place(n)
        if fits:
            assert size - fill[number] == min(size - fill[b] for b in fits)
        elif len(open_bins) >= limit:
            gone = max(open_bins, key=lambda b: fill[b])
            open_bins -= {b for b in open_bins if fill[b] == fill[gone]} if [fill[b] for b in open_bins].count(fill[gone]) == 1 else set()
        assert at == fill.get(number, 0)
        fill[number] = at + n
        assert fill[number] <= size
        open_bins = {b for b in fill if fill[b] < size and any(b in own for own in bins.bins)}
        assert len(open_bins) <= limit


def check(rows, texts, exact, size=2048):
    """rows: pieces; texts: of each doc_id."""
    ids = {d: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for d, own in by.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            part = ids[d][at : at + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert k == 0 or r.length == size
            at += r.length
        assert at == len(ids[d]) and (len(own) == 1 or at > size)
    assert set(by) == set(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(bins), -(-sum(map(len, ids.values())) // size)


def test_sf(spark, sf, exact):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made, least = check(p.query(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()}, exact)
    assert made <= least * 1.02 + 1


def test_odd(spark, odd, nothing, exact):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = p.pack(one, with_ids=True).collect()
    check(out, {r.doc_id: r.text for r in one.collect()}, exact)
    assert all(len(r.ids) == r.length for r in out)
    assert p.pack(odd).where("piece = 0").count() == odd.count()
    assert p.pack(nothing).count() == 0


def naive(lengths, size, limit):
    """Sequences, as lists of places in lengths, and how many were closed short of full."""
    done, open_bins, closed = [], [], 0
    for at in range(0, len(lengths), p.AHEAD):
        turn = range(at, min(at + p.AHEAD, len(lengths)))
        for k in sorted(turn, key=lambda k: (-lengths[k], k)):
            free = lambda b: size - sum(lengths[x] for x in b)
            fits = [b for b in open_bins if free(b) >= lengths[k]]
            if fits:
                own = min(fits, key=free)
            else:
                if len(open_bins) == limit:
                    gone = min(open_bins, key=free)
                    open_bins.remove(gone)
                    done.append(gone)
                    closed += 1
                open_bins.append(own := [])
            own.append(k)
            if free(own) == 0:
                open_bins.remove(own)
                done.append(own)
    return done + open_bins, closed


def test_bins_close_in_a_whole_run(spark, sf):
    """The whole operator against a naive one: as many sequences, equally full, with a bound that binds; whatever bins of equal free space are taken."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (5, 40):
        out = p.pack(docs, packers=1, open_bins=limit)
        rows = out.orderBy(F.xxhash64(F.lit(1), "doc_id", "piece", "length", "ids_crc32")).collect()
        want, closed = naive([r.length for r in rows], p.LENGTH, limit)
        got = {}
        for r in rows:
            got[r.sequence_id] = got.get(r.sequence_id, 0) + r.length
        assert closed > 5 and sorted(got.values()) == sorted(sum(rows[k].length for k in own) for own in want)


def test_rows_of_one_id_spread(spark):
    """Rows without an id go to all packers, and each has its place."""
    docs = spark.createDataFrame([(None, f"some text {k}") for k in range(400)], "doc_id long, text string")
    out = p.pack(docs, packers=8)
    assert out.count() == 400 and out.select(F.shiftright("sequence_id", 40).alias("packer")).distinct().count() == 8
