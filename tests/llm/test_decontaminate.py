import random
import re

from pyspark.sql import functions as F

from vetra.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(d.UPPER, d.LOWER)))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, own in items:
            iw = words(own)
            n = min(len(iw), 13)
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    r = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted([(x.doc_id, x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in r.collect()], key=repr)


def cases(seed):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(6)] + ["É", "é", "Σ", "ΟΔΟΣ", "οδος", "K", "K", "İ", "don't", "x-y"]
    say = lambda n: " ".join(r.choice(pool) if r.random() < 0.5 else f"u{r.randrange(300)}" for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((1, 3, 6, 7, 12, 13, 14, 20, 40, 25, 30))] + [(20, ""), (21, None), (22, "!!")]
    items += [(23, items[8][1]), (24, items[8][1].upper())]
    docs = []
    for k in range(60):
        t = say(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            w = (items[r.randrange(11)][1] or "").split()
            a = r.randrange(max(1, len(w) - 11))
            t += r.choice((" ", ", ", "\n")) + " ".join(w[a : a + r.randrange(10, 30)]) + " " + say(r.randrange(4))
        docs.append((k, t))
    return docs, items


def test_short_items_and_windows(spark):
    for seed in range(3):
        docs, items = cases(seed)
        assert got(spark, docs, items) == brute(docs, items)


def test_long_items_only(spark):
    docs, items = cases(7)
    items = [i for i in items if len(words(i[1])) >= 13]
    assert got(spark, docs, items) == brute(docs, items)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = cases(9)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert got(spark, docs, items) == brute(docs, items)


def test_every_shared_window_has_a_shared_fingerprint(spark):
    r = random.Random(3)
    text = [f"v{r.randrange(9)}" for _ in range(400)]
    df = spark.createDataFrame([(text,)] + [(text[k : k + 13],) for k in range(388)], "words array<string>")
    fps = [{v >> d.PLACE_BITS for v in x[0]} for x in df.select(d.winnowed(F.col("words"), 13)).collect()]
    assert all(f & fps[0] for f in fps[1:])


def test_odd_input(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one TWO three"), (2, None), (None, "one two three"), (3, " ".join(f"word{k}" for k in range(50)))], "item_id long, text string").withColumn("words", F.lit(1))
    out = d.decontaminate(odd, items)
    assert out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].n_hit == 3 and list(by[4]["items"]) == ["1"] and by[4].contaminated
    assert by[1].n_words == by[2].n_words == by[13].n_words == 0 and not by[1].contaminated
    assert by[5].n_hit > 0 and list(by[5]["items"]) == ["3"]
    rows = lambda df: [tuple(r) for r in df.collect()]
    got = sorted([(x.doc_id, x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in out.collect()], key=repr)
    assert got == brute(rows(odd.select("doc_id", "text")), [r for r in rows(items.select("item_id", "text")) if r[0] is not None] + [("", "none")])
    assert d.decontaminate(nothing, items).count() == 0
    assert d.decontaminate(odd, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_main_path_is_native(spark, sf):
    df = d.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_of_one_id_and_long_texts(spark):
    """Each row has its own hits; windows at the ends of a text of over 100,000 words, and many in it."""
    item = " ".join(f"q{k}" for k in range(30))
    text = item + " " + " ".join(f"w{k % 5000}" for k in range(60_000)) + " " + item.upper() + " " + " ".join(f"v{k % 700}" for k in range(60_000)) + " " + item
    rows = [(1, text), (1, "other words"), (None, item), (None, "no words"), (1, text)]
    assert got(spark, rows, [(1, item), (2, " ".join(f"v{k}" for k in range(40)))]) == brute(rows, [(1, item), (2, " ".join(f"v{k}" for k in range(40)))])


def test_a_common_phrase_makes_no_pairs(spark, monkeypatch):
    """An ordinary phrase in all items and documents: what meets stays within a few rows a document, with no hit, and the true hits are found."""
    r = random.Random(11)
    phrase = "which of the following statements is the most true"
    say = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    docs = [(k, f"{say(20)} {phrase} {say(20)}") for k in range(400)]
    items = [(k, f"{say(15)} {phrase} {say(15)}") for k in range(400)]
    docs.append((400, items[7][1]))
    rows = {}
    real = d.stored
    monkeypatch.setattr(d, "stored", lambda df, name: rows.setdefault(name, real(df, name)))
    out = got(spark, docs, items)
    assert [x for x in out if x[2]] == [(400, 39, 39, ["7"], True)]
    assert rows["bench-hits"].count() == 27
    tried, places = rows["bench-places"].agg(F.count("*"), F.sum(F.size("at"))).first()
    assert 50 < tried <= len(docs) and places <= 2 * tried + 20  # each with 8 windows at most, whatever items have the phrase
