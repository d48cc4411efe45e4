"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, perhaps, read, sha, small, stored, texts

WINDOW = 13
GRAM = 6
#: What lies between words: ASCII characters but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Low bits of a packed value: the gram's place in its text.
PLACE_BITS = 30
#: Rows of fingerprints, or of windows of at most 13 words, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _folded(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def _shape(window: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window, so that any shared span of `window` words holds a shared fingerprint."""
    gram = min(GRAM, window)
    return gram, window - gram + 1


def winnowed(words: Column, window: int) -> Column:
    """Packed (hash, place) of the grams that are least in some window of grams; of equal ones, the leftmost.

    A hash ignores case beyond A-Z too, so it may match more than the words do; whole windows are compared by their words.
    """
    gram, span = _shape(window)

    def joined(a: Column, step: int, both) -> Column:
        """both(x, y) of all entries and those `step` behind; the last ones, without partner, keep a value that no shared window needs."""
        return let(a, lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), both))

    def doubled(a: Column, width: int, both) -> Column:
        done = 1
        while done < width:
            step = min(done, width - done)
            a, done = joined(a, step, both), done + step
        return a

    grams = doubled(F.transform(words, lambda w: F.xxhash64(F.lower(w), F.lit(window))), gram, lambda x, y: F.xxhash64(x, y))
    packed = F.transform(grams, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long")))
    return F.array_distinct(doubled(packed, span, lambda x, y: F.least(x, y)))


def fingerprints(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """The benchmark's index: (fp, window), the fingerprints of windows of so many words; (id, hash, gist) of the distinct windows, with their words; (id, item_id); the windows' lengths."""
    items = stored(texts(benchmark, item_col, text_col).select(F.col("doc_id").alias("item_id"), _folded(words_of(F.col("text"))).alias("words")).where("size(words) > 0"), "bench")
    own = items.select("item_id", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("window"))
    lengths = sorted(r[0] for r in own.select("window").distinct().collect())  # 13 rows at most
    prints = None
    for n in lengths:
        mine = own.where(F.col("window") == n).select(F.explode(winnowed(F.col("words"), n)).alias("v")).select(F.shiftright("v", PLACE_BITS).alias("fp"), F.lit(n).alias("window"))
        prints = mine if prints is None else prints.unionByName(mine)
    if prints is None:
        prints = benchmark.sparkSession.createDataFrame([], "fp long, window int")
    windows = own.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("window")), lambda i: _gist(F.slice("words", i + 1, F.col("window"))))).alias("gist")).distinct()
    windows = stored(windows.withColumn("hash", F.xxhash64("gist")), "bench-windows")
    distinct = stored(windows.select("hash", "gist").distinct().withColumn("id", F.monotonically_increasing_id()), "bench-distinct")
    return stored(prints.distinct(), "bench-prints"), distinct, windows.join(distinct, ["hash", "gist"]).select("id", "item_id"), lengths


def _gist(words: Column) -> Column:
    """A window's words as one text; words have no spaces."""
    return F.array_join(words, " ")


def places(docs: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, h, at): of each document with a fingerprint of the index, the places of all such, with the length of their windows. h is a hash of its text.

    Only hashes leave the texts here, so a document's words are never repeated for its fingerprints.
    """
    values = F.concat(*[winnowed(F.col("words"), n) for n in lengths])
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words")).select("doc_id", "h", F.explode(values).alias("v"))
    found = found.select("doc_id", "h", F.shiftright("v", PLACE_BITS).alias("fp"), F.col("v").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("p"))
    return found.join(small(prints, BROADCAST_ROWS), "fp").groupBy("doc_id", "h").agg(F.collect_set(F.struct("window", "p")).alias("at"))


def around(words: Column, at: Column) -> Column:
    """(first, window, gist) of the windows around the grams at these places: 8 of 13 words at most for each."""

    def of(x: Column) -> Column:
        reach = x["window"] - F.least(x["window"], F.lit(GRAM))
        low = F.greatest(x["p"] - reach, F.lit(0))
        high = F.least(x["p"], F.size(words) - x["window"])
        part = _folded(F.slice(words, low + 1, x["p"] - low + x["window"]))
        firsts = F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<int>"))
        return let(part, lambda own: F.transform(firsts, lambda s: F.struct(s.alias("first"), x["window"].alias("window"), _gist(F.slice(own, s - low + 1, x["window"])).alias("gist"))))

    return F.flatten(F.transform(at, of))


def _covered(windows: str) -> Column:
    """How many words windows cover; each is packed as 16 * first word + length."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, v: Column) -> Column:
        first, last = F.shiftright(v, 4), F.shiftright(v, 4) + v.bitwiseAND(15)
        return F.struct(F.greatest(seen["end"], last).alias("end"), (seen["n"] + F.greatest(last - F.greatest(seen["end"], first), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(windows), start, add)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Which words of each document lie in a window that a benchmark item has too.

    Returns a row per document: doc_id, text_sha256, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words).

    Winnowing keeps the least 6-gram hash of each 13-word window on both sides, so every window that both share has a
    shared fingerprint. A match is extended to the windows around it, 8 at most, which meet the benchmark's windows by their hashes and words. So
    a phrase that very many items and documents have makes no pairs of them: only windows that are the same meet. Fingerprints and windows of the
    benchmark are broadcast if there are BROADCAST_ROWS at most, else joined by a shuffle. Only documents with a shared fingerprint are read again, each once.

    Null or empty texts have no words, no hit. Items without words never match. Each row is judged by its own text, whatever
    ids are null or repeat; a null item_id is left out of items. Empty tables: no rows, or no hits.
    """
    docs = texts(docs, id_col, text_col)
    prints, windows, owners, lengths = fingerprints(benchmark, item_col)
    counted = docs.select("doc_id", sha().alias("text_sha256"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    if not lengths:
        return counted.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    found = stored(places(docs, prints, lengths), "bench-places")
    own = perhaps(docs.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], found).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"))
    own = own.select("d.doc_id", sha().alias("text_sha256"), words_of(F.col("text")).alias("words"), "at")
    tried = own.select("doc_id", "text_sha256", F.explode(around(F.col("words"), F.col("at"))).alias("x")).select("doc_id", "text_sha256", "x.*").withColumn("hash", F.xxhash64("gist"))
    hits = stored(tried.join(small(windows, BROADCAST_ROWS), ["hash", "gist"]).select("doc_id", "text_sha256", "first", "window", "id").distinct(), "bench-hits")
    key = ["doc_id", "text_sha256"]
    by_doc = hits.groupBy(*key).agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 4).bitwiseOR(F.col("window").cast("long"))).alias("windows")).select(*key, _covered("windows").alias("n_hit"))
    items = hits.select(*key, "id").distinct().join(small(owners, BROADCAST_ROWS), "id").where("item_id is not null").groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = by_doc.alias("a").join(items.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_sha256 = b.text_sha256"), "left").select("a.*", "items")
    out = counted.alias("a").join(both.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_sha256 = b.text_sha256"), "left")
    out = out.select("a.doc_id", "a.text_sha256", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(*key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN bg USING (n, g)),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hp USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
