"""Spelling variants of words: pairs within one edit, by an even-partition pigeonhole join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, texts
from .importance import CRC_SQL, CRC_TABLE

#: Runs of letters, as they are after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: A run of a document loses a letter if this divides its hash.
DIVISOR = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs so many times as often as its variant, at least.
RATIO = 2
#: A segment that more words share than this is parted again.
BUCKET = 256
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return found

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            own = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode()))  # of bytes: A-Z alone
            name = f"{'' if doc is None else doc}:"
            for run, n in own.items():
                h = zlib.crc32((name + run).encode())
                if h % DIVISOR == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= LEAST_LENGTH:
                    seen[run] += n
            if len(seen) > HELD:
                yield out()
    yield out()


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of LEAST_LENGTH letters and LEAST_COUNT occurrences at least. Tasks count before anything is shuffled."""
    return docs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _rest(a: str, b: str) -> Column:
    """What a word has outside of letters a to b of `part` letters: its beginning, and its end counted from behind."""
    return F.concat_ws("|", "part", a, F.expr(f"substring(word, 1, {a})"), F.expr(f"right(word, part - {b})"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row's letters a to b in two even segments; `key` is all that lies outside of one, which must be intact if the edit is in it."""
    middle = F.expr("a + (b - a) div 2")
    parts = F.explode(F.array(F.struct(F.col("a").alias("x"), middle.alias("y")), F.struct(middle.alias("x"), F.col("b").alias("y")))).alias("s")
    return rows.select("probe", "word", "part", parts).select("probe", "word", "part", F.col("s.x").alias("a"), F.col("s.y").alias("b")).withColumn("key", _rest("a", "b"))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): all pairs of distinct words that differ by one inserted, deleted or replaced letter, each once.

    Each word is indexed by two segments, of half its length each; one edit leaves one of them intact. Each word probes, for words as long as itself and
    for those one shorter, its beginning and its end: where the other's segments can be if they are intact. Pairs that meet are verified where
    they meet. Where more words than `bucket` share a segment, what is outside of it is halved in turn, and so on down to one letter, so the pairs tried grow
    with the words and not with the square of those that share a beginning; it leaves no pair out.
    """
    long = F.char_length("word")
    rows = words.select("word", long.alias("length")).select("word", "length", F.explode(F.array(F.struct(F.lit(False).alias("probe"), F.col("length").alias("part")), F.struct(F.lit(True).alias("probe"), F.col("length").alias("part")), F.struct(F.lit(True).alias("probe"), (F.col("length") - 1).alias("part")))).alias("s"))
    rows = rows.select("s.probe", "word", "s.part", F.lit(0).alias("a"), F.col("s.part").alias("b"))
    found = None
    while True:
        level = stored(_halved(rows), "segments")
        full = stored(level.where("not probe and b - a > 1").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "full-segments")
        more = not full.isEmpty()
        cool = level.join(full, "key", "left_anti") if more else level
        side = lambda probe, name, own=cool: own.where("probe" if probe else "not probe").select("key", "part", F.col("word").alias(name))
        met = side(False, "x").join(side(True, "y").drop("part"), "key").where("(char_length(y) > part or x < y) and levenshtein(x, y, 1) = 1")
        pairs = stored(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found.distinct()
        rows = level.join(full, "key", "left_semi").drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms lead in the end. Each turn doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        moved = stored(now.join(after, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Words and the likelier spellings that they are variants of.

    Returns a row per word of 5 letters and 3 occurrences at least: word, n, n_near (words within one edit), form (the commonest of these, if it is twice as
    common; ties: the first in code-point order), form_n, root (where forms lead in the end; the word itself without a form).

    Words are runs of letters with A-Z lower-cased; of a run whose CRC-32 with its document's id 97 divides, a letter is deleted. A null id is an empty one.
    Null and empty texts have no words; very long texts and words are read whole. Repeated rows count again. An empty table gives no rows. Only
    the two columns are read, so others may have any names.
    """
    words = stored(words_of(texts(docs, id_col, text_col)), "words")
    pairs = near_pairs(words.select("word"), bucket)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min_by(F.struct("b", "near_n"), F.struct(-F.col("near_n"), "b")).alias("best"))
    out = words.join(near, F.col("word") == F.col("a"), "left").withColumn("fits", F.coalesce(F.col("best.near_n") >= RATIO * F.col("n"), F.lit(False)))
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.b")).alias("form"), F.when(F.col("fits"), F.col("best.near_n")).alias("form_n")), "forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
c AS (SELECT run, doc_id || ':' || run AS k, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {CRC_SQL.format("k")} AS h FROM c, crc),
w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
e AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
p AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM (SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS k FROM e) x JOIN (SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS k FROM e) y USING (k) WHERE x.word <> y.word
  UNION SELECT e.word, w.word FROM e JOIN w ON substr(e.word, 1, i - 1) || substr(e.word, i + 1) = w.word
  UNION SELECT w.word, e.word FROM e JOIN w ON substr(e.word, 1, i - 1) || substr(e.word, i + 1) = w.word),
f AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, first(b ORDER BY o.n DESC, encode(b)) AS form, max(o.n) AS form_n FROM p JOIN w o ON o.word = b GROUP BY a),
g AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
s AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT s.word, s.next, g.form FROM s JOIN g ON g.word = s.next)
SELECT g.word, n, n_near, g.form, form_n, root FROM g JOIN s ON g.word = s.word WHERE s.next IS NULL
"""
