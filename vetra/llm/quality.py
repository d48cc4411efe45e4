"""Quality classification by ordinal regression on hashed text."""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, read, stored, texts

#: Grades, worst first: toxic, poor, good.
GRADES = 3
#: Hash values of a feature; the model has a weight for each.
FEATURES = 1 << 22
#: Labelled rows that a model is fitted on, at most: the bound that fitting on the driver has. Rows are chosen by a hash of their id, one for each id.
TRAIN_ROWS = 20_000
#: Steps of a fit, at least; many rows take PASSES passes.
STEPS, PASSES, BATCH, RATE = 1500, 12, 128, 0.1
#: The L1 penalty falls with the root of the rows, as the noise of a slope does.
SPARSE = 0.037
#: A feature of fewer training rows gets no weight, however many rows there are.
LEAST_ROWS = 2
#: A document passes if it is of the best grade with this chance at least. Measured on 5,000 held-out labelled documents after a fit on
#: 14,000: 0.0 % of toxic, 1.5 % of poor and 99.9 % of good ones pass; after a fit on 2,000: 4.4, 1.3 and 99.8 %. (Measured when a row had
#: 2,000 features at most, and a feature a share of 0.0015 of the rows at least; not measured since.)
LEAST_CHANCE = 0.7
#: Words' features are remembered up to so many words for each task.
REMEMBERED = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """P(grade > k) = sigmoid(score - thresholds[k]), with one score for all k; thresholds rise."""

    index: np.ndarray  # features with a weight, sorted
    weight: np.ndarray
    thresholds: np.ndarray


def _hashed(name: str) -> int:
    return xxhash.xxh64_intdigest(name) % FEATURES


class Features:
    """Distinct features of a text: its words, lower-cased, with and without what is not a letter, and a few of its shape."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        if (found := self.known.get(w)) is None:
            parts = _LETTERS.findall(w)
            marks = "".join(sorted(set(_LETTERS.sub("", w))))
            found = (_hashed("w:" + w), *(_hashed("l:" + p) for p in parts), *((_hashed(f"m:{marks}"),) if marks else ()))
            if len(self.known) < REMEMBERED:
                self.known[w] = found
        return found

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        kinds = set(words)
        shape = [f"n:{len(words).bit_length()}"]
        if words:
            shape.append(f"repeated:{10 * (len(words) - len(kinds)) // len(words)}")
            shape.append(f"plain:{10 * sum(w.isalpha() for w in kinds) // len(kinds)}")
            shape.append(f"longest:{max(len(list(g)) for _, g in itertools.groupby(words)).bit_length()}")
        return np.unique(np.fromiter(itertools.chain(map(_hashed, shape), itertools.chain.from_iterable(map(self.word, kinds))), np.int64))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        rows = [features.of(text).astype(np.int32) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("turn"), pa.array(rows, pa.list_(pa.int32()))], ["grade", "turn", "features"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_examples(), with a row's features as the bytes of 32-bit numbers."""
    for batch in _examples(batches):
        rows = [np.asarray(f.values, np.int32).tobytes() for f in batch.column("features")]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("turn"), pa.array(rows, pa.binary())], ["grade", "turn", "features"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(grades: np.ndarray, features: list[np.ndarray]) -> Model:
    """Cumulative-link regression by Adagrad over batches, with an L1 penalty; rows in the given order."""
    cuts, cuts_seen = np.linspace(-1.0, 1.0, GRADES - 1), np.full(GRADES - 1, 1e-6)
    number = np.zeros(FEATURES, np.int32)
    for f in features:  # distinct in a row
        number[f] += 1
    index = np.flatnonzero(number >= LEAST_ROWS).astype(np.int32)
    number.fill(-1)
    number[index] = np.arange(len(index), dtype=np.int32)  # of the features that may get a weight; the only array as long as FEATURES
    w, seen = np.zeros(len(index), np.float32), np.full(len(index), 1e-6, np.float32)
    sparse = SPARSE / max(len(grades), 1) ** 0.5
    for _ in range(max(PASSES, STEPS * BATCH // max(len(grades), 1))) if len(grades) else ():
        for at in range(0, len(grades), BATCH):
            own = features[at : at + BATCH]
            flat = number[np.concatenate(own)]
            used = flat >= 0  # chosen here, so that the features are held once
            flat, row = flat[used], np.repeat(np.arange(len(own)), [len(f) for f in own])[used]
            score = np.bincount(row, w[flat], len(own))
            above = grades[at : at + BATCH, None] > np.arange(GRADES - 1)
            pull = sigmoid(score[:, None] - cuts) - above
            used, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, pull.sum(1)[row], len(used)) / len(own)
            seen[used] += g * g
            rate = RATE / np.sqrt(seen[used])
            moved = w[used] - rate * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * sparse, 0)
            g = -pull.mean(0)
            cuts_seen += g * g
            cuts = np.maximum.accumulate(cuts - RATE * g / np.sqrt(cuts_seen))
    del seen, number
    return Model(index[w != 0].astype(np.int64), w[w != 0], cuts)


def fit(docs: DataFrame, grades: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from graded documents: (doc_id, grade), grades from 0. Of more rows than train_rows, those with the least hashes of their ids are taken.

    Of several grades of an id the least counts, and of several texts the one with the least hash: train_rows rows at most come to the driver,
    each with its distinct features, part by part, and lie in a file there. Null ids and grades are left out; without rows the model has no weights.
    """
    graded = grades.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = graded.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn").limit(train_rows)
    own = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade", "turn").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = stored(own.mapInArrow(_packed, "grade int, turn long, features binary"), "training-rows")
    with tempfile.TemporaryFile() as file:
        found = []
        for r in rows.toLocalIterator():  # one part of the table after the other
            found.append((r.turn, r.grade, len(r.features) // 4))
            file.write(r.features)
        file.flush()
        dropped(rows)
        turn, grade, size = np.array(found, np.int64).reshape(-1, 3).T
        order, ends = np.argsort(turn), np.cumsum(size)
        # the rows' features stay in the file; pages of it that are read can go again
        data = np.asarray(np.memmap(file, np.int32, "r")) if size.sum() else np.zeros(0, np.int32)
        return fit_rows(grade[order], [data[ends[k] - size[k] : ends[k]] for k in order.tolist()])


def scores(model: Model):
    """A function from texts (null: empty) to their scores and tail chances."""
    features, w = Features(), np.zeros(FEATURES, np.float32)
    w[model.index] = model.weight

    def of(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        score = np.array([w[features.of(t or "")].sum(dtype=float) for t in texts_.to_pylist()])
        return score, sigmoid(score[:, None] - model.thresholds)

    return of


def _graded(model: Model):
    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scores(model)
        for batch in batches:
            score, tail = of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(tail.sum(1), pa.float64()), *(pa.array(np.ascontiguousarray(t), pa.float64()) for t in tail.T)], ["doc_id", "score", "expected_grade", *(f"p_above_{k}" for k in range(GRADES - 1))])

    return graded


def grade(docs: DataFrame, model: Model, least_chance: float = LEAST_CHANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score, expected_grade, p_above_0, p_above_1 (tail chances), kept (p_above_1 >= least_chance).

    All features of the whole text count, however long it is. The model, of FEATURES weights at most, goes to every task; nothing is shuffled.

    Null and empty texts have features of shape alone. Repeated rows each give a row. A model that was fitted on no rows gives
    every document the chances that its thresholds say. An empty table gives no rows.
    """
    out = texts(docs, id_col, text_col).mapInArrow(_graded(model), "doc_id long, score double, expected_grade double, " + ", ".join(f"p_above_{k} double" for k in range(GRADES - 1)))
    return out.withColumn("kept", F.col(f"p_above_{GRADES - 2}") >= least_chance)


def good(docs: DataFrame, model: Model, least_chance: float = LEAST_CHANCE, text_col: str = "text") -> DataFrame:
    """The rows of docs that grade() keeps, with all their columns, each judged by its own text as it streams by."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scores(model)
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(text_col))[1][:, -1] >= least_chance, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the labels table: 0 toxic, 1 poor, 2 good; null labels are left out."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grade(docs, fit(docs, grades_of(read(spark, sf_dir, "labels"))))
