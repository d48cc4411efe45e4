"""Language-model scores by deleted interpolation of n-gram estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, read, stored, texts
from .exchange import FAN, Entries, answered, exchanged, in_blocks, told
from .wordhash import Text, mix, units

#: Documents by crc32(doc_id as text) mod FOLDS: HELD_OUT's are not learnt from; WEIGHING's counts are deleted for learning the weights.
FOLDS, HELD_OUT, WEIGHING = 7, 2, 3
BLOCK_BYTES = 1 << 24
#: Contexts go by the power of two of their count; more frequent ones than the last are together.
LEVELS = 41
#: Estimates are counted for the weights by quarters of a power of two.
STEPS, NEVER = 4, -1
ROUNDS = 60
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
ONE = np.uint64(1)

BLOCKS = "block int, n long, data binary, words long, train_tokens long, train_docs long, weighing_tokens long, weighing_docs long, histogram binary"


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(a: np.ndarray) -> bytes:
    """Numbers by their bytes' places, which compress better."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Tokens:
    """A block's tokens in document order, as the numbers of the block's distinct n-grams, which are sorted by key.

    Keys are 64-bit hashes; that of a word is odd, that of a pair of words even.
    """

    def __init__(self, table: pa.Table):
        rows = (t.as_py().encode().lower().split() for t in table.column("text"))  # of bytes: A-Z alone, and ASCII white space alone
        found, sizes = [np.zeros(0, np.uint64)], np.zeros(table.num_rows, np.int64)
        for words, parts in units(rows):
            text = Text(b" ".join(words))
            n = np.arange(len(words))
            found.append(text.hashes(n, n) if len(words) else np.zeros(0, np.uint64))
            for k, _, m in parts:
                sizes[k] += m
        words = np.concatenate(found)
        self.sizes = sizes + 1
        self.bounds = np.append(0, np.cumsum(self.sizes))
        word = np.full(self.bounds[-1], END, np.uint64)
        last = np.zeros(len(word), bool)
        last[self.bounds[1:] - 1] = True
        word[~last] = words
        before = np.append(START, word[:-1]) if len(word) else word
        before[self.bounds[:-1]] = START
        pair = mix(before * np.uint64(3) + word)
        self.keys, place = np.unique(np.concatenate([word | ONE, pair & ~ONE]), return_inverse=True)
        self.word, self.pair = place[: len(word)], place[len(word) :]
        self.part = np.asarray(table.column("part"))
        self.token_part = np.repeat(self.part, self.sizes)


def _send(buckets: int):
    def send(table: pa.Table) -> Entries:
        t = Tokens(table)
        # keys are sorted, so each bucket's are a slice
        cuts = np.searchsorted(t.keys, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64))
        train = t.token_part != HELD_OUT
        held = t.token_part == WEIGHING
        count = lambda on: np.bincount(np.concatenate([t.word[on], t.pair[on]]), minlength=len(t.keys))
        counts = (count(train), count(held))
        out = []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t.keys)], strict=True)):
            if a < b:
                steps = np.diff(t.keys[a:b], prepend=np.uint64((k << 64) // buckets))
                out.append((k, _press(_planes(steps.view(np.int64)) + _planes(counts[0][a:b]) + _planes(counts[1][a:b]))))
        return out

    return send


def _count(buckets: int):
    def count(bucket: int, entries: Entries) -> Entries:
        """A bucket's keys of all blocks are counted together; each block gets the counts of its own, in its order. The first one gets the number of known words too."""
        keys, train, held = [], [], []
        for _, data in entries:
            raw = _open(data)
            n = len(raw) // 3
            keys.append(np.cumsum(_unplaned(raw[:n]).view(np.uint64)) + np.uint64((bucket << 64) // buckets))
            train.append(_unplaned(raw[n : 2 * n]))
            held.append(_unplaned(raw[2 * n :]))
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.zeros(len(known), np.int64) for _ in range(2)]
        for to, own in zip(total, (train, held), strict=True):
            np.add.at(to, place, np.concatenate(own))
        words = int(((known & ONE == ONE) & (total[0] > 0)).sum())
        out, at = [], 0
        for (block, _), own in zip(entries, keys, strict=True):
            here = place[at : at + len(own)]
            out.append((block, np.int64(0 if at else words).tobytes() + _press(_planes(total[0][here]) + _planes(total[1][here]))))
            at += len(own)
        return out

    return count


def level(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for none, else one for each power of two."""
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS), NEVER).astype(np.int64)


def _meet(table: pa.Table, counted: pa.Table) -> pa.Table:
    """A block with the counts of its tokens: for each token those of the word and of the word with the one before."""
    entries = told(counted)
    words = sum(int(np.frombuffer(data, np.int64, 1)[0]) for _, data in entries)
    if not table.num_rows:
        return pa.table([pa.array([], f.type) for f in _meet.schema], schema=_meet.schema)
    t = Tokens(table)
    total, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, data in entries:
        raw = _open(data[8:])
        total.append(_unplaned(raw[: len(raw) // 2]))
        held.append(_unplaned(raw[len(raw) // 2 :]))
    total, held = np.concatenate(total), np.concatenate(held)
    train = t.part != HELD_OUT
    on = np.flatnonzero(t.token_part == WEIGHING)
    left = total - held  # the counts without the documents that the weights are learnt on
    first = np.isin(on, t.bounds[:-1])
    context = np.where(first, -1, left[t.word[np.maximum(on - 1, 0)]])  # -1: a text's start, whose count is known later
    cells, n = np.unique(np.stack([context_level(context), _steps(_ratio(left[t.pair[on]], np.maximum(context, 0))), left[t.word[on]], np.where(first, left[t.pair[on]], -1)]), axis=1, return_counts=True) if len(on) else (np.zeros((4, 0), np.int64), np.zeros(0, np.int64))
    own = pa.array(table.column("doc_id").to_pylist(), pa.int64())
    data = _press(own.fill_null(0).to_numpy().tobytes() + np.asarray(own.is_null().to_numpy(zero_copy_only=False)).astype("<i8").tobytes() + t.part.astype("<i8").tobytes() + t.sizes.astype("<i8").tobytes() + _planes(total[t.word]) + _planes(total[t.pair]))
    weighing = t.part == WEIGHING
    row = (table.column("block")[0].as_py(), table.num_rows, data, words, int(t.sizes[train].sum()), int(train.sum()), int(t.sizes[weighing].sum()), int(weighing.sum()), _press(cells.astype("<i8").tobytes() + n.astype("<i8").tobytes()))
    return pa.table([pa.array([v], f.type) for v, f in zip(row, _meet.schema, strict=True)], schema=_meet.schema)


def context_level(context: np.ndarray) -> np.ndarray:
    return np.where(context < 0, LEVELS, level(np.maximum(context, 0)))


_meet.schema = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), *[(c, pa.int64()) for c in ("words", "train_tokens", "train_docs", "weighing_tokens", "weighing_docs")], ("histogram", pa.binary())])


def learn(cells: np.ndarray, n: np.ndarray, known: int) -> np.ndarray:
    """Weights (level, 3) of the pair's, the word's and the uniform estimate, by expectation-maximisation.

    cells: for each counted combination its level and both estimates in steps; n: how often it occurs.
    """
    lv, pair, word = cells
    p = np.stack([np.where(pair == NEVER, 0, 2.0 ** (-pair / STEPS)), np.where(word == NEVER, 0, 2.0 ** (-word / STEPS)), np.full(len(n), 1 / (known + 1))])
    out = np.full((LEVELS + 1, 3), 1 / 3)
    all_levels = np.full(3, 1 / 3)
    for _ in range(ROUNDS):
        shares = out[lv].T * p
        shares *= n / shares.sum(0)
        by = np.stack([np.bincount(lv, s, LEVELS + 1) for s in shares], axis=1)
        shares = all_levels[:, None] * p
        whole = (shares * (n / shares.sum(0))).sum(1)
        all_levels = whole / whole.sum() if whole.sum() else all_levels
        # a level that few tokens have leans on all levels together; no weight is 0 but that of pairs behind an unknown context, which have no estimate
        out = by + all_levels + 1e-6
        out[0, 0] = 0
        out /= out.sum(1, keepdims=True)
    return out


def usable(weights: np.ndarray, tokens: int, docs: int) -> np.ndarray:
    """The weights without those of estimates that don't exist for want of training documents, so that probabilities sum to 1."""
    out = weights.copy()
    if not docs:
        out[LEVELS, 0] = 0
    if not tokens:
        out[:, 1] = 0
    return out / out.sum(1, keepdims=True)


def mixed(weights: np.ndarray, levels: np.ndarray, pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, known: int) -> np.ndarray:
    """P(word | context) from counts."""
    w = weights[levels]
    return w[:, 0] * _ratio(pair, context) + w[:, 1] * (word / max(tokens, 1)) + w[:, 2] / (known + 1)


def _histogram(weighed_tokens: int, weighed_docs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("histogram"):
                raw = np.frombuffer(_open(data.as_py()), "<i8").reshape(5, -1)
                lv, pair, word, starts = raw[:4]
                pair = np.where(lv == LEVELS, _steps(starts / max(weighed_docs, 1)), pair)
                cells, back = np.unique(np.stack([lv, pair, _steps(word / max(weighed_tokens, 1))]), axis=1, return_inverse=True)
                n = np.bincount(back.ravel(), raw[4], cells.shape[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells, n)], ["level", "pair", "word", "n"])

    return rows


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(known: int, tokens: int, docs: int, weights: np.ndarray):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in zip(batch.column("n").to_pylist(), batch.column("data"), strict=True):
                raw = _open(data.as_py())
                ids, null, part, sizes = (np.frombuffer(raw, "<i8", rows, 8 * rows * k) for k in range(4))
                rest = raw[32 * rows :]
                word, pair = _unplaned(rest[: len(rest) // 2]), _unplaned(rest[len(rest) // 2 :])
                starts = np.append(0, np.cumsum(sizes)[:-1])
                context = np.append(docs, word[:-1])
                context[starts] = docs
                lv = level(context)
                lv[starts] = LEVELS
                score = np.add.reduceat(np.log10(mixed(weights, lv, pair, context, word, tokens, known)), starts)
                base = np.add.reduceat(np.log10((word + 1) / (tokens + known + 1)), starts)
                n_known = np.add.reduceat((word > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(part == HELD_OUT), pa.array(sizes), pa.array(n_known), pa.array(np.full(rows, tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """The log10 probability of each text under an interpolated bigram model that is learnt from the training documents.

    Returns a row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score.

    Documents with crc32(doc_id as text) mod 7 = 2 are held out of all learning. P(w | h) mixes the maximum-likelihood
    estimates c(h, w) / c(h) and c(w) / N and the uniform 1 / (V + 1), by weights for each power of two of c(h), and own ones for
    the start of a text; behind a context of count 0 the pair has no weight, so that all probabilities sum to 1. The weights come from expectation-maximisation on the training documents with remainder 3, under counts from
    which these are deleted; the scores use the counts of all training documents.

    Documents are dealt into blocks. Each sends its distinct words and pairs, as sorted 64-bit hashes with its counts, to
    buckets of the hash, and gets the whole corpus's counts back, so a frequent pair is one entry for a block. Two of the corpus's
    V words share a hash with a chance of about V * V / 2**64.

    Null and empty texts are one end token. A null doc_id counts as the text ''. Repeated rows count and score each; those that
    repeat both id and text are one block's. An empty table gives no rows; without training documents the score is that of the uniform estimate.
    Very long texts are read whole, by one task. Only the two columns are read, so others may have any names.
    """
    docs = texts(docs, id_col, text_col)
    n = blocks(docs, BLOCK_BYTES)
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    dealt = in_blocks(docs.withColumn("part", crc % FOLDS), n)
    counted = exchanged(dealt, _send(n), _count(n), n, n, fan)
    met = stored(answered(dealt, counted, n, _meet, BLOCKS), "tokens")
    sums = met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "train_tokens", "train_docs", "weighing_tokens", "weighing_docs")]).first()
    cells = met.select("histogram").mapInArrow(_histogram(sums["train_tokens"] - sums["weighing_tokens"], sums["train_docs"] - sums["weighing_docs"]), "level long, pair long, word long, n long")
    # a row for each level and two steps: a fixed number at most, whatever the corpus
    table = cells.groupBy("level", "pair", "word").agg(F.sum("n").alias("n")).toArrow()
    level_, pair, word, count = (np.asarray(table.column(c).combine_chunks()) for c in ("level", "pair", "word", "n"))
    weights = usable(learn(np.stack([level_, pair, word]), count, sums["words"]), sums["train_tokens"], sums["train_docs"])
    return met.select("n", "data").mapInArrow(_score(sums["words"], sums["train_tokens"], sums["train_docs"], weights), SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))
