"""What the classifier learns from, and its loss and chances by their formulas."""

import math

import numpy as np
import pyarrow as pa
import pytest

from vetra.llm import quality


def test_all_features_of_a_row_are_learnt():
    text = " ".join(f"w{k}" for k in range(3000))
    batch = pa.RecordBatch.from_pydict({"grade": pa.array([0], pa.int32()), "turn": pa.array([1], pa.int64()), "text": [text]})
    own = next(quality._examples(iter([batch]))).column("features")[0].values
    assert np.array_equal(np.asarray(own), quality.Features().of(text)) and len(own) > 3000


def test_rare_features_are_learnt_at_any_size():
    """A term of 5 toxic rows has a weight among 400 rows and among 6,000."""
    for n in (400, 6000):
        toxic = set(range(0, n, n // 5)[:5])
        grades = np.array([0 if k in toxic else 2 for k in range(n)])
        model = quality.fit_rows(grades, [np.array([1, 2] if k in toxic else [1]) for k in range(n)])
        assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)).get(2, 0) < 0


def loss(w, cuts, grades, features, sparse):
    """Mean over rows of the losses of all cumulative logits, and the penalty, by the formula."""
    total = 0.0
    for y, own in zip(grades, features):
        score = sum(w.get(int(f), 0.0) for f in own)
        for k, c in enumerate(cuts):
            p = 1 / (1 + math.exp(-(score - c)))
            total -= math.log(p if y > k else 1 - p)
    return total / len(grades) + sparse * sum(map(abs, w.values()))


def test_fit_is_the_least_loss():
    """No step in any weight or threshold lowers the loss: its gradient is 0 where the fit ends."""
    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, 8, 4)) for _ in range(120)]
    grades = np.array([min(2, max(0, int(round(1 + (3 in f) - (5 in f) + rng.normal(0, 0.8))))) for f in features])
    m = quality.fit_rows(grades, features)
    w, sparse = dict(zip(m.index.tolist(), m.weight.astype(float).tolist())), quality.SPARSE / len(grades) ** 0.5
    best = loss(w, m.thresholds, grades, features, sparse)
    assert w[3] > 0.3 and w[5] < -0.3 and m.thresholds[0] < m.thresholds[1]
    for d in (-0.1, 0.1):
        for f in range(8):
            assert loss(w | {f: w.get(f, 0.0) + d}, m.thresholds, grades, features, sparse) > best - 1e-4
        for k in range(2):
            cuts = m.thresholds.copy()
            cuts[k] += d
            assert loss(w, cuts, grades, features, sparse) > best - 1e-4


def test_tail_chances(spark):
    """P(grade > k), the expected grade and the choice, by the formula; null, empty and very long texts too."""
    texts = ["good words", "bad words", None, "", "long " * 150_000, "good bad good"]
    names = {f"w:{w}": v for w, v in (("good", 1.5), ("bad", -2.0), ("long", 0.25))}
    index = np.array(sorted(quality._hashed(n) for n in names))
    weight = np.array([{quality._hashed(n): v for n, v in names.items()}[i] for i in index.tolist()], np.float32)
    model = quality.Model(index, weight, np.array([-0.5, 0.75]))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    for r in quality.grade(docs, model).collect():
        score = sum(names.get(f"w:{w}", 0) for w in set((texts[r.doc_id] or "").split()))
        tails = [1 / (1 + math.exp(-(score - c))) for c in (-0.5, 0.75)]
        assert (r.score, r.p_above_0, r.p_above_1, r.expected_grade) == pytest.approx((score, *tails, sum(tails))) and r.kept == (tails[1] >= quality.LEAST_CHANCE)
    assert sorted(r.doc_id for r in quality.good(docs, model, 0.6).collect()) == [0]
    assert quality.grade(docs.limit(0), model).count() == 0 and quality.good(docs.limit(0), model).columns == docs.columns


def test_training_rows_are_bounded(spark, monkeypatch):
    """An id that repeats is one row; of more ids than the bound, so many count; null ids and grades don't."""
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda grades, features: seen.append((len(grades), sorted(grades.tolist()))))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, "t") for k in range(2, 12)] + [(None, "n")], "doc_id long, text string")
    grades = spark.createDataFrame([(k, k % 3) for k in range(1, 12)] + [(None, 1), (3, None), (1, 2)], "doc_id long, grade int")
    quality.fit(docs, grades)
    quality.fit(docs, grades, train_rows=4)
    quality.fit(docs, grades.limit(0))
    assert [n for n, _ in seen] == [11, 4, 0] and seen[0][1] == sorted(k % 3 for k in range(1, 12))


def test_a_fit_holds_its_features_once():
    """What a fit takes beyond its rows is bounded by the model: its arrays, and one batch of rows."""
    import tracemalloc

    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, quality.FEATURES, 2_500)).astype(np.int32) for _ in range(12_000)]  # 120 MB
    grades = np.arange(len(features), dtype=np.int32) % 3
    passes = quality.PASSES, quality.STEPS
    quality.PASSES, quality.STEPS = 1, 1
    try:
        tracemalloc.start()
        quality.fit_rows(grades, features)
        assert tracemalloc.get_traced_memory()[1] < 30 * quality.FEATURES
    finally:
        tracemalloc.stop()
        quality.PASSES, quality.STEPS = passes


def test_a_fit_has_one_array_of_all_feature_values():
    """Weights are held for features that may get one, not for each value that a hash has."""
    import tracemalloc

    rng = np.random.default_rng(6)
    features = [np.unique(rng.integers(0, 3_000, 200)).astype(np.int32) for _ in range(300)]
    tracemalloc.start()
    try:
        model = quality.fit_rows(np.arange(len(features)) % 3, features)
        assert tracemalloc.get_traced_memory()[1] < 8 * quality.FEATURES
    finally:
        tracemalloc.stop()
    assert model.index.max() < 3_000 and len(model.index) == len(model.weight)


def test_training_rows_lie_in_a_file_of_the_driver(spark, monkeypatch):
    """In the order of their turns, with the features that their texts have; the stored rows are gone."""
    seen = []

    def fit_rows(grades, features):
        own = features[0]
        while isinstance(own, np.ndarray) and own.base is not None:
            own = own.base
        seen.append((type(own).__name__, grades.tolist(), [f.tolist() for f in features]))

    monkeypatch.setattr(quality, "fit_rows", fit_rows)
    texts = {k: " ".join(f"w{k * j % 7}" for j in range(k)) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before = set(spark._vetra_stored) if hasattr(spark, "_vetra_stored") else set()
    quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 as int) as grade"))
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as turn").orderBy("turn").collect()]
    assert seen == [("mmap", [k % 3 for k in order], [quality.Features().of(texts[k]).tolist() for k in order])]
    assert spark._vetra_stored == before
