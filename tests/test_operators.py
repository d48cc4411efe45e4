import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vetra.operators import aggregate, checks, duplicates, lineage, lookup, metrics, sampling


def long_table(spark, labels, scores, head="FILE_FAKE"):
    return spark.createDataFrame([(head, y, s) for y, s in zip(labels, scores, strict=True)], "head string, label double, score double")


def test_hand_metrics(spark):
    m = metrics.head_metrics(long_table(spark, (0.0, 0.0, 1.0, 1.0), (0.1, 0.4, 0.35, 0.8))).first()
    assert (m.eer, m.auc, m.brier, m.component, m.status) == (0.5, 0.75, pytest.approx(0.158125), 0.5, "OK")


def brute(y, s):
    y, s = np.array(y), np.array(s)
    p, n = y.sum(), (1 - y).sum()
    t = sorted(set(s), reverse=True)
    points = [(0.0, 1.0)] + [(((s >= x) & (y == 0)).sum() / n, 1 - ((s >= x) & (y == 1)).sum() / p) for x in t]
    k = int(np.argmin([abs(a - b) for a, b in points]))
    auc = sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]) / (p * n)
    edges = np.linspace(0, 1, 16)
    bins = np.minimum(np.searchsorted(edges, s, side="right") - 1, 14)
    ece = sum((bins == b).mean() * abs(s[bins == b].mean() - y[bins == b].mean()) for b in set(bins))
    c = np.clip(s, 1e-12, 1 - 1e-12)
    return {"eer": sum(points[k]) / 2, "auc": auc, "ece": ece, "log_loss": -np.mean(y * np.log(c) + (1 - y) * np.log(1 - c)), "brier": np.mean((s - y) ** 2)}


@pytest.mark.parametrize("seed", range(3))
def test_metrics_by_brute_force(spark, seed):
    r = random.Random(seed)
    y = [float(r.random() < 0.4) for _ in range(200)]
    s = [round(r.random(), 1 + seed) for _ in y]
    got = metrics.head_metrics(long_table(spark, y, s)).first().asDict()
    for k, v in brute(y, s).items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def test_weights_are_repeats(spark):
    y, s = [0.0, 1.0, 1.0, 0.0], [0.2, 0.6, 0.1, 0.9]
    w = [2, 1, 3, 1]
    a = long_table(spark, y, s).withColumn("w", F.when(F.col("score") == 0.2, 2).when(F.col("score") == 0.1, 3).otherwise(1))
    b = long_table(spark, np.repeat(y, w).tolist(), np.repeat(s, w).tolist())
    assert metrics.head_metrics(a, weight="w").first() == metrics.head_metrics(b).first()


def test_one_class_and_bad_scores(spark):
    m = metrics.head_metrics(long_table(spark, (1.0, 1.0, None), (0.1, 0.2, 0.3))).first()
    assert (m.status, m.observed_count, m.auc) == ("INSUFFICIENT_CLASSES", 2, None)
    for labels, scores in (((0.0, 2.0), (0.1, 0.2)), ((0.0, 1.0), (0.1, 1.2)), ((0.0, 1.0), (0.1, float("nan")))):
        with pytest.raises(Exception, match="labels must be"):
            metrics.head_metrics(long_table(spark, labels, scores)).collect()


def test_composite(spark):
    m = spark.createDataFrame(list(zip(metrics.HEADS, (0.9, 0.8, 0.7, 0.8, 0.6), strict=True)), "head string, component double")
    got = metrics.composite(m).first()
    assert (got.ads, got.cps, got.score) == (pytest.approx(0.82), pytest.approx(0.7), pytest.approx(0.808))
    assert got.score == pytest.approx(np.dot(metrics.WEIGHTS, (0.9, 0.8, 0.7, 0.8, 0.6)))
    with pytest.raises(Exception, match="no component"):
        metrics.composite(m.where("head <> 'FILE_FAKE'")).collect()


def test_label_contract(spark):
    df = spark.createDataFrame([(d, n) for d, (n, _) in metrics.LABELS.items()], "dataset string, label string")
    got = {r.head: r.n for r in metrics.label_heads(df).groupBy("head").agg(F.count("head_label").alias("n")).collect()}
    assert got == dict(zip(metrics.HEADS, (4, 2, 2, 3, 4), strict=True))
    with pytest.raises(Exception, match="label contract"):
        metrics.label_heads(df.withColumn("label", F.lit("real"))).collect()


def test_exact_bootstrap(spark):
    r = random.Random(1)
    data = [(f"g{k % 20:02d}", h, float(r.random() < 0.5), round(r.random(), 3)) for k in range(200) for h in metrics.HEADS]
    long = spark.createDataFrame(data, "grp string, head string, label double, score double")
    weights = sampling.exact_weights(long, "grp", 6, 456)
    got = {x.replicate: x.score for x in sampling.group_bootstrap(long, "grp", weights).collect()}
    groups = sorted({d[0] for d in data})
    g = np.random.default_rng(456)
    for k in range(6):
        drawn = [groups[i] for i in g.integers(0, len(groups), size=len(groups))]
        score = 0.0
        for h, w in zip(metrics.HEADS, metrics.WEIGHTS, strict=True):
            own = [d for x in drawn for d in data if d[0] == x and d[1] == h]
            m = brute([d[2] for d in own], [d[3] for d in own])
            score += w * (1 - m["eer"] if h in metrics.BY_ERROR_RATE else m["auc"])
        assert got[k] == pytest.approx(score, abs=1e-12)


def test_balanced_loss_ignores_masked(spark):
    df = spark.createDataFrame([("FILE_FAKE", 1.0, 0.0), ("FILE_FAKE", 0.0, 0.0), ("FILE_FAKE", None, float("nan"))], "head string, label double, logit double")
    assert metrics.balanced_loss(df).first()[0] == pytest.approx(0.45 * np.log(2))


def test_crossings(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "test")], "g string, s string")
    assert rows(lineage.crossings(df, "g", "s")) == [("a", "train|validation")]
    m = lineage.leakage_matrix(df.unionAll(spark.createDataFrame([(None, "train"), ("c", None)], df.schema)), "g", "s").first()
    assert (m.group_count, m.train_validation, m.train_test, m.all_three, m.affected_rows, m.missing_rows) == (2, 1, 0, 0, 2, 2)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(rows(lineage.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert lineage.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shape", ["rising", "star", "comb"])
def test_components_take_few_turns(spark, monkeypatch, shape):
    """Turns grow with the logarithm, also along a path whose numbers rise."""
    n = 10_000
    edges = {"rising": [(k, k + 1) for k in range(n)], "star": [(n, k) for k in range(n)], "comb": [(k, k + 1) for k in range(0, n, 2)] + [(k, k + 2) for k in range(0, n - 2, 2)]}[shape]
    turns, least = [], lineage._least_neighbours
    monkeypatch.setattr(lineage, "_least_neighbours", lambda e, turn: turns.append(turn) or least(e, turn))
    got = lineage.components(spark.createDataFrame(edges, "a long, b long"))
    assert got.groupBy("root").count().collect() == [(0, len({v for e in edges for v in e}))]
    assert len(turns) <= 14


def test_duplicates(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4), ("e", 5), ("e", 6)], "h string, id int")
    assert rows(duplicates.duplicate_groups(df, "h", "id", empty="e")) == [("x", 2, "1;2")]
    assert tuple(duplicates.duplicate_rollup(df, "h").first()) == (2, 4, 2, 2)
    assert tuple(duplicates.duplicate_rollup(df.limit(0), "h").first()) == (0, 0, 0, 0)
    assert rows(duplicates.size_histogram(df, "h")) == [(1, 1), (2, 2)]


def test_lookups(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows(lookup.first_wins(left, right, ["k"], [F.col("v")])) == [("a", 1), ("b", 3), ("c", None)]
    assert rows(lookup.last_wins(left, right, ["k"], [F.col("v")])) == [("a", 2), ("b", 3), ("c", None)]
    assert rows(lookup.multiplicity(left, right, "k", "v").select("k", "status")) == [("a", "AMBIGUOUS"), ("b", "UNIQUE"), ("c", "EXTRA")]
    d = lookup.differences(left, right, "k").first()
    assert (d.only_a, d.only_b, d.both, d.sets_equal, d.a_in_b) == (1, 0, 2, False, False)
    a = spark.createDataFrame([(1, 0.5), (2, None)], "k int, m double")
    b = spark.createDataFrame([(1, 0.5 + 1e-13), (2, None), (3, 1.0)], "k int, m double")
    assert rows(lookup.keyed_comparison(a, b, ["k"], ["m"]).select("k", "agrees")) == [(1, True), (2, True), (3, False)]


def test_sampling(spark):
    df = spark.range(10).withColumn("g", F.lit("x"))
    assert [r.position for r in sampling.evenly_spaced(df, ["g"], [F.col("id")], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert [r.position for r in sampling.evenly_spaced(df, ["g"], [F.col("id")], 1).collect()] == [5]
    with pytest.raises(Exception, match="too few"):
        sampling.evenly_spaced(df, ["g"], [F.col("id")], 11).collect()
    folds = lineage.leave_one_out(spark.createDataFrame([("a",), ("b",), ("a",)], "p string"), "p")
    assert rows(aggregate.counts(folds, ["fold", "role"])) == [("a", "held_out", 2), ("a", "train", 1), ("b", "held_out", 1), ("b", "train", 2)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "", float("nan")), (2, None, 2.0)], "k int, s string, x double")
    got = rows(checks.violations(df, ["k"], ["s"], {"s": ("a",)}))
    assert got == [("allowed:s", "1", ""), ("allowed:s", "2", "null"), ("required:s", "1", ""), ("required:s", "2", ""), ("unique", "1", "2")]
    assert rows(checks.non_finite(df, "k")) == [(1, "x")]
    ledger = checks.ledger(spark, {"a": ([], {}), "b": (["e"], {"n": 1})})
    assert tuple(checks.gate(ledger).first()) == (2, 1, "BLOCKED")
    with pytest.raises(ValueError, match=r"\$\.outer\[0\]\.inner"):
        checks.assert_finite({"outer": [{"inner": float("nan")}]})
    with pytest.raises(TypeError):
        checks.strict_json({"x": {1}})
    with pytest.raises(ValueError):
        checks.load_strict_json('{"a": NaN}')
    assert checks.compare_identity({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None}) == ["b", "c"]


def test_isolation(spark):
    df = spark.createDataFrame([("g1", "test", "x"), ("g2", "train", "y")], "g string, split string, label string")
    assert checks.isolated(lambda t: lineage.crossings(t, "g", "split"), df, ["label"], F.col("split") == "test").count() == 0
    assert checks.isolated(lambda t: t.groupBy("label").count(), df, ["label"], F.col("split") == "test").count() == 2
    held, rest = checks.isolation_split(df.unionAll(spark.createDataFrame([("g3", None, "z")], df.schema)), "split", "test", ["g", "split"])
    assert rows(held) == [("g1", "test")] and rest.count() == 2


def test_scan_is_pruned(spark, sf):
    df = lineage.crossings(spark.read.parquet(f"{sf}/documents.parquet"), "source", "lang")
    assert checks.columns_read(df) == {"source", "lang"}


def test_contract_of_aggregates(spark):
    df = spark.createDataFrame([("f", 0.2), ("f", 0.4)], "file string, p double")
    assert aggregate.segment_means(df, "file", ["p"]).first().p == pytest.approx(0.3)
    with pytest.raises(Exception, match="must be in"):
        aggregate.segment_means(df.withColumn("p", F.lit(1.5)), "file", ["p"]).collect()
    q = aggregate.quantile_profile(spark.range(101), [], ["id"]).first()
    assert (q.p01, q.p50, q.p99, q.mean) == (1.0, 50.0, 99.0, 50.0)


def test_manifest(spark):
    from vetra.plans import manifest

    common = "sample_rate_hz string, channels string, duration_seconds string, file_sha256 string, pcm_sha256 string"
    speech = spark.createDataFrame([("LJ1", "OK", "True", "a.wav", "16", "1", "3600", "h", "p"), ("LJ2", "BAD", "True", "b.wav", "16", "1", "1", "h", "p")], f"id string, parse_status string, metadata_present string, relative_path string, {common}")
    generated = spark.createDataFrame([("generated", "true", "d", "s", "fam", "gen", "fam:s", "m.wav", "c", "16", "1", "2", "h", "p"), ("redundant_duplicate_copy", "true", "d", "s", "fam", "gen", "fam:s", "m.wav", "c", "16", "1", "2", "h", "p")], f"role string, training_eligible string, dataset_dir string, source_id string, source_family string, generator string, content_group_key string, zip_member string, codec string, {common}")
    music = spark.createDataFrame([("7", "true", "OK", "c1", "x.mp3", "mp3", "44", "2", "30", "h", "p", "t", "u", "ALLOW_BY_NC_SA", "ar", "al", "ti")], "track_id string, strict_allowlist string, decode_status string, component_id string, relative_path string, codec string, sample_rate_hz string, channels string, decoded_duration_seconds string, file_sha256 string, decoded_pcm_sha256 string, license_title string, license_url string, license_category string, artist_id string, album_id string, track_title string")
    prompted = spark.createDataFrame([("9", "true", "OK", "prov", "sem", "s.parquet", "3", "mp3", "44", "2", "10", "h", "p", "attr", "url")], "id string, training_eligible string, decode_status string, provider string, semantic_group_sha256 string, source_parquet string, row_in_parquet string, codec string, sample_rate_hz string, channels string, decoded_duration_seconds string, audio_sha256 string, decoded_pcm_f32le_sha256 string, attribution_text string, license_source_url string")
    tables = {"ljspeech-1.1": speech, "wavefake-1.2.0": generated, "fma-small": music, "aime-open-model-subset": prompted}
    m = manifest.build(tables, "salt", {"ljspeech-1.1": "/s", "wavefake-1.2.0": "/a.zip", "fma-small": "/m", "aime-open-model-subset": "/p"})
    assert m.where("license_source is null or attribution_text is null or eligibility_reason is null or leakage_notes is null").count() == 0
    assert tuple(m.columns) == manifest.FIELDS
    got = {r.sample_id: r for r in m.collect()}
    assert set(got) == {"LJ1", "d:s", "7", "9"}
    assert got["d:s"].source_locator == "zip:///a.zip!/m.wav" and got["9"].source_locator == "parquet:///p/s.parquet#row=3"
    assert got["7"].noncommercial_only and got["7"].sharealike_required and not got["LJ1"].attribution_required
    assert manifest.summary(m).agg(F.sum("row_count")).first()[0] == 4


def test_strict_tables_fail(spark):
    df = spark.createDataFrame([("a", "test"), ("b", "test")], "g string, s string")
    assert rows(lineage.strict_crossings(df, "g", "s", "test")) == [("a", "test"), ("b", "test")]
    with pytest.raises(ValueError, match="alone"):
        lineage.strict_crossings(df.withColumn("label", F.lit(1)), "g", "s", "test")
    for bad in (("a", "train"), ("", "test"), (None, "test"), ("a", None)):
        with pytest.raises(Exception, match="no group"):
            lineage.strict_crossings(df.unionAll(spark.createDataFrame([bad], df.schema)), "g", "s", "test").collect()
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "q"), (1, "p")], "k int, w string")
    assert rows(lookup.one_to_one(a, b, "k")) == [(1, "x", "p"), (2, "y", "q")]
    for other in (b.where("k = 1"), b.unionAll(b.where("k = 1")), b.unionAll(spark.createDataFrame([(3, "z")], b.schema))):
        with pytest.raises(Exception, match="not one to one"):
            lookup.one_to_one(a, other, "k").collect()


def test_unknown_heads_have_rows(spark):
    """A key's head without any known label has a row, and so has a null slice."""
    long = spark.createDataFrame([(None, "FILE_FAKE", 1.0, 0.9), (None, "FILE_FAKE", 0.0, 0.2), ("x", "FILE_FAKE", None, 0.5)], "lang string, head string, label double, score double")
    got = {(r.slice, r["head"]): r for r in metrics.slice_metrics(long, ["lang"]).collect()}
    assert len(got) == 10 and got[None, "FILE_FAKE"].status == "OK" and got[None, "FILE_FAKE"].auc == 1 and got[None, "FILE_FAKE"].head_weight == 0.45
    assert all((r.observed_count, r.positive_count, r.status, r.auc) == (0, 0, "INSUFFICIENT_CLASSES", None) for k, r in got.items() if k != (None, "FILE_FAKE"))
    assert metrics.head_metrics(long.where("lang = 'x'")).first().observed_count == 0


def test_audio_formulas():
    """Filters and features by hand values."""
    from vetra.operators import audio

    f = audio.mel_filter(8000, 16, 3, 0.0)
    assert f.shape == (3, 9) and np.allclose(f.sum(1), 1) and (f >= 0).all()
    flat = audio.log_mel(np.sin(np.arange(4000) / 3), 4000, audio.mel_filter())
    n = 25 * 64  # the 26th frame has its centre behind the end
    assert (flat[:, 25:] == 0).all() and abs(flat.mean()) < 1e-9 and abs((flat**2).sum() / (n - 1) - 1) < 1e-9
    half = audio.log_mel(np.sin(np.arange(4000) / 3), 1600, audio.mel_filter())
    assert (half[:, 10:] == 0).all() and abs((half**2).sum() / (64 * 10 - 1) - 1) < 1e-9
    assert (audio.log_mel(np.ones(4000), 0, audio.mel_filter()) == 0).all()


def test_manifest_with_blanks(spark):
    """Blank artists, categories and providers give texts and flags, as from a table whose blanks are empty texts."""
    from vetra.plans import manifest

    row = {"track_id": "7", "component_id": "c", "relative_path": "x.mp3", "codec": "mp3", "sample_rate_hz": 1, "channels": 2, "decoded_duration_seconds": 1.5, "file_sha256": "s", "decoded_pcm_sha256": "p", "license_title": None, "license_url": "u", "license_category": None, "artist_id": None, "album_id": "b", "track_title": None, "strict_allowlist": "True", "decode_status": "OK"}
    kinds = ", ".join(f"{k} {'int' if v in (1, 2) else 'double' if v == 1.5 else 'string'}" for k, v in row.items())
    fma = manifest.homogenised(spark.createDataFrame([tuple(row.values())], kinds), "fma-small", manifest.RULES["fma-small"], "s", "/r").first()
    assert (fma.attribution_text, fma.license_id) == ("FMA track 7:  / b / ", "")
    assert (fma.attribution_required, fma.sharealike_required, fma.noncommercial_only, fma.changes_notice_required) == (True, False, False, True)
    blank = spark.createDataFrame([(None, "OK", "True")], "id string, decode_status string, training_eligible string")
    rest = ("provider", "semantic_group_sha256", "source_parquet", "row_in_parquet", "codec", "sample_rate_hz", "channels", "decoded_duration_seconds", "audio_sha256", "decoded_pcm_f32le_sha256", "license_source_url", "attribution_text")
    aime = manifest.homogenised(blank.selectExpr("*", *[f"cast(null as string) {c}" for c in rest]), "aime-open-model-subset", manifest.RULES["aime-open-model-subset"], "s", "/r").first()
    assert (aime.generator_or_provider, aime.provider_holdout_group, aime.content_group_key, aime.attribution_text) == ("", "aime-open-model-subset:", "aime-prompt:", "")
