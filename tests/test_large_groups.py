"""Operators that split large groups: ordinals, running sums, quantiles, pages, quads, replicates as vectors, folds by subtraction."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vetra.operators import folds, metrics, ordinals, pages, quads, quantiles, replicates, sampling
from vetra.sources import tables


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_one_group_by_several_tasks(spark):
    """600,000 rows of one group, equal to row_number, none of them numbered by a task alone."""
    df = spark.range(600_000).select(F.lit("g").alias("grp"), ((F.col("id") * 7919) % 600_000).alias("v"))
    rows_, _ = ordinals.ranged(df, [F.desc("v")], ["grp"])
    sizes = [r[0] for r in rows_.groupBy("_range").count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 300_000
    out = ordinals.numbered(df, [F.desc("v")], ["grp"], size="n")
    assert out.where("ordinal <> 600000 - v or n <> 600000").count() == 0 and out.count() == 600_000


@pytest.mark.parametrize("group", [[], ["a"], ["a", "b"]])
def test_numbered(spark, group):
    r = random.Random(1)
    data = [(r.choice([None, "x", "y"]), r.choice([None, 1, 2]), k, f"_row{k}") for k in range(300)]
    df = spark.createDataFrame(data, "a string, b int, k int, _row string").repartition(5)
    want, seen = [], {}
    for row in sorted(data, key=lambda x: -x[2]):
        key = tuple(row["ab".index(c)] for c in group)
        seen[key] = seen.get(key, 4) + 1
        want.append((*row, seen[key]))
    got = ordinals.numbered(df, [F.desc("k")], group, "at", 5)
    assert got.columns == [*df.columns, "at"] and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert ordinals.numbered(df.limit(0), [F.col("k")], group).count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    data = [(r.choice([None, "x"]), k, r.choice([None, 1.0, 2.5])) for k in range(200)]
    df = spark.createDataFrame(data, "g string, k int, w double").repartition(3)
    got = {(x.g, x.k): (x.up, x.all) for x in ordinals.running_sums(df, [F.col("k")], {"up": "w"}, ["g"], {"all": "w"}).collect()}
    for g in (None, "x"):
        own = sorted([x for x in data if x[0] == g], key=lambda x: x[1])
        for k, x in enumerate(own):
            assert got[g, x[1]] == (sum(v[2] or 0 for v in own[: k + 1]), sum(v[2] or 0 for v in own))


def test_numbered_csv_without_one_task(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for f in range(3):
        (tmp_path / f"many/{f}.csv").write_text("id,name\n" + "".join(f"{k},{'n' * 30}\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = tables.numbered_csv(spark, str(tmp_path / "many"), ["id", "name"], multiline=False)
        assert out.count() == 9000 and out.where("id <> line_number - 2").count() == 0
        out = tables.numbered_csv(spark, str(tmp_path / "many/0.csv"), ["id", "name"])
        assert out.count() == 3000 and out.where("id <> line_number - 2").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("kind", ["ties", "skew", "nan", "signs", "large"])
def test_quantiles_equal_percentile(spark, kind):
    r = random.Random(kind)
    value = {
        "ties": lambda: float(r.choice([1, 1, 1, 2, 7])), "skew": lambda: math.exp(r.uniform(-300, 300)), "nan": lambda: r.choice([float("nan"), float("inf"), -float("inf"), 1.0, None]),
        "signs": lambda: r.choice([-0.0, 0.0, -1e-300, 1e-300, r.gauss(0, 1)]), "large": lambda: float(r.randrange(10**15)),
    }[kind]
    df = spark.createDataFrame([(r.choice([None, "a", "b"]), value(), r.choice([None, 3.0])) for _ in range(700)], "g string, v double, w double").repartition(3)
    at = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    want = df.unpivot(["g"], ["v", "w"], "column", "value").where("value is not null").groupBy("g", "column").agg(F.count("*").alias("n"), F.percentile("value", F.array(*map(F.lit, at))).alias("q"))
    same = lambda a, b: a == b or (a != a and b != b)
    got = {(x.g, x.column): x for x in quantiles.quantiles(df, ["g"], ["v", "w"], at).collect()}
    assert len(got) == want.count()
    for x in want.collect():
        assert got[x.g, x.column].n == x.n and all(same(got[x.g, x.column][f"q{k}"], q) for k, q in enumerate(x.q)), (x, got[x.g, x.column])
    assert quantiles.quantiles(df.limit(0), ["g"], ["v"], at).count() == 0


def test_pages(spark):
    """A key of 600,000 members is many rows; a small one is one."""
    df = spark.range(600_000).select(F.lit("hot").alias("k"), "id").unionByName(spark.createDataFrame([("small", 3), ("small", 1), ("small", 1), (None, 9), ("small", None)], "k string, id long"))
    out = pages.paged(df, "k", "id")
    hot = out.where("k = 'hot'")
    assert hot.count() == 60 and hot.agg(F.max(F.size("members"))).first()[0] == 10_000
    assert hot.where("members[0] <> page * 10000 or member_count <> 600000 or page_count <> 60").count() == 0
    assert rows(out.where("k <=> null or k = 'small'").select("k", "page", "page_count", "member_count", "members")) == [(None, 0, 1, 1, [9]), ("small", 0, 1, 3, [1, 1, 3])]
    assert [r.members for r in pages.paged(df.where("k = 'small'"), "k", "id", distinct=True).collect()] == [[1, 3]]


def stock(spark):
    """Hot groups, unpaired groups, held-out rows, a provider with nearly all rows."""
    data = [("speech_real", f"p{k % 5}", k, None) for k in range(50)] + [("speech_fake", f"p{k % 7}", 100 + k, None) for k in range(70)] + [("music_real", f"m{k % 3 if k < 20 else 9}", 200 + k, None) for k in range(200)]
    data += [("music_fake", f"f{k % 11}", 500 + k, "big" if k < 180 else f"small{k % 3}") for k in range(200)] + [(None, "held", 900, None), ("speech_real", None, 901, None)]
    return spark.createDataFrame(data, "stratum string, g string, record int, provider string").repartition(4)


def test_quads(spark):
    df = stock(spark)
    out = quads.paired_quads(df, 800, 7, (0, 1), group="g").cache()
    got = out.collect()
    known = {(r.stratum, r.g, r.record, r.provider) for r in df.collect()}
    assert len(got) == 2 * 800 * 4 and all((r.stratum, r.g, r.record, r.provider) in known for r in got)
    by = {}
    for r in got:
        by.setdefault((r.epoch, r.quad), []).append(r)
    for own in by.values():
        assert sorted(r.stratum for r in own) == sorted(quads.STRATA) and sorted(r.position for r in own) == [0, 1, 2, 3]
        speech = [r.g for r in own if r.stratum.startswith("speech")]
        assert speech[0] == speech[1] and speech[0] in {f"p{k}" for k in range(5)}
    for epoch in (0, 1):
        n = {}
        for r in got:
            if r.epoch == epoch and r.stratum == "music_fake":
                n[r.provider] = n.get(r.provider, 0) + 1
        assert len(n) == 4 and max(abs(v - 200) for v in n.values()) < 60  # uniform, though one has nearly all rows
        real = [r.g for r in got if r.epoch == epoch and r.stratum == "music_real"]
        assert abs(real.count("m9") - 200) < 60  # groups are uniform, though one is hot
    order = lambda e: [(r.quad, r.position, r.record) for r in sorted(got, key=lambda r: (r.quad, r.position)) if r.epoch == e]
    assert order(0) != order(1)
    again = quads.paired_quads(df.repartition(2), 800, 7, (1,), group="g")
    assert [(r.quad, r.position, r.record) for r in again.orderBy("quad", "position").collect()] == order(1)
    assert len({r.position for r in got if r.stratum == "speech_real"}) == 4
    with pytest.raises(ValueError, match="nothing to draw"):
        quads.paired_quads(df.where("stratum <> 'speech_fake'"), 8, 7, group="g")
    assert all(r.passed for r in quads.audit_quads(out, df, group="g").collect())
    out.unpersist()


def test_quad_audit_finds_planted_faults(spark):
    df = stock(spark)
    good = quads.paired_quads(df, 100, 7, group="g")
    good = spark.createDataFrame(good.collect(), good.schema)
    change = lambda where, **cols: good.withColumns({c: F.when(F.expr(where), v).otherwise(F.col(c)) for c, v in cols.items()})
    row = lambda x: quads.audit_quads(x, df, group="g").first()
    moved = row(change("quad = 3 and stratum = 'speech_fake'", g=F.lit("p6"), record=F.lit(106)))
    assert (moved.pair_mismatches, moved.held_out_rows, moved.uneven_quads, moved.passed) == (1, 0, 0, False)
    assert (lambda r: (r.held_out_rows, r.passed))(row(change("quad = 4 and stratum = 'music_real'", record=F.lit(900), g=F.lit("held")))) == (1, False)
    assert (lambda r: (r.uneven_quads, r.passed))(row(good.where("not (quad = 5 and position = 0)"))) == (1, False)
    assert (lambda r: (r.missing_providers, r.passed))(row(good.where("stratum <> 'music_fake' or provider = 'big'")))[0] == 3


def scored(spark, n=3000, groups=400, crowd=1.0, seed=3):
    r = random.Random(seed)
    data = [(f"g{r.randrange(groups)}", r.choice("abcd") if k % 9 else None, h, r.choice([0.0, 1.0, None]), round(r.random(), 2) * crowd) for k in range(n // 5) for h in metrics.HEADS]
    return spark.createDataFrame(data, "grp string, fold string, head string, label double, score double").repartition(4)


def test_crowded_scores_spread(spark):
    """All scores within 0.00001 of 0, or all but a few: as many ranges, the same rates."""
    wide, near = scored(spark), scored(spark, crowd=1e-5)
    a, b = (rows(metrics.head_metrics(x).select("head", F.round("auc", 12), F.round("eer", 12))) for x in (wide, near))
    assert a == b
    run = metrics.running(metrics.by_score(near, []), [], "range")
    assert run.groupBy("range").agg(F.count_distinct("s").alias("n")).agg(F.max("n")).first()[0] < 200 and run.select("range").distinct().count() == 4


def test_vectors_equal_weighted_rows(spark):
    for crowd in (1.0, 1e-5):
        long = scored(spark, 1500, 40, crowd)
        weights = sampling.poisson_weights(long, "grp", 20, 5)
        vectors = replicates.poisson_vectors(long, "grp", 20, 5)
        flat = vectors.select("grp", F.posexplode("weights").alias("replicate", "weight")).where("weight > 0")
        assert rows(flat.select("replicate", "grp", F.col("weight").cast("int"))) == rows(weights.select("replicate", "grp", "weight"))
        want = {r.replicate: r for r in sampling.group_bootstrap(long, "grp", weights).collect()}
        got = {r.replicate: r for r in replicates.bootstrap(long, "grp", vectors, 20).collect()}
        assert set(got) == set(want) and len(got) == 20
        for k, r in got.items():
            assert all(r[c] == pytest.approx(want[k][c], abs=1e-12) for c in (*metrics.HEADS, "ads", "cps", "score"))


def test_vectors_leave_out_replicates_of_one_class(spark):
    long = spark.createDataFrame([(g, h, y, 0.1 * k + 0.2 * y) for k, (g, y) in enumerate([("a", 0.0), ("b", 1.0), ("c", 0.0)]) for h in metrics.HEADS], "grp string, head string, label double, score double")
    want = sorted(r.replicate for r in sampling.group_bootstrap(long, "grp", sampling.poisson_weights(long, "grp", 30, 1)).collect())
    assert 0 < len(want) < 30
    assert sorted(r.replicate for r in replicates.bootstrap(long, "grp", replicates.poisson_vectors(long, "grp", 30, 1), 30).collect()) == want


@pytest.mark.parametrize("crowd", [1.0, 1e-5])
def test_folds_by_subtraction(spark, crowd):
    long = scored(spark, 2000, crowd=crowd, seed=8)
    long = long.unionByName(spark.createDataFrame([("g", "one", "FILE_FAKE", 1.0, 0.5 * crowd), ("g", "all", "X", 1.0, 0.5), ("g", "all", "X", 0.0, 0.25)], long.schema))
    got = {(r.fold, r.head): r for r in folds.leave_out(long, "fold").collect()}
    values = ["a", "b", "c", "d", "one", "all"]
    for v in values:
        held = {r["head"]: r for r in metrics.head_metrics(long.where(F.col("fold") == v)).collect()}
        rest = {r["head"]: r for r in metrics.head_metrics(long.where(f"fold is null or fold <> '{v}'")).collect()}
        for h, m in held.items():
            if not m.observed_count:
                continue
            r = got.pop((v, h))
            assert (r.held_count, r.held_positive) == (m.observed_count, m.positive_count)
            assert r.held_auc == (m.auc if m.auc is None else pytest.approx(m.auc, abs=1e-12)) and r.held_eer == (m.eer if m.eer is None else pytest.approx(m.eer, abs=1e-12))
            if h in rest:
                w = rest[h]
                assert (r.rest_count, r.rest_positive) == (w.observed_count, w.positive_count)
                assert r.rest_auc == (w.auc if w.auc is None else pytest.approx(w.auc, abs=1e-12)) and r.rest_eer == (w.eer if w.eer is None else pytest.approx(w.eer, abs=1e-12)), (v, h)
            else:
                assert (r.rest_count, r.rest_auc, r.rest_eer) == (0, None, None)
    assert not got
    worst = {r["head"]: r for r in folds.worst_fold(folds.leave_out(long, "fold")).collect()}
    assert worst["FILE_FAKE"].fold_count == 4 and worst["FILE_FAKE"].held_worst_fold in "abcd" and worst["X"].held_worst_fold == "all"


def test_stored_tables_are_cleared(spark, tmp_path):
    from vetra import storage

    own = storage.stored(spark.range(3), "mine")
    other = storage.stored(spark.range(3), "other")
    storage.dropped(other)
    assert own.count() == 3 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(own._vetra_path).count()
