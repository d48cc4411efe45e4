"""Named queries of the operators that split large groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.operators import calibration, duplicates, folds, lookup, metrics, pages, quads, quantiles, replicates, sampling
from vetra.plans.queries import _LONG, _REPLICATES, ORACLES, _heads, metrics_sql, unit_sql
from vetra.plans.registry import query, rounded, table
from vetra.sources import containers
from vetra.storage import shared_dir

# ---- archives ----


@query("""
SELECT (doc_id % 7)::VARCHAR || '.zip' AS archive, printf('%s/%d.txt', lang, doc_id) AS member, 0 AS depth, strlen(coalesce(text, '')) AS uncompressed_bytes, md5(coalesce(text, '')) AS content_md5, true AS safe, 'OK' AS status
FROM documents""")
def archive_contents(spark, d):
    """The documents, written as seven archives in the shared folder and read again by runs of members."""
    import uuid

    docs = table(spark, d, "documents").select(F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".zip")).alias("archive"), F.format_string("%s/%d.txt", "lang", "doc_id").alias("member"), "text")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    written = [r.archive for r in containers.write_archives(docs, folder, "archive", "member", "text").select("archive").collect()]  # seven names
    paths = spark.createDataFrame([(f"{folder}/{name}",) for name in sorted(written)], "path string")
    out = containers.archives(paths, members=100)
    return out.select(F.substring_index("archive", "/", -1).alias("archive"), "member", "depth", "uncompressed_bytes", F.md5("content").alias("content_md5"), "safe", "status")


@query("SELECT lang, count(*) AS members, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents WHERE lang = 'fr' GROUP BY lang")
def archive_filtered(spark, d):
    """One archive of all documents, of which a filter on names lets only the French ones be read."""
    import uuid

    docs = table(spark, d, "documents").select(F.lit("all.zip").alias("archive"), F.format_string("%s/%d.txt", "lang", "doc_id").alias("member"), "text")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    containers.write_archives(docs, folder, "archive", "member", "text").collect()  # one row
    found = containers.archive(spark, f"{folder}/all.zip", runMembers=200).where("member like 'fr/%'")
    return found.groupBy(F.substring_index("member", "/", 1).alias("lang")).agg(F.count("*").alias("members"), F.sum(F.length("content")).cast("long").alias("bytes"))


# ---- order ----


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS ordinal FROM lineitem")
def range_ordinals(spark, d):
    """All lines numbered by price within three groups, each by several tasks."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return lookup.ordinals(lines, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "ordinal")


_AT = (0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0)


@query(" UNION ALL ".join(f"SELECT event_type, '{c}' AS \"column\", count({c}) AS n, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 6) AS q{k}" for k, q in enumerate(_AT)) + " FROM events GROUP BY event_type" for c in ("value", "user_id")))
def selected_quantiles(spark, d):
    out = quantiles.quantiles(table(spark, d, "events"), ["event_type"], ["value", "user_id"], _AT)
    return rounded(out.select("event_type", "column", "n", *[f"q{k}" for k in range(len(_AT))]), *[f"q{k}" for k in range(len(_AT))])


@query("SELECT l_suppkey, (o - 1) // 100 AS page, ceil(n / 100)::BIGINT AS page_count, n AS member_count, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_partkey) AS members FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS o, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY ALL")
def paged_members(spark, d):
    """Each supplier's parts, a hundred to a page."""
    out = pages.paged(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 100)
    return out.withColumn("members", F.array_join("members", ";"))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS match_count, CASE WHEN n IS NULL THEN 'EXTRA' WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, page, ids AS match_ids FROM customer LEFT JOIN (SELECT o_custkey, n, (o - 1) // 5 AS page, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS ids FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o FROM orders) GROUP BY ALL) ON c_custkey = o_custkey")
def match_pages(spark, d):
    """Customers with their orders, five to a page."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = lookup.match_pages(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", 5)
    return out.withColumns({"match_count": F.col("match_count").cast("long"), "match_ids": F.array_join("match_ids", ";")})


@query("SELECT sha256(text) AS text_sha256, (o - 1) // 3 AS page, ceil(n / 3)::BIGINT AS page_count, n AS member_count, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) AS members FROM (SELECT text, doc_id, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS o FROM documents) WHERE n > 1 GROUP BY ALL")
def duplicate_pages(spark, d):
    """Documents of equal texts, three to a page."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return duplicates.duplicate_pages(docs, "text_sha256", "doc_id", size=3).withColumn("members", F.array_join("members", ";"))


@query("SELECT l_partkey, (o - 1) // 4 AS page, ceil(n / 4)::BIGINT AS page_count, n AS member_count, string_agg(l_suppkey::VARCHAR, ';' ORDER BY l_suppkey) AS members FROM (SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS o FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) GROUP BY ALL")
def inverted_pages(spark, d):
    """Each part's suppliers, four to a page."""
    return lookup.inverted_pages(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 4).withColumn("members", F.array_join("members", ";"))


# ---- quads ----

_QUADS, _EPOCHS = 2_000, (0, 3)
_STRATUM = "CASE WHEN l_returnflag = 'A' THEN 'speech_real' WHEN l_returnflag = 'R' THEN 'speech_fake' WHEN l_linenumber % 2 = 0 THEN 'music_real' WHEN l_linenumber < 6 THEN 'music_fake' END"
_DRAWN = f"""
r AS (SELECT {_STRATUM} AS stratum, l_suppkey AS g, l_orderkey * 10 + l_linenumber AS record, 'p' || (l_partkey % 9) AS provider FROM lineitem),
k AS (SELECT stratum, g, CASE WHEN stratum = 'music_fake' THEN provider ELSE '' END AS p, count(*) AS n FROM r WHERE stratum IS NOT NULL GROUP BY ALL),
sp AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM (SELECT g FROM k WHERE stratum = 'speech_real' INTERSECT SELECT g FROM k WHERE stratum = 'speech_fake')),
mr AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM k WHERE stratum = 'music_real'),
pr AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p FROM k WHERE stratum = 'music_fake')),
mf AS (SELECT p, g, row_number() OVER (PARTITION BY p ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY p) AS n FROM k WHERE stratum = 'music_fake'),
q AS (SELECT e AS epoch, i AS quad, '5|' || e || '|' || i || '|' AS x FROM range({_QUADS}) t(i), (VALUES {', '.join(f'({e})' for e in _EPOCHS)}) v(e)),
picks AS (
  SELECT epoch, quad, x, stratum, g, '' AS p FROM q JOIN sp ON sp.i = floor({unit_sql("x || 'speech'")} * n), (VALUES ('speech_real'), ('speech_fake')) v(stratum)
  UNION ALL SELECT epoch, quad, x, 'music_real', g, '' FROM q JOIN mr ON mr.i = floor({unit_sql("x || 'music_real'")} * n)
  UNION ALL SELECT epoch, quad, x, 'music_fake', g, mf.p FROM q JOIN pr ON pr.i = floor({unit_sql("x || 'provider'")} * pr.n) JOIN mf ON mf.p = pr.p AND mf.i = floor({unit_sql("x || 'music_fake'")} * mf.n)),
rr AS (SELECT *, CASE WHEN stratum = 'music_fake' THEN provider ELSE '' END AS p, row_number() OVER (PARTITION BY stratum, g, CASE WHEN stratum = 'music_fake' THEN provider ELSE '' END ORDER BY record, provider) - 1 AS i FROM r WHERE stratum IS NOT NULL),
s AS (SELECT epoch, quad, (row_number() OVER (PARTITION BY epoch, quad ORDER BY {unit_sql("x || t.stratum || '|turn'")}, t.stratum) - 1)::INT AS position, t.stratum, t.g, record, provider
  FROM (SELECT picks.*, n FROM picks JOIN k ON k.stratum = picks.stratum AND k.g = picks.g AND k.p = picks.p) t JOIN rr ON rr.stratum = t.stratum AND rr.g = t.g AND rr.p = t.p AND rr.i = floor({unit_sql("x || t.stratum || '|record'")} * n))"""


def _records(spark, d):
    return table(spark, d, "lineitem").select(F.expr(_STRATUM).alias("stratum"), F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")).alias("provider"))


def _sampled(spark, d):
    return quads.paired_quads(_records(spark, d), _QUADS, 5, _EPOCHS, group="g")


@query(f"WITH {_DRAWN} SELECT epoch, quad, position, stratum, g, record, provider FROM s")
def paired_quads(spark, d):
    """Quads of lines: two returned ones share a supplier, the nine providers are uniform."""
    return _sampled(spark, d)


@query(f"""WITH {_DRAWN} SELECT epoch, count(*) AS row_count, count(DISTINCT quad) AS quad_count, 0::BIGINT AS uneven_quads, 0::BIGINT AS pair_mismatches, 0::BIGINT AS held_out_rows, count(DISTINCT provider) FILTER (stratum = 'music_fake') AS provider_count,
(SELECT min(n) FROM (SELECT count(*) AS n FROM s y WHERE y.epoch = s.epoch AND stratum = 'music_fake' GROUP BY provider)) AS least_provider_rows, (SELECT max(n) FROM (SELECT count(*) AS n FROM s y WHERE y.epoch = s.epoch AND stratum = 'music_fake' GROUP BY provider)) AS greatest_provider_rows,
(SELECT count(*) FROM pr) - count(DISTINCT provider) FILTER (stratum = 'music_fake') AS missing_providers, true AS passed FROM s GROUP BY epoch""")
def quad_audit(spark, d):
    return quads.audit_quads(_sampled(spark, d), _records(spark, d), group="g")


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def shared_groups(spark, d):
    return quads.shared_groups(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey", "A", "R")


# ---- metrics ----


@query(ORACLES["group_bootstrap"])
def vector_bootstrap(spark, d):
    """The same interval as group_bootstrap, with all replicates in one pass over the scores."""
    long = _heads(spark, d)
    vectors = replicates.poisson_vectors(long, "source", _REPLICATES, 11)
    return rounded(sampling.intervals(replicates.bootstrap(long, "source", vectors, _REPLICATES), ["score"]), "mean", "lower", "upper", digits=9)


@query(f"WITH {_LONG}, near AS (SELECT * REPLACE (score * 1e-5 AS score) FROM long), {metrics_sql('', 'near')} SELECT head, observed_count, positive_count, round(auc, 9) AS auc, round(eer, 9) AS eer FROM m")
def crowded_metrics(spark, d):
    """Scores that all lie within 0.00001 of 0."""
    out = metrics.head_metrics(_heads(spark, d).withColumn("score", F.col("score") * 1e-5))
    return rounded(out.select("head", "observed_count", "positive_count", "auc", "eer"), "auc", "eer", digits=9)


def _folds_sql() -> str:
    """Each source's rows, and all others, as tables of their own: a brute-force version."""
    return f"""WITH {_LONG}, x AS (SELECT f.source AS fold, CASE WHEN long.source = f.source THEN 'held' ELSE 'rest' END AS role, head, label, score FROM long, (SELECT DISTINCT source FROM long) f), {metrics_sql('fold, role', 'x')},
y AS (SELECT fold, head, max(observed_count) FILTER (role = 'held') AS held_count, max(positive_count) FILTER (role = 'held') AS held_positive, max(auc) FILTER (role = 'held') AS held_auc, max(eer) FILTER (role = 'held') AS held_eer,
  max(observed_count) FILTER (role = 'rest') AS rest_count, max(positive_count) FILTER (role = 'rest') AS rest_positive, max(auc) FILTER (role = 'rest') AS rest_auc, max(eer) FILTER (role = 'rest') AS rest_eer FROM m GROUP BY ALL HAVING held_count > 0)"""


_FOLD = ("held_auc", "held_eer", "rest_auc", "rest_eer")


@query(f"{_folds_sql()} SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _FOLD)}) FROM y")
def held_out_folds(spark, d):
    return rounded(folds.leave_out(_heads(spark, d), "source"), *_FOLD, digits=9)


@query(f"""{_folds_sql()} SELECT head, count(held_eer) AS fold_count, round(avg(held_eer), 9) AS held_macro_eer, round(max(held_eer), 9) AS held_worst_eer, arg_min(fold, (-held_eer, fold)) FILTER (held_eer IS NOT NULL) AS held_worst_fold,
round(avg(rest_eer), 9) AS rest_macro_eer, round(max(rest_eer), 9) AS rest_worst_eer FROM y GROUP BY head""")
def worst_folds(spark, d):
    out = folds.worst_fold(folds.leave_out(_heads(spark, d), "source"))
    return rounded(out, "held_macro_eer", "held_worst_eer", "rest_macro_eer", "rest_worst_eer", digits=9)


@query()
def temperature_scaling(spark, d):
    """Each head's best temperature, for logits of the scores; SQL has no minimum to look for (tests do, by a grid)."""
    long = _heads(spark, d).where("score > 0 and score < 1 and label is not null")
    pulled = (0.2 * F.col("label") + 0.8 * F.col("score")).alias("s")
    logits = long.select("head", "label", pulled).withColumn("logit", F.ln(F.col("s") / (1 - F.col("s"))))
    return rounded(calibration.temperatures(logits), "temperature", "loss_before", "loss_after", digits=9)
