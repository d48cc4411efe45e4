"""Named queries that write a table in a format and read it again, with SQL over the table; and runs over written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.plans import loading
from vetra.plans.queries import training_manifest
from vetra.plans.registry import ORACLES, query, rounded, table
from vetra.sources import files, sinks, tables
from vetra.storage import shared_dir
from vetra.streaming import refreshed, resume, runs


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, **options: str) -> str:
    df.write.options(**options).text(path)
    return path


_PARTS = "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@query(f"{_PARTS} UNION ALL {_PARTS}")
def csv_files(spark, d):
    """Parts as CSV with a header, plain and by gzip, read again as text."""
    plain, packed = place(spark, "csv"), place(spark, "csv-gz")
    sinks.write_csv(_parts(spark, d), plain)
    _parts(spark, d).select(*[F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand", "p_size")]).write.option("compression", "gzip").option("escape", '"').csv(packed, header=True)
    return tables.csv(spark, plain, ["p_partkey", "p_name", "p_brand", "p_size"]).unionByName(tables.csv(spark, packed, partitions=4))


@query("SELECT c_custkey, c_acctbal < 0 AS owes, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer")
def csv_normal_values(spark, d):
    """Nulls as empty, booleans in lower case, only the fields asked for; keys cast when read."""
    path = place(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("owes"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.lit("x").alias("more"))
    sinks.write_csv(c, path, ["c_custkey", "owes", "name"])
    return tables.csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), (F.col("owes") == "true").alias("owes"), "name")


@query("SELECT count(*) AS row_count, count(DISTINCT line_number) AS lines, min(line_number) AS first_line, max(line_number) AS last_line FROM (SELECT row_number() OVER () + 1 AS line_number FROM orders)")
def numbered_lines(spark, d):
    """Orders as one CSV file, read with line numbers."""
    path = place(spark, "numbered")
    sinks.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, one_file=True)
    rows = tables.numbered_csv(spark, path, ["o_orderkey", "o_custkey"], multiline=False)
    return rows.agg(F.count("*").alias("row_count"), F.count_distinct("line_number").alias("lines"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))


@query("SELECT 'good' AS kind, count(*) AS n, sum(s_suppkey)::BIGINT AS total FROM supplier WHERE s_suppkey % 4 > 0 UNION ALL SELECT 'bad', count(*), 2 * count(*) FROM supplier WHERE s_suppkey % 4 = 0")
def piped_lines(spark, d):
    """Suppliers between bars, a quarter of the lines broken."""
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 4 > 0, F.concat_ws("|", "s_suppkey", "s_name", "s_nationkey")).otherwise(F.concat_ws("|", "s_suppkey", "s_name")).alias("value"))
    good, bad = tables.piped(spark, _lines(s, place(spark, "piped")), ["key", "name", "nation"])
    n = lambda df, kind, c: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(c).cast("long").alias("total"))
    return n(good, "good", F.col("key").cast("long")).unionByName(n(bad, "bad", F.col("field_count")))


@query("SELECT n_nationkey AS track_id, n_name AS title, n_regionkey::VARCHAR AS split FROM nation")
def two_level_header(spark, d):
    """Nations under a header of three lines."""
    head = spark.createDataFrame([(0, ",track,set"), (1, ",title,split"), (2, "track_id,,")], "at int, value string")
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 3).cast("int").alias("at"), F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    path = _lines(head.unionByName(n).coalesce(1).sortWithinPartitions("at").select("value"), place(spark, "levels"))
    out = tables.two_level_csv(spark, path)
    return out.select("track_id", F.col("`track.title`").alias("title"), F.col("`set.split`").alias("split"))


@query("SELECT 'docs/' || doc_id || '.txt' AS name, sha256(text) AS digest FROM documents")
def checksum_lines(spark, d):
    """A list of digests as checksum tools write it, with stars and backslashes."""
    docs = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)), F.when(F.col("doc_id") % 3 == 0, " *docs\\").otherwise("  docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("value"))
    return tables.checksum_list(spark, _lines(docs, place(spark, "sums")))


@query("SELECT 'good' AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_id % 10 > 0 UNION ALL SELECT 'bad', count(*), NULL FROM events WHERE event_id % 10 = 0")
def json_line_files(spark, d):
    """Events as JSON lines with sorted keys, a tenth of them cut short."""
    e = sinks.json_rows(table(spark, d, "events").select("event_id", "event_type", "value")).withColumn("id", F.get_json_object("value", "$.event_id").cast("long"))
    cut = e.select(F.when(F.col("id") % 10 > 0, F.col("value")).otherwise(F.expr("substring(value, 1, 12)")).alias("value"))
    good, bad = tables.json_lines(spark, _lines(cut, place(spark, "json")), "event_id long, event_type string, value double")
    out = good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 = 3")
def rows_by_ordinal(spark, d):
    """Documents in one Parquet file, of which some rows are taken by their places."""
    path = place(spark, "ordinals")
    table(spark, d, "documents").select("doc_id", "n_chars").coalesce(1).sortWithinPartitions("doc_id").write.parquet(path)
    rows = tables.parquet_with_ordinals(spark, path, ["doc_id", "n_chars"])
    return rows.where("row_in_file % 10 = 3").select("doc_id", "n_chars")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def parquet_shards(spark, d):
    """Documents as a shard for each language, of one schema, of which two columns are read."""
    base = place(spark, "shards")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    for lang in ("en", "de", "fr", "es"):
        docs.where(F.col("lang") == lang).write.parquet(f"{base}/{lang}")
    docs.where("lang not in ('en', 'de', 'fr', 'es')").write.parquet(f"{base}/others")
    return tables.parquet(spark, [f"{base}/{x}" for x in ("en", "de", "fr", "es", "others")], ["lang", "n_chars"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT 8 AS files, count(*) AS row_count, 0::BIGINT AS missing_rows FROM orders")
def file_listing(spark, d):
    """Orders in eight files, listed without their contents; a table that isn't there has no rows."""
    path = place(spark, "listing")
    table(spark, d, "orders").select("o_orderkey").repartition(8, "o_orderkey").write.parquet(path)
    n = files.listing(spark, path, "*.parquet").agg(F.count("*").cast("int").alias("files"))
    none = tables.csv_if_there(spark, f"{path}-none", ["a"]).agg(F.count("*").alias("missing_rows"))
    counted = spark.read.parquet(path).agg(F.count("*").alias("row_count"))
    row = lambda df: df.withColumn("_one", F.lit(1))
    return row(n).join(row(counted), "_one").join(row(none), "_one").drop("_one")


@query("SELECT user_id, count(*) AS event_count, round(sum(value), 3) AS total, max(ts) AS last_ts FROM events GROUP BY user_id")
def streamed_events(spark, d):
    """Events in files, worked off by a stream in batches that are committed once, in two runs."""
    source, sink, state = place(spark, "events"), place(spark, "sink"), place(spark, "state")
    e = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).repartition(3, "event_id").write.mode("append").parquet(source)
        runs.ended(runs.run_stream(spark, e.schema, source, sink, f"{sink}-checkpoint", state, f"run-{uuid.uuid4().hex}", files_at_once=2))
    return rounded(spark.read.parquet(sink).groupBy("user_id").agg(F.count("*").alias("event_count"), F.sum("value").alias("total"), F.max("ts").alias("last_ts")), "total", digits=3)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 50 = 0 AND o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders) GROUP BY ALL")
def refreshed_counts(spark, d):
    """Orders by priority, of which one partition is refreshed in place; the counts are adjusted by the difference."""
    path = place(spark, "orders")
    keys = ["o_orderstatus", "o_orderpriority"]
    o = table(spark, d, "orders").select("o_orderkey", *keys)
    o.write.partitionBy("o_orderpriority").parquet(path)
    new = o.where("o_orderkey % 50 = 0 and o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    _, counts = refreshed.refresh_partitions(spark, path, "o_orderpriority", new, "o_orderkey", ["o_orderstatus"], {"by": (o.groupBy(*keys).agg(F.count("*").alias("n")), keys)})
    return counts["by"]


@query("SELECT o_orderkey, o_custkey FROM orders")
def appended_in_two_runs(spark, d):
    """Orders appended to a table in two runs, of which the second adds what the first left."""
    path = place(spark, "appended")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    resume.append_pending(spark, o.where("o_orderkey % 3 = 0"), path, ["o_orderkey"], lambda df: df)
    resume.append_pending(spark, o, path, ["o_orderkey"], lambda df: df)
    return spark.read.parquet(path)


@query(f"""WITH m AS ({ORACLES["training_manifest"]}), own AS (SELECT * FROM m WHERE recommended_content_split <> 'test'),
h AS (SELECT recommended_content_split AS split, dataset, unnest(['FILE_FAKE', 'VOICE_FAKE', 'MUSIC_FAKE', 'VOICE_PRESENT', 'MUSIC_PRESENT']) AS head,
  unnest(CASE dataset WHEN 'ljspeech-1.1' THEN [0, 0, NULL, 1, 0] WHEN 'wavefake-1.2.0' THEN [1, 1, NULL, 1, 0] WHEN 'fma-small' THEN [0, NULL, 0, NULL, 1] ELSE [1, NULL, 1, 0, 1] END) AS y FROM own)
SELECT split, dataset, head, count(*) AS row_count, count(y) AS observed_count, coalesce(sum(y), 0)::BIGINT AS positive_count, 0::BIGINT AS fault_count, (SELECT count(*) FROM (SELECT content_group_key FROM m GROUP BY 1 HAVING count(DISTINCT recommended_content_split) > 1)) AS crossing_count FROM h GROUP BY ALL""")
def loaded_manifest(spark, d):
    """The training manifest loaded as one plan: rows and labels of each split, dataset and head, with the faults and the groups across splits."""
    got = loading.load(training_manifest(spark, d))
    heads = got.train.unionByName(got.validation).groupBy(F.col("recommended_content_split").alias("split"), "dataset", "head")
    out = heads.agg(F.count("*").alias("row_count"), F.count("head_label").alias("observed_count"), F.coalesce(F.sum("head_label"), F.lit(0.0)).cast("long").alias("positive_count"))
    row = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(row(got.faults, "fault_count"), "_one").join(row(got.crossings, "crossing_count"), "_one").drop("_one")
