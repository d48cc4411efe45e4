"""URL filtering by pattern rules that are indexed by their rarest literal token, with DataFrame functions only."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, small, stored


class Rule(NamedTuple):
    """A pattern rule. `tokens` are literals without which the pattern can't match: each is a whole token of any URL that fits.

    Of the fitting rules the one of the highest rank judges, and of these the longest name.
    """

    name: str
    action: str
    rank: int
    pattern: str
    tokens: tuple[str, ...]


def prefix_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with `path`. Patterns see host and path, one after the other."""
    name = host + path
    return Rule(name, action, 1, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(t for t in re.split("[^a-z0-9]+", host.lower()) if t))


PREFIX_RULES = (prefix_rule("block", "net", "/"), prefix_rule("allow", "example.net", "/en/"), prefix_rule("block", "example.com", "/de/"), prefix_rule("allow", "org", "/fr/"))
#: The method's own list: what no rule of a higher rank judges.
PATTERN_RULES = (
    Rule("spam-farm", "block", 0, r"(?:^|[./])spam-farm(?:[./]|$)", ("spam", "farm")),
    Rule("cheap-pills", "block", 0, r"(?:^|[./])cheap-pills(?:[./]|$)", ("cheap", "pills")),
    Rule("casino", "block", 0, r"(?:^|[./-])(?:online|best|free)-casino(?:[./-]|$)", ("casino",)),
    Rule("adult-tld", "block", 0, r"^[^/]*\.xxx(?:/|$)", ("xxx",)),
    Rule("download-crack", "block", 0, r"/(?:[^/]*-)?crack-download(?:[./-]|$)", ("crack", "download")),
    Rule("link-farm", "block", 0, r"(?:^|[./])link-?farm-\d+\.", ()),
)
#: Rules that go to every task within the plan; a URL is judged where it is read. More are joined, on the token.
MAPPED_RULES = 1_000
#: Rules that are broadcast; more are joined by a shuffle on the token.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(place), "[^a-z0-9]+"), ""))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def index(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row per rule with its token: of its literals the one in the fewest of the pages' URLs; '' for a rule without, which any URL fetches."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(k, *r[:4], list(r.tokens)) for k, r in enumerate(rules)], "rule_no int, rule string, action string, rank int, pattern string, tokens array<string>")
    tokens = table.select("rule_no", F.explode("tokens").alias("token"))
    own = tokens_of(F.col("place"))
    if len(literals := sorted({t for r in rules for t in r.tokens})) <= MAPPED_RULES:
        own = F.array_intersect(own, _texts(literals))
    seen = pages.select(F.explode(own).alias("token")).join(small(tokens.select("token").distinct(), BROADCAST_ROWS), "token", "left_semi").groupBy("token").count()
    rarest = tokens.join(seen, "token", "left").groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return stored(table.drop("tokens").join(rarest, "rule_no", "left").withColumn("token", F.coalesce("token", F.lit(""))), "rules")


def mapped(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with best, the judging rule (null: none), by a map from tokens to rules that is part of the plan. No row is repeated or moved."""
    by: dict[str, list] = {}
    for r in found.collect():  # MAPPED_RULES at most
        by.setdefault(r.token, []).append(F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.rule)).alias("size"), F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern")))
    place, none = F.col("place"), F.array().cast("array<struct<rank: int, size: int, rule: string, action: string, pattern: string>>")
    always = F.array(*by.pop("")) if "" in by else none
    if by:
        rules = F.create_map(*[x for t, own in by.items() for x in (F.lit(t), F.array(*own))])
        fetched = F.flatten(F.transform(F.array_intersect(tokens_of(place), _texts(sorted(by))), lambda t: F.try_element_at(rules, t)))
        always = F.concat(always, fetched)
    return pages.withColumn("best", F.array_max(F.filter(always, lambda r: F.rlike(place, r["pattern"]))))


def joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """As mapped(), for any number of rules: URLs meet them by their tokens, each of which carries its URL."""
    rows = pages.withColumn("row", F.monotonically_increasing_id())
    fetched = rows.select("row", "page_id", "host", "path", "place", F.explode(F.concat(F.array(F.lit("")), tokens_of(F.col("place")))).alias("token"))
    tried = fetched.join(small(found, BROADCAST_ROWS), "token", "left").where("token = '' or rule is not null")
    best = F.max(F.when(F.expr("rule is not null and rlike(place, pattern)"), F.struct("rank", F.length("rule").alias("size"), "rule", "action")))
    return tried.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], best.alias("best"))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges each URL by the rules that fit it.

    Returns a row per page: page_id, host, path, rule (the judging rule's name, or null), rank (its rank, or null), verdict.

    A URL's tokens fetch the rules that are indexed under them; only these rules' patterns run, on host and path. Up to MAPPED_RULES rules go with the plan, and each URL
    is judged where it is read, in time that grows with its length; more are joined.

    A null URL, or one without ://, has an empty host and path, which no rule here fits. Repeated rows are judged each. A very
    long URL is judged whole. An empty table gives no rows.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("place", F.concat("host", "path"))
    found = index(pages, rules)
    out = mapped(pages, found) if len(rules) <= MAPPED_RULES else joined(pages, found)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rank").alias("rank"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict", F.when(F.col("rank") == 0, F.col("rule")).alias("pattern_rule"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, h, pre, act) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
j AS (SELECT page_id, host, path, rule, act FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1),
m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(host || path, '(?:^|[./])link-?farm-\d+\.') THEN 'link-farm'
  WHEN regexp_matches(host || path, '/(?:[^/]*-)?crack-download(?:[./-]|$)') THEN 'download-crack'
  WHEN regexp_matches(host || path, '(?:^|[./])cheap-pills(?:[./]|$)') THEN 'cheap-pills'
  WHEN regexp_matches(host || path, '(?:^|[./])spam-farm(?:[./]|$)') THEN 'spam-farm'
  WHEN regexp_matches(host || path, '^[^/]*\.xxx(?:/|$)') THEN 'adult-tld'
  WHEN regexp_matches(host || path, '(?:^|[./-])(?:online|best|free)-casino(?:[./-]|$)') THEN 'casino' END AS pattern_rule FROM j)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern_rule FROM m
"""
