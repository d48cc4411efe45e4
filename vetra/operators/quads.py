"""Balanced training order in quads: paired speech and provider-uniform music, drawn by ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.functions.hashing import unit
from vetra.operators.ordinals import numbered
from vetra.storage import stored

# The strata of a quad.
STRATA = ("speech_real", "speech_fake", "music_real", "music_fake")


def shared_groups(df: DataFrame, stratum: str, group: str, a: str, b: str) -> DataFrame:
    """(group) of the groups with rows in both strata."""
    own = df.where(F.col(stratum).isin(a, b) & F.col(group).isNotNull()).groupBy(group)
    return own.agg(F.bool_or(F.col(stratum) == a).alias("a"), F.bool_or(F.col(stratum) == b).alias("b")).where("a and b").select(group)


def _draw(size: Column, *parts: Column) -> Column:
    """A rank below size, by a hash of the parts."""
    return F.floor(unit(F.concat_ws("|", *[p.cast("string") for p in parts])) * size).cast("long")


def paired_quads(df: DataFrame, quads: int, seed: int, epochs: tuple[int, ...] = (0,), stratum: str = "stratum", group: str = "content_group_key", record: str = "record", provider: str = "provider") -> DataFrame:
    """(epoch, quad, position, stratum, group, record, provider): of each epoch so many quads, with a record of each stratum at positions 0 to 3 in an order of its own.

    The two speech records of a quad are of one group, drawn among those that have both. The group of real music is drawn among all; that of generated music after a provider, so
    that providers are uniform. Then a record of the group. All draws are with replacement, by hashes of seed, epoch, quad and what is drawn, so another
    epoch gives another order and the same one the same. Draws are ranks: groups and providers are numbered by ranges of their names, and only the records of drawn
    groups are shuffled and numbered. A stratum is never one row or one task. Rows with a null or other stratum, group or record are left out; a null provider is one of its own.
    Without paired groups, or without a stratum, it fails.
    """
    own = df.where(F.col(stratum).isin(*STRATA) & F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(stratum).alias("stratum"), F.col(group).alias("group"), F.col(record).alias("record"), F.coalesce(F.col(provider).cast("string"), F.lit("")).alias("provider"))
    kinds = stored(own.groupBy("stratum", "group", F.when(F.col("stratum") == "music_fake", F.col("provider")).otherwise("").alias("provider")).agg(F.count("*").alias("size")), "quad-groups")
    pairs = numbered(shared_groups(kinds, "stratum", "group", STRATA[0], STRATA[1]), [F.col("group")], name="rank", base=0)
    real = numbered(kinds.where("stratum = 'music_real'").select("group"), [F.col("group")], name="rank", base=0)
    fake = numbered(kinds.where("stratum = 'music_fake'").select("provider", "group"), [F.col("group")], ["provider"], "rank", 0, "groups")
    providers = numbered(fake.select("provider", "groups").distinct(), [F.col("provider")], name="provider_rank", base=0)
    sizes = {"pairs": pairs.count(), "real": real.count(), "providers": providers.count()}
    if not all(sizes.values()):
        raise ValueError(f"nothing to draw from: {sizes}")
    base = df.sparkSession.range(quads).select(F.col("id").alias("quad"), F.explode(F.array(*map(F.lit, epochs))).alias("epoch"))
    key = [F.lit(seed), F.col("epoch"), F.col("quad")]
    drawn = base.select("*", *[_draw(F.lit(sizes[n]), *key, F.lit(what)).alias(f"{n}_rank") for n, what in (("pairs", "speech"), ("real", "music_real"), ("providers", "provider"))])
    speech = drawn.join(pairs.withColumnRenamed("rank", "pairs_rank"), "pairs_rank").select("epoch", "quad", F.explode(F.array(*map(F.lit, STRATA[:2]))).alias("stratum"), "group", F.lit("").alias("provider"))
    music = drawn.join(real.withColumnRenamed("rank", "real_rank"), "real_rank").select("epoch", "quad", F.lit(STRATA[2]).alias("stratum"), "group", F.lit("").alias("provider"))
    of_provider = drawn.join(providers.withColumnRenamed("provider_rank", "providers_rank"), "providers_rank").withColumn("rank", _draw(F.col("groups"), *key, F.lit("music_fake")))
    made = of_provider.join(fake.drop("groups"), ["provider", "rank"]).select("epoch", "quad", F.lit(STRATA[3]).alias("stratum"), "group", "provider")
    picks = stored(speech.unionByName(music).unionByName(made).join(kinds, ["stratum", "group", "provider"]).withColumn("at", _draw(F.col("size"), *key, F.col("stratum"), F.lit("record"))), "quad-picks")
    # only drawn groups' records go on
    records = own.withColumn("of", F.when(F.col("stratum") == "music_fake", F.col("provider")).otherwise(""))
    wanted = records.join(picks.select("stratum", "group", F.col("provider").alias("of")).distinct(), ["stratum", "group", "of"], "left_semi")
    placed = numbered(wanted, [F.col("record"), F.col("provider")], ["stratum", "group", "of"], "at", 0)
    out = picks.withColumnRenamed("provider", "of").join(placed, ["stratum", "group", "of", "at"])
    turn = lambda s: unit(F.concat_ws("|", *[p.cast("string") for p in key], F.lit(s), F.lit("turn")))
    order = F.array_sort(F.array(*[F.struct(turn(s).alias("u"), F.lit(s).alias("s")) for s in STRATA]))
    place = (F.array_position(F.transform(order, lambda x: x["s"]), F.col("stratum")) - 1).cast("int")
    return out.select("epoch", "quad", place.alias("position"), "stratum", F.col("group").alias(group), F.col("record").alias(record), F.nullif("provider", F.lit("")).alias(provider))


def audit_quads(sampled: DataFrame, records: DataFrame, stratum: str = "stratum", group: str = "content_group_key", record: str = "record", provider: str = "provider") -> DataFrame:
    """One row for each epoch: rows, quads, quads that lack or repeat a stratum, quads with speech of two groups, rows that are no record of their stratum and group, providers drawn, their least and greatest counts, and whether all is well.

    records: what may be drawn; a held-out row has no stratum there, or isn't in it. Providers must all be drawn.
    """
    keys = [stratum, group, record]
    known = records.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    marked = sampled.join(known, [F.col(k) == F.col(f"_{k}") for k in keys], "left").withColumn("known", F.col(f"_{record}").isNotNull())
    own = lambda s: F.max(F.when(F.col(stratum) == s, F.col(group)))
    whole = (F.count_distinct(F.when(F.col(stratum).isin(*STRATA), F.col(stratum))) == len(STRATA)) & (F.count("*") == len(STRATA)) & (F.count_distinct("position") == len(STRATA))
    by_quad = marked.groupBy("epoch", "quad").agg(F.count("*").alias("n"), whole.alias("whole"), F.coalesce(own(STRATA[0]) != own(STRATA[1]), F.lit(False)).alias("mismatch"), F.count_if(~F.col("known")).alias("unknown"))
    totals = by_quad.groupBy("epoch").agg(F.sum("n").alias("row_count"), F.count("*").alias("quad_count"), F.count_if(~F.col("whole")).alias("uneven_quads"), F.count_if("mismatch").alias("pair_mismatches"), F.sum("unknown").alias("held_out_rows"))
    drawn = sampled.where(F.col(stratum) == STRATA[3]).groupBy("epoch", F.coalesce(provider, F.lit("")).alias("p")).agg(F.count("*").alias("n"))
    spread = drawn.groupBy("epoch").agg(F.count("*").alias("provider_count"), F.min("n").alias("least_provider_rows"), F.max("n").alias("greatest_provider_rows"))
    due = records.where(F.col(stratum) == STRATA[3]).agg(F.count_distinct(F.coalesce(provider, F.lit(""))).alias("due")).first()["due"]
    out = totals.join(spread, "epoch", "left").withColumn("missing_providers", F.lit(due) - F.coalesce("provider_count", F.lit(0)))
    return out.withColumn("passed", F.expr("uneven_quads = 0 and pair_mismatches = 0 and held_out_rows = 0 and missing_providers = 0"))
