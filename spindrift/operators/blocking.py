"""Candidates by weighted keys: cheap and expensive tiers, escalation, best candidates of each record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import bucket

ALWAYS = 3


@dataclass(frozen=True)
class Tier:
    """How many keys a record may probe with, and how many rows they may touch."""

    keys: int
    budget: int


CHEAP, EXPENSIVE = Tier(10, 2500), Tier(25, 20_000)


def scored(probe: DataFrame, keys: DataFrame, tier: Tier = CHEAP, min_score: float = 1.0) -> DataFrame:
    """(s1_id, cand_id, source, score): the weights of shared keys, summed; scores below min_score are left out."""
    within = probe.where((F.col("rank") <= tier.keys) & ((F.col("rank") <= ALWAYS) | (F.col("cum_df") <= tier.budget)))
    targets = keys.where("source in (2, 3)").withColumnRenamed("entity_id", "cand_id")
    hits = within.join(targets, ["country", "key_type", "key_value"])
    # Summed in whole millionths: order of addition can't change a sum, nor a rank.
    return hits.groupBy("s1_id", "cand_id", "source").agg((F.sum(F.round(F.col("w") * 1e6).cast("long")) / 1e6).alias("score")).where(F.col("score") >= min_score)


def best(scores: DataFrame, k: int = 25) -> DataFrame:
    """The k best candidates of each record, with their rank."""
    order = Window.partitionBy("s1_id").orderBy(F.col("score").desc(), "cand_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def escalated(probe: DataFrame, keys: DataFrame, universe: DataFrame, k: int = 25, least: int = 8, percent: int = 100) -> DataFrame:
    """Best candidates after a second, expensive look at records with fewer than `least` of them.

    Every starved record gets the second look. A lower `percent` leaves out those whose stable hash bucket isn't below it,
    and so loses their further candidates. Its result replaces the first if it has any.
    """
    cheap = scored(probe, keys, CHEAP)
    counts = cheap.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    starved = universe.select("s1_id").join(counts, "s1_id", "left").where((F.coalesce("n", F.lit(0)) < least) & (bucket(F.col("s1_id")) < percent)).select("s1_id")
    again = scored(probe.join(starved, "s1_id", "left_semi"), keys, EXPENSIVE)
    kept = cheap.join(again.select("s1_id").distinct(), "s1_id", "left_anti")
    return best(kept.unionByName(again), k)
