"""Features of a candidate among its rivals for the same record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank_and_best(value: Column, *group: str) -> tuple[Column, Column]:
    """Rank by falling value, ties by target id, and the group's best."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(value.desc(), F.col("t"))), F.max(value).over(Window.partitionBy(*group))


def context_base(scored: DataFrame) -> DataFrame:
    """scored(q, t, p1) with seven features: rank, ratio to the best, gap, count, count above one half, sum."""
    every = Window.partitionBy("q")
    order = every.orderBy(F.col("p1").desc(), "t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.max("p1").over(every)
    second = F.coalesce(F.nth_value("p1", 2).over(whole), F.lit(0.0))
    rank = F.row_number().over(order)
    return scored.withColumns(
        {
            "p1_rank": rank,
            "p1_ratio": F.when(top > 0, F.col("p1") / top).otherwise(0.0),
            "p1_gap": F.when(rank == 1, F.col("p1") - second).otherwise(F.col("p1") - top),
            "n_cands": F.count(F.lit(1)).over(every),
            "n_likely": F.sum((F.col("p1") > 0.5).cast("long")).over(every),
            "p1_sum": F.sum("p1").over(every),
        }
    )


def context_extra(scored: DataFrame) -> DataFrame:
    """scored(q, t, p1, cand_source, r_addr_tset, r_name_tset, addr_word_ovl, r_phon) with eight more features; gaps are what the best has more."""
    source_rank, _ = _rank_and_best(F.col("p1"), "q", "cand_source")
    top = F.max("p1").over(Window.partitionBy("q"))
    out = scored.withColumn("src_rank", source_rank).withColumn("__near", (F.col("p1") >= top - 0.1).cast("long"))
    out = out.withColumn("amb_count", F.sum("__near").over(Window.partitionBy("q"))).drop("__near")
    for field, name in (("r_addr_tset", "addr_tset"), ("r_name_tset", "name_tset"), ("addr_word_ovl", "addr_ovl"), ("r_phon", "phon")):
        rank, best = _rank_and_best(F.col(field), "q")
        out = out.withColumn(f"{name}_gap", best - F.col(field))
        if name in ("addr_tset", "name_tset"):
            out = out.withColumn(f"{name}_rank", rank)
    return out


#: Names of what the two functions add, the score included.
BASE = ["p1", "p1_rank", "p1_ratio", "p1_gap", "n_cands", "n_likely", "p1_sum"]
EXTRA = ["src_rank", "amb_count", "addr_tset_gap", "addr_tset_rank", "name_tset_gap", "name_tset_rank", "addr_ovl_gap", "phon_gap"]


def context_features(scored: DataFrame, extra: bool = False) -> DataFrame:
    return context_extra(context_base(scored)) if extra else context_base(scored)
