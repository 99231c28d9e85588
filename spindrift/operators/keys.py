"""Blocking keys, their frequencies and the probe table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.functions.words import KEY_WEIGHTS

CEILING = 25_000
PROBES = 25


def normalized(records: DataFrame, fold=X.fold) -> DataFrame:
    """records with name_norm, addr_norm."""
    return records.withColumn("name_norm", X.name(fold(F.col("business_name")))).withColumn("addr_norm", X.address(fold(F.col("business_address"))))


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("key_type"), v.alias("key_value")))


def blocking_keys(normal: DataFrame) -> DataFrame:
    """source, entity_id, country, key_type, key_value: nine kinds of keys for each record, in one pass without a shuffle."""
    name, addr, raw = F.col("name_norm"), F.col("addr_norm"), F.col("business_address")
    one = lambda value, keep: F.when(keep, F.array(value)).otherwise(F.array().cast("array<string>"))
    ordered, phon = X.sorted_tokens(name), X.name_sound(name)
    keys = F.concat(
        _typed("name_token", X.long_tokens(name)),
        _typed("addr_token", X.long_tokens(addr)),
        _typed("digit_token", X.digits(raw)),
        _typed("postal_token", X.postal(raw)),
        _typed("name_prefix", one(X.prefix(name), F.length(X.prefix(name)) >= 3)),
        _typed("name_full", one(name, name != "")),
        _typed("name_sorted", one(ordered, (ordered != "") & (ordered != name))),
        _typed("name_phon", one(phon, F.length(phon) >= 3)),
        _typed("phon_token", X.sound_tokens(name)),
    )
    return normal.select("source", "entity_id", "country", F.explode(keys).alias("k")).select("source", "entity_id", "country", "k.key_type", "k.key_value")


def key_freq(keys: DataFrame) -> DataFrame:
    """How many target records (sources 2 and 3) have each key, by country."""
    return keys.where("source in (2, 3)").groupBy("country", "key_type", "key_value").agg(F.count(F.lit(1)).alias("df"))


def prune(keys: DataFrame, freq: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """keys without target keys that are more frequent than the ceiling."""
    heavy = freq.where(F.col("df") > ceiling).select("country", "key_type", "key_value")
    targets = keys.where("source in (2, 3)").join(heavy, ["country", "key_type", "key_value"], "left_anti")
    return keys.where("source = 1").unionByName(targets.select(*keys.columns))


def probe_table(keys: DataFrame, freq: DataFrame, corpus: int, ceiling: int = CEILING, probes: int = PROBES) -> DataFrame:
    """For each record of source 1 its rarest keys: weight, rank and running frequency. corpus: target records in all."""
    found = keys.where("source = 1").join(freq.where(F.col("df") <= ceiling), ["country", "key_type", "key_value"])
    order = Window.partitionBy("s1_id").orderBy("df", "key_type", "key_value")
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KEY_WEIGHTS.items() for x in p]), F.col("key_type")), F.lit(1.0))
    out = found.withColumnRenamed("entity_id", "s1_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= probes)
    out = out.withColumn("cum_df", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    weight = prior * (F.log(F.lit(float(max(2, corpus)))) - F.log(F.col("df").cast("double")))
    # Keys that weigh nothing are left out, but have used up a rank.
    return out.withColumn("w", weight).where("w > 0").select("s1_id", "country", "key_type", "key_value", "w", "rank", "cum_df")
