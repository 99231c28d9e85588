"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight; a source stops at max_epochs times its own size and what it leaves goes to the
others by weight, until none is above. With the sources ordered by cap / weight, the level of the fill has a closed
form, so the loop over sources needs no driver iteration and uses integer sums only.

A source is then repeated whole as often as its target allows, and a seeded sample makes up the fraction: the
documents in the order of a keyed hash, up to the size still needed. The cut in that order is found from sums by hash
bucket; only the documents of the one bucket that holds the cut are ranked, so no window spans a source.

Null sources form a source of their own, the last. Null and empty texts have size 0 and are taken 0 words.
Rows with the same id, text and source are interchangeable. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_BITS = 12
#: Sources are rows of metadata; the table is joined by broadcast only up to this many, by a plain join beyond.
BROADCAST_SOURCES = 50_000


def draw(key: Column, seed: int) -> Column:
    """A number of 60 bits from the seed and the key, the same in every engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sources(source, source_size) with weight and target.

    One row per source: the two global windows below are over metadata, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).cast("long")
    df = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = (
        df.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # A source is full if it is so at the level reached when all before it are full.
    df = df.withColumn("full", F.col("cap") * F.col("weight_from") <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    share = (F.col("weight") * (F.col("total") - full_cap)).cast("double") / open_weight.cast("double")
    return df.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """One row per row of docs, all its columns under `row`, and size, source_size, target, repeats, taken."""
    spark = docs.sparkSession
    row = docs.select(F.struct("*").alias("row"))
    field = lambda name: F.col("row").getField(name)
    # Two words of hash keep repeated ids apart by content, so that reruns and re-ordered input agree.
    slim = docs.select(
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        draw(F.col(id_col), seed).alias("u"),
        F.xxhash64(F.col(text)).alias("v"),
    ).withColumn("bucket", F.shiftright("u", 60 - BUCKET_BITS))
    sums = materialize(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    sources = fill(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    # The whole repetitions, and the size that the fraction must add.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_SOURCES else df
    n_sources = sources.count()
    # Size before each bucket; the cut lies in the one bucket that takes the sum past the need.
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    joined = small(sources, n_sources).withColumnRenamed("source", "s")
    cut = (
        buckets.join(joined, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("size")))
        .select("s", "bucket", "before", "need")
    )
    equal = slim.join(small(cut.withColumnRenamed("bucket", "cut"), n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut")))
    equal = equal.where("size > 0").groupBy("s", "before", "need", "u", "v").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("all"))
    ranked = Window.partitionBy("s").orderBy("u", "v").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("need") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("all")).over(ranked), F.lit(0))
    # A row goes in if its middle does.
    equal = equal.withColumn("some", F.least(F.col("all"), F.floor(room / F.col("size") + 0.5).cast("long"))).where("some > 0")
    # The last rows that go in, and how many of them: the mix takes all below.
    last = equal.groupBy("s").agg(F.max(F.struct("u", "v", "some", "all")).alias("last"))
    cuts = materialize(
        sources.withColumnRenamed("source", "s1")
        .join(cut.select(F.col("s").alias("s2"), "bucket"), F.col("s1").eqNullSafe(F.col("s2")), "left")
        .join(last.withColumnRenamed("s", "s3"), F.col("s1").eqNullSafe(F.col("s3")), "left")
        .select("s1", "source_size", "target", "whole", "bucket", "last")
    )
    full = (
        row.withColumn("source", field(source).cast("string"))
        .withColumn("size", F.regexp_count(F.coalesce(field(text), F.lit("")), F.lit(WORD)).cast("long"))
        .withColumn("u", draw(field(id_col), seed))
        .withColumn("v", F.xxhash64(field(text)))
        .join(small(cuts, n_sources), F.col("source").eqNullSafe(F.col("s1")))
    )
    below = F.shiftright("u", 60 - BUCKET_BITS) < F.col("bucket")
    here = F.struct("u", "v")
    upto = F.struct("last.u", "last.v")
    split = F.coalesce((here == upto) & (F.col("last.some") < F.col("last.all")), F.lit(False))
    extra = F.coalesce(F.col("bucket").isNotNull() & (below | (here <= upto)), F.lit(False))
    if cuts.where("last.some < last.all").limit(1).count():
        among = _first_of_equal(materialize(full.where(split).withColumn("at", F.monotonically_increasing_id())), lambda df: small(df, n_sources))
        full = full.where(~split).withColumn("extra", extra).unionByName(among)
    else:
        full = full.withColumn("extra", extra)
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(0).cast("long")
    return full.withColumn("repeats", repeats).select("row", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def _first_of_equal(rows: DataFrame, small) -> DataFrame:
    """rows with extra: whether they are among the first last.some of their source by `at`, a number that grows within a
    partition and from one to the next. Partitions are counted, and only the one with the cut is ranked."""
    part = F.shiftright("at", 33)
    counts = rows.groupBy("s1", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("last.some").alias("some"))
    running = Window.partitionBy("s1").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("left", F.col("some") - F.coalesce(F.sum("n").over(running), F.lit(0)))
    at_cut = materialize(counts.where("left > 0 and left <= n").select(F.col("s1").alias("s4"), "part", "left"))
    mine = rows.join(small(at_cut), F.col("s1").eqNullSafe(F.col("s4")) & (part == F.col("part"))).select("s4", "left", "at")
    place = F.row_number().over(Window.partitionBy("s4").orderBy("at"))
    upto = materialize(mine.withColumn("place", place).where("place = left").select(F.col("s4").alias("s5"), F.col("at").alias("upto")))
    joined = rows.join(small(upto), F.col("s1").eqNullSafe(F.col("s5")))
    return joined.withColumn("extra", F.col("at") <= F.col("upto")).drop("at", "s5", "upto")
