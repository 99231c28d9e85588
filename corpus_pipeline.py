"""Documents to training tokens: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), and what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, n_chars being that of their text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, mixing, quality_rules, shingle_links, suffix_array
from spindrift.llm.common import materialize


#: A passage of over 50 words is to go where it repeats: of all stretches of 51 words in the test documents 99 in 100 have
#: 240 bytes or more. The residues are a perfect difference set modulo 91.
PASSAGES = {"length": 240, "v": 91, "cover": (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}

#: Documents that near dedup keeps (id and hash, some 70 bytes each) go to the texts by broadcast up to so many; beyond, texts are shuffled to them.
BROADCAST_ROWS = 250_000


def _like(docs: DataFrame, df: DataFrame) -> DataFrame:
    """df, with columns row (all columns of docs but the text) and text, as documents."""
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return df.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality_rules.judge(docs, out="__quality").where("__quality.kept").drop("__quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word similarity 0.8: the one with the least id (null ids last), then the least content hash."""
    found = materialize(shingle_links.components(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("content").alias("content"))
    chosen = found.groupBy("root").agg(F.min(rank).alias("one")).select(F.col("one.id").alias("keep_id"), F.col("one.content").alias("keep_content"))
    chosen = materialize(chosen.distinct())
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    own = docs.withColumn("__content", F.xxhash64("text"))
    kept = own.join(small, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__content") == F.col("keep_content")), "left_semi")
    # Rows repeated with the same id and text are one document too. Only their texts are gathered.
    twice = materialize(kept.groupBy(F.col("doc_id").alias("keep_id"), F.col("__content").alias("keep_content")).count().where("count > 1").drop("count"))
    if twice.isEmpty():
        return kept.drop("__content")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__content") == F.col("keep_content"))
    one = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__content"])
    return kept.join(twice, same, "left_anti").unionByName(one).drop("__content")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without byte strings of a passage's length that repeat; documents of which no word is left go."""
    cut = suffix_array.remove_repeats(docs, as_text=True, **PASSAGES)
    return _like(docs, cut.withColumnRenamed("kept", "text")).where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs).where("repeats > 0")
    repeated = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of what they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("exact dedup", exact_dedup),
    ("mix sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Fingerprints, byte spans and token ids have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
