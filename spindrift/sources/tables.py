"""Readers of linkage tables. Columns are strings; a missing value is an empty string, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def _tsv(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    """A tab-separated file with a header. Quoted fields may hold line ends; a file is split among tasks unless one does, which
    shows in a line with an odd number of quotes."""
    open_ = spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    reader = spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', multiLine=open_.limit(1).count() > 0, mode="PERMISSIVE", **options)
    return reader.csv(path)


def read_records(spark: SparkSession, paths: dict[int, str], short_rows: str = "pad", lines: bool = False) -> DataFrame:
    """source, entity_id, business_name, business_address, country of several files, whose headers must have these names. Rows with
    fewer columns are padded with empty strings, or dropped with short_rows="drop". lines: with line, which orders the rows of a file."""
    out = None
    for source, path in paths.items():
        df = _tsv(spark, path, RECORD, enforceSchema=False)
        columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]
        if lines:
            columns.append(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")).alias("line"))
        if short_rows == "drop":
            df = df.where("country is not null")
        one = df.select(F.lit(source).cast("tinyint").alias("source"), *columns)
        out = one if out is None else out.unionByName(one)
    return out


def latest(records: DataFrame, order: str) -> DataFrame:
    """The last row, by a column that gives the order, of each (source, entity_id)."""
    rest = [c for c in records.columns if c not in ("source", "entity_id", order)]
    last = records.groupBy("source", "entity_id").agg(F.max_by(F.struct(order, *rest), order).alias("last"))
    return last.select(*[c if c in ("source", "entity_id") else F.col(f"last.{c}").alias(c) for c in records.columns])


def required_ids(spark: SparkSession, path: str, key: str = "s1_id") -> DataFrame:
    """The first column of a file without its header: distinct, stripped, blank lines skipped."""
    cut = F.trim(F.split("value", "\t")[0])
    lines = spark.read.text(path)
    head = lines.limit(1).select(cut.alias("head")).first()
    ids = lines.select(cut.alias(key)).where(F.col(key) != "").distinct()
    return ids.where(F.col(key) != head["head"]) if head else ids


def match_targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """cand_id of all files of targets."""
    out = required_ids(spark, paths[0], "cand_id")
    for path in paths[1:]:
        out = out.unionByName(required_ids(spark, path, "cand_id"))
    return out


def read_id_lists(spark: SparkSession, path: str, key: str = "s1_id") -> DataFrame:
    """(key, ids) of a two-column file whose second column is a comma list, which may be empty."""
    df = _tsv(spark, path, f"{key} string, ids string")
    ids = F.coalesce("ids", F.lit(""))
    return df.where(F.coalesce(F.trim(key), F.lit("")) != "").select(F.trim(key).alias(key), F.when(ids == "", F.array().cast("array<string>")).otherwise(F.split(ids, ",")).alias("ids"))


def exploded(lists: DataFrame, key: str = "s1_id", member: str = "cand_id") -> DataFrame:
    return lists.select(key, F.explode("ids").alias(member)).distinct()


def read_universe(spark: SparkSession, pattern: str, key: str = "s1_id") -> DataFrame:
    """Distinct first columns of all files that match."""
    lines = spark.read.text(pattern).select(F.trim(F.split("value", "\t")[0]).alias(key))
    return lines.where((F.col(key) != "") & ~F.col(key).isin("source1_entity_id", "entity_id")).distinct()


def read_scores(spark: SparkSession, pattern: str) -> DataFrame:
    return _tsv(spark, pattern, "s1_id string, cand_id string, prob double")


def only(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def _identity(doc_id) -> tuple:
    source = (1 + doc_id % 3).cast("int")
    return source, F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.lpad(doc_id.cast("string"), 8, "0"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Records made of documents: the first 80 characters as the name, the last 120 as the address, the language as the country."""
    source, identifier = _identity(F.col("doc_id"))
    return documents.select(
        source.alias("source"),
        identifier.alias("entity_id"),
        F.substring("text", 1, 80).alias("business_name"),
        F.expr("right(text, 120)").alias("business_address"),
        F.col("lang").alias("country"),
    )


def truth_from_documents(documents: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of documents of equal text and language, the first source being reduced to one document a text."""
    source, identifier = _identity(F.col("doc_id"))
    ids = documents.select(F.sha2("text", 256).alias("digest"), "lang", source.alias("source"), identifier.alias("entity_id"))
    one = ids.where("source = 1").groupBy("digest", "lang").agg(F.min("entity_id").alias("s1_id"))
    return one.join(ids.where("source > 1"), ["digest", "lang"]).select("s1_id", F.col("entity_id").alias("cand_id"))
