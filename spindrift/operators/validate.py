"""Checks of result files, as a table of (rule, severity, n, example): example names up to five cases, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5
ERRORS = ("comma_instead_of_tab", "header", "row_without_tab", "duplicate_row", "repeated_id", "self_match", "bad_prefix", "unknown_id", "missing_row", "unexpected_row", "not_utf8", "empty_file", "missing_file")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of a text file, or of all files in a folder; line 0 is the header, the first line of each file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("place"))
    first = F.broadcast(lines.groupBy("file").agg(F.min("place").alias("first")))  # a row a file
    return lines.join(first, "file").select(F.when(F.col("place") == F.col("first"), 0).otherwise(F.col("place.at") + 1).alias("line_no"), "line")


def validate_lines(lines: DataFrame, required: DataFrame, header: tuple[str, str], valid_ids: DataFrame | None = None, matches_within: DataFrame | None = None) -> DataFrame:
    """lines(line_no, line); required(s1_id). matches_within(s1_id, cand_id): pairs that these must be among, else a warning."""
    first = lines.where("line_no = 0").select("line")
    body = lines.where("line_no > 0").where(F.trim("line") != "")
    cut = F.split("line", "\t")
    rows = body.where(F.instr("line", "\t") > 0).select(F.trim(cut[0]).alias("s1_id"), F.trim(cut[1]).alias("ids"))
    members = rows.where("ids <> ''").select("s1_id", F.posexplode(F.split("ids", ",")).alias("pos", "raw")).select("s1_id", F.trim("raw").alias("cand_id"))
    expected = "\t".join(header)
    found = [
        ("comma_instead_of_tab", "error", first.where((F.instr("line", "\t") == 0) & (F.instr("line", ",") > 0)).select(F.col("line").alias("x"))),
        ("header", "error", first.where((F.trim("line") != expected) & ~((F.instr("line", "\t") == 0) & (F.instr("line", ",") > 0))).select(F.col("line").alias("x"))),
        ("not_utf8", "error", lines.where((F.instr("line", "�") > 0) | ~F.is_valid_utf8("line")).select(F.col("line").alias("x"))),
        ("row_without_tab", "error", body.where(F.instr("line", "\t") == 0).select(F.col("line").alias("x"))),
        ("duplicate_row", "error", rows.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x"))),
        ("repeated_id", "error", members.groupBy("s1_id", "cand_id").count().where("count > 1").select("s1_id").distinct().select(F.col("s1_id").alias("x"))),
        ("self_match", "error", members.where("cand_id like 'S1-%'").select(F.col("cand_id").alias("x"))),
        ("bad_prefix", "error", members.where("not cand_id like 'S1-%' and not cand_id like 'S2-%' and not cand_id like 'S3-%'").select(F.col("cand_id").alias("x"))),
        ("missing_row", "error", required.select("s1_id").join(rows, "s1_id", "left_anti").select(F.col("s1_id").alias("x"))),
        ("unexpected_row", "error", rows.join(required, "s1_id", "left_anti").select(F.col("s1_id").alias("x"))),
    ]
    if valid_ids is not None:
        good = members.where("cand_id like 'S2-%' or cand_id like 'S3-%'")
        found.append(("unknown_id", "error", good.join(valid_ids.select("cand_id"), "cand_id", "left_anti").select(F.col("cand_id").alias("x"))))
    if matches_within is not None:
        found.append(("not_a_candidate", "warning", members.join(matches_within, ["s1_id", "cand_id"], "left_anti").select(F.col("s1_id").alias("x"))))
    out = None
    for rule, severity, bad in found:
        # A bounded list: the first few of each task, then of these.
        few = bad.select("x").distinct().orderBy("x").limit(EXAMPLES).agg(F.collect_list("x").alias("few"))
        few = few.select(F.when(F.size("few") > 0, F.array_join(F.array_sort("few"), ", ")).alias("example"))
        one = bad.agg(F.count(F.lit(1)).alias("n")).crossJoin(few).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "example")
        out = one if out is None else out.unionByName(one)
    return out


def passes(report: DataFrame) -> bool:
    return report.where("severity = 'error' and n > 0").limit(1).count() == 0


def empty_file(lines: DataFrame) -> bool:
    return lines.limit(1).count() == 0


def _one(spark: SparkSession, rule: str, severity: str, example: str) -> DataFrame:
    return spark.createDataFrame([(rule, severity, 1, example)], "rule string, severity string, n long, example string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def validate_file(spark: SparkSession, path: str, required: DataFrame, header: tuple[str, str], valid_ids: DataFrame | None = None, matches_within: DataFrame | None = None) -> DataFrame:
    """The report of one file: missing, empty, or that of its lines."""
    if not exists(spark, path):
        return _one(spark, "missing_file", "error", path)
    lines = read_lines(spark, path)
    if empty_file(lines):
        return _one(spark, "empty_file", "error", path)
    return validate_lines(lines, required, header, valid_ids, matches_within)


def validate_run(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, valid_ids: DataFrame | None = None) -> DataFrame:
    """(file, rule, severity, n, example) of a matching file and of a candidate file, which may be missing: then a warning."""
    within, report = None, None
    if candidates is not None:
        if exists(spark, candidates):
            from spindrift.sources.tables import exploded, read_id_lists

            report = validate_file(spark, candidates, required, ("source1_entity_id", "candidate_entity_ids"), valid_ids).withColumn("file", F.lit("candidates"))
            within = exploded(read_id_lists(spark, candidates))
        else:
            report = _one(spark, "missing_file", "warning", candidates).withColumn("file", F.lit("candidates"))
    own = validate_file(spark, matching, required, ("source1_entity_id", "matched_entity_ids"), valid_ids, within).withColumn("file", F.lit("matches"))
    return (own if report is None else own.unionByName(report)).select("file", "rule", "severity", "n", "example")
