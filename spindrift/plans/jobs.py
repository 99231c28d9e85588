"""The linkage lifecycles: build a store, train, predict, tune. Every step reads Parquet and writes Parquet.

A step whose output has a _SUCCESS file is complete, so a run that broke off goes on at the first step without one.
"""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import blocking, channels, decide, features, keys, metrics, model, validate
from spindrift.operators.decide import Rule
from spindrift.sources import sinks, tables
from spindrift.sources.scratch import materialize

SCORE_FLOOR = {"keys": 0.05, "channels": 0.02}
#: Stable buckets below this are held out.
VALIDATION = 15
MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


class Store:
    """The Parquet tables of one split, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self, name: str) -> bool:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def step(self, name: str, make, by: str | None = None, again: bool = False) -> DataFrame:
        """The table of a step, made if it is missing or if `again`."""
        if again or not self.done(name):
            writer = make().write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return self.table(name)


def build(store: Store, paths: dict[int, str], fold=X.transliterate) -> None:
    """Records, normal forms, keys, frequencies and the probe table of three sources. Forms are partitioned by country.

    Of records with one id the last row counts, but the keys of all its rows do. fold: transliterate takes any
    script; X.fold stays in the JVM but knows Latin letters only.
    """
    rows = store.step("rows", lambda: tables.read_records(store.spark, paths, lines=True))
    records = store.step("records", lambda: tables.latest(rows, "line").drop("line"))
    store.step("keys", lambda: keys.blocking_keys(keys.normalized(rows, fold)))
    store.step("tokens", lambda: features.record_tokens(keys.normalized(records, fold)))
    store.step("forms", lambda: channels.linked_forms(records, fold), by="country")
    refresh(store, again=False)


def refresh(store: Store, again: bool = True, stats: bool = True) -> None:
    """Frequencies and probe table from the stored keys, without reading the sources."""
    made = store.table("keys")
    freq = store.step("key_freq", lambda: keys.key_freq(made), again=again and stats)
    targets = store.table("records").where("source > 1").count()
    store.step("probe", lambda: keys.probe_table(made, freq, targets), again=again)


def universe(store: Store) -> DataFrame:
    return store.table("records").where("source = 1").select(F.col("entity_id").alias("s1_id"), "country").distinct()


def part_of_universe(store: Store, countries: list[str] | None = None, shard: int = 0, shards: int = 1, listed: DataFrame | None = None, select: str = "all") -> DataFrame:
    """Records of source 1 by country, by shard (a hash of the id), by a list of s1_id, or of the validation buckets (select="val")."""
    ids = universe(store)
    if countries is not None:
        ids = ids.where(F.col("country").isin(countries))
    if listed is not None:
        ids = ids.join(listed.select("s1_id").distinct(), "s1_id", "left_semi")
    if select == "val":
        ids = ids.where(X.bucket(F.col("s1_id")) < VALIDATION)
    return ids.where(F.pmod(F.xxhash64("s1_id"), F.lit(shards)) == shard) if shards > 1 else ids


def key_candidates(store: Store, k: int = 25, percent: int = 100, ids: DataFrame | None = None) -> DataFrame:
    """The k best candidates by keys of all records of source 1, kept in the store, or of ids."""
    probe = store.table("probe") if ids is None else store.table("probe").join(ids.select("s1_id"), "s1_id", "left_semi")
    make = lambda: blocking.escalated(probe, store.table("keys"), universe(store) if ids is None else ids, k, percent=percent)
    return store.step(f"candidates_{k}", make) if ids is None else materialize(make())


def channel_pairs(store: Store, max_df: float = 0.02, with_keys: bool = False) -> DataFrame:
    """The union of the channels; with the key candidates as a fifth one if wanted."""
    c1 = key_candidates(store, 100) if with_keys else None
    return store.step("union", lambda: channels.union(channels.channels(store.table("forms"), max_df), c1))


def pair_rows(store: Store, max_df: float = 0.02, with_keys: bool = False) -> DataFrame:
    return store.step("features", lambda: features.pair_features(channel_pairs(store, max_df, with_keys), store.table("forms")))


def key_rows(store: Store, k: int = 25, ids: DataFrame | None = None) -> DataFrame:
    """(q, t) and the first generation's features of all key candidates, kept in the store, or of those of ids."""
    make = lambda: features.key_features(key_candidates(store, k, ids=ids), store.table("tokens")).withColumnsRenamed({"s1_id": "q", "cand_id": "t"})
    return store.step(f"key_features_{k}", make) if ids is None else materialize(make())


def _save(store: Store, models: str, stages: dict[str, PipelineModel | None], report: dict) -> dict:
    for name, one in stages.items():
        if one is not None:
            one.write().overwrite().save(f"{models}/{name}")
    store.spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{models}/report")
    return report


def _parts(store: Store, rows: DataFrame, truth: DataFrame, n_val: int, n_fit: int):
    """Labelled rows of the fitting and of the validation entities; the latter's ids and truth."""
    parts = model.split(universe(store), n_val, n_fit)
    rows = model.labelled(rows, truth)
    of = lambda part: rows.join(parts.where(F.col("part") == part).select(F.col("s1_id").alias("q")), "q", "left_semi")
    ids = parts.where("part = 'val'").select("s1_id")
    return of("fit"), of("val"), ids, truth.join(ids, "s1_id", "left_semi")


def train(store: Store, truth: DataFrame, models: str, n_val: int, n_fit: int, max_df: float = 0.02, rules: list[Rule] | None = None, extra: bool = False, with_keys: bool = False, **kw) -> dict:
    """Both stages on the fitting entities; the second is kept only if it decides better on the validation entities."""
    fit, val, ids, own = _parts(store, pair_rows(store, max_df, with_keys), truth, n_val, n_fit)
    first, second = model.two_stages(fit, features.PAIR_FEATURES, extra, **kw)
    best, report = None, {}
    for stages, name in (((first, None), "stage1"), ((first, second), "stage2")):
        top = decide.grid(model.score_pairs(stages, val, extra), own, ids, rules or decide.rules_of("channels", (False, True))).first()
        report[f"{name}_f05"] = top["f05"]
        if best is None or top["f05"] > best[0]["f05"]:
            best = (top, stages)
    report |= {"best": best[0].asDict(), "two_stage": best[1][1] is not None, "ctx_extra": extra, "features": features.PAIR_FEATURES, "max_df": max_df}
    report |= {"importance": model.importance(first, features.PAIR_FEATURES), "topk": channels.TOP, "qkeep": channels.KEEP, "with_keys": with_keys}
    return _save(store, models, {"stage1": first, "stage2": best[1][1]}, report)


def train_keys(store: Store, truth: DataFrame, models: str, n_val: int, n_fit: int, k: int = 25, rules: list[Rule] | None = None, **kw) -> dict:
    """The first generation: one model over the key candidates' features, its rule chosen on the validation entities."""
    fit, val, ids, own = _parts(store, key_rows(store, k), truth, n_val, n_fit)
    made = model.train(fit, features.KEY_FEATURES, **kw)
    top = decide.grid(model.score_pairs((made, None), val), own, ids, rules or decide.rules_of("keys")).first()
    found = val.agg(F.sum("label").alias("n")).first()["n"] or 0.0
    report = {"best": top.asDict(), "features": features.KEY_FEATURES, "top_k": k, "two_stage": False, "recall_ceiling": found / max(1, own.distinct().count())}
    return _save(store, models, {"stage1": made}, report | {"importance": model.importance(made, features.KEY_FEATURES)})


def load_models(spark: SparkSession, models: str) -> tuple[tuple[PipelineModel, PipelineModel | None], dict]:
    report = json.loads(spark.read.text(f"{models}/report").first()[0])
    second = PipelineModel.load(f"{models}/stage2") if report["two_stage"] else None
    return (PipelineModel.load(f"{models}/stage1"), second), report


def _listed(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Lists by falling score, ties to the larger id."""
    best = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("prob").desc(), F.col("cand_id").desc()))
    return sinks.id_lists(pairs.withColumn("rank", best), ids).join(ids.select("s1_id", "country"), "s1_id")


def write_results(out: str, scored: DataFrame, rule: Rule, ids: DataFrame, floor: float, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidate lists, match lists) with country, and three folders by country: candidates, matches and scores of at least floor.

    Decisions are those on the scores that were written. A country that has its matches is left as it is, unless force.
    """
    spark = scored.sparkSession
    if validate.exists(spark, f"{out}/match") and not force:
        done = spark.read.options(sep="\t", header=True).csv(f"{out}/match").select("country").distinct()
        ids = ids.join(done, "country", "left_anti")
    scored = scored.join(ids.select("s1_id"), "s1_id", "left_semi")
    kept = scored.where(F.col("prob") >= floor).withColumn("prob", F.round("prob", 5))
    candidates, matches = _listed(scored, ids), _listed(decide.decide(kept, rule), ids)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        sinks.write_id_lists(candidates, f"{out}/cand", CANDIDATES, "country", "overwrite")
        sinks.write_scores(kept.join(ids, "s1_id"), f"{out}/scores", floor, "country", "overwrite")
        sinks.write_id_lists(matches, f"{out}/match", MATCHES, "country", "overwrite")  # the last: a country that has it is done
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return candidates, matches


def predict(store: Store, models: str, rule: Rule, max_df: float = 0.02, out: str | None = None, force: bool = False, **part) -> tuple[DataFrame, DataFrame]:
    """(candidate lists, match lists) for every record of source 1, or for a part of them (see part_of_universe); scores stay
    in the store. With out the results are written, too."""
    stages, report = load_models(store.spark, models)
    rows = pair_rows(store, max_df, report.get("with_keys", False))
    scores = store.step("scores", lambda: model.score_pairs(stages, rows, report.get("ctx_extra", False)))
    ids = part_of_universe(store, **part)
    if out is not None:
        return write_results(out, scores, rule, ids, SCORE_FLOOR["channels"], force)
    own = scores.join(ids.select("s1_id"), "s1_id", "left_semi")
    return _listed(own, ids).drop("country"), _listed(decide.decide(own.where(F.col("prob") >= SCORE_FLOOR["channels"]), rule), ids).drop("country")


def predict_keys(store: Store, models: str, out: str, rule: Rule | None = None, top_k: int | None = None, force: bool = False, **part) -> tuple[DataFrame, DataFrame]:
    """The first generation's results for all records of source 1 or a part of them; the rule and the candidates a record as
    trained, unless given."""
    stages, report = load_models(store.spark, models)
    ids, k = part_of_universe(store, **part), top_k or report["top_k"]
    whole = not part and k == report["top_k"]
    make = lambda: model.score_pairs(stages, key_rows(store, k, None if whole else ids))
    scored = store.step("key_scores", make) if whole else materialize(make())
    return write_results(out, scored, rule or Rule.parse_repr(report["best"]["config"]), ids, SCORE_FLOOR["keys"], force)


def evaluate(store: Store, truth: DataFrame, rule: Rule) -> DataFrame:
    return metrics.macro_f05(universe(store), truth, decide.decide(store.table("scores").where(F.col("prob") >= SCORE_FLOOR["channels"]), rule))


def recall_check(store: Store, truth: DataFrame, k: int = 25) -> DataFrame:
    """The blocking report, with the records a second that making the candidates took if they weren't there yet."""
    began, made = time.perf_counter(), not store.done(f"candidates_{k}")
    found = key_candidates(store, k)
    found.count()
    return metrics.blocking_report(universe(store), truth, found, time.perf_counter() - began if made else None)


def _write(lists: DataFrame, out: str, header: tuple[str, str]) -> DataFrame:
    sinks.write_id_lists(lists.select("s1_id", "ids"), out, header)
    return lists


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_id_lists(spark, path).select("s1_id", F.array_join("ids", ",").alias("ids"))


def merge(store: Store, out: str, strict: bool = True) -> dict[str, DataFrame]:
    """Candidates and matches of all countries and shards under out as one table of files each, in out/candidate_pairs and
    out/matching_results; raises if a record is missing, and if strict if one is there twice."""
    made = {}
    for kind, name, header in (("cand", "candidate_pairs", CANDIDATES), ("match", "matching_results", MATCHES)):
        made[name] = _write(sinks.merge_shards(_lists(store.spark, f"{out}/{kind}"), universe(store), strict), f"{out}/{name}", header)
    return made


def tune(scores: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Every rule of the off-line grid on a score dump, best first; exclusive ones keep each target for its best record before deciding."""
    rules = decide.rules_of("offline")
    before = decide.grid(decide.one_owner(scores), truth, ids, rules).withColumn("config", F.replace("config", F.lit("exclusive=False"), F.lit("exclusive=True")))
    return decide.grid(scores, truth, ids, rules).unionByName(before).orderBy(F.col("f05").desc(), "config")


def apply(scores: DataFrame, ids: DataFrame, rule: Rule, out: str) -> DataFrame:
    """Match lists of a rule on a score dump. An exclusive rule keeps each target for its best record before deciding."""
    own = decide.one_owner(scores) if rule.exclusive else scores
    chosen = decide.decide(own, replace(rule, exclusive=False))
    return _write(_listed(chosen.join(ids, "s1_id", "left_semi"), ids.withColumn("country", F.lit(""))), out, MATCHES)


def conflicts(base: str, spark: SparkSession, out: str | None = None, include_empty: bool = False) -> DataFrame:
    """How many targets several records claim in a result file; the records concerned are written if out is given."""
    lists = tables.read_id_lists(spark, base)
    claims = tables.exploded(lists)
    if out is not None:
        sinks.write_entities(metrics.conflicted_entities(claims, lists if include_empty else None), out)
    return metrics.conflicts(claims)


def patch(base: str, scores: DataFrame, rescored: DataFrame, rule: Rule, out: str) -> DataFrame:
    """A result file with the rows of re-scored records decided anew; returns the report of what changed."""
    spark = scores.sparkSession
    lists = tables.read_id_lists(spark, base)
    old = tables.exploded(lists)
    listed = rescored.select("s1_id").distinct().join(lists, "s1_id", "left_semi")
    new = decide.patch(old, scores, listed, rule)
    open_ = scores.join(new.where("origin = 'new'").select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    rows = _listed(open_, listed.withColumn("country", F.lit("")))
    _write(sinks.replace_rows(lists.select("s1_id", F.array_join("ids", ",").alias("ids")), rows), out, MATCHES)
    return decide.patch_report(old, new, listed)


def patch_candidates(spark: SparkSession, base: str, rescored: str, out: str) -> DataFrame:
    """A candidate file with the rows of re-scored records replaced."""
    return _write(sinks.replace_rows(_lists(spark, base), _lists(spark, rescored)), out, CANDIDATES)


def hybrid(ids: DataFrame, new: str, old_matching: str, out: str, old_candidates: str | None = None) -> DataFrame:
    """For each record its row of a new run (folders match and cand under new) or else of an old one; raises if one has neither.
    Candidates are written only if every new row of matches has one. Returns (country, origin, n) of the matches."""
    spark = ids.sparkSession
    matches = _lists(spark, f"{new}/match")
    rows = sinks.complete(sinks.overlay(ids, matches, _lists(spark, old_matching)))
    _write(rows, f"{out}/matching_results", MATCHES)
    if old_candidates is not None and validate.exists(spark, f"{new}/cand"):
        candidates = _lists(spark, f"{new}/cand")
        if sinks.covered(matches, candidates):
            _write(sinks.complete(sinks.overlay(ids, candidates, _lists(spark, old_candidates))), f"{out}/candidate_pairs", CANDIDATES)
    return sinks.overlay_report(rows)


def validate_files(spark: SparkSession, matching: str, source1: str, candidates: str | None = None, targets: list[str] | None = None) -> DataFrame:
    """The validator's report; validate.passes(report) says whether the files are accepted. targets: files of valid ids, checked if given."""
    if not validate.exists(spark, source1):
        raise FileNotFoundError(source1)
    valid = tables.match_targets(spark, targets) if targets and all(validate.exists(spark, p) for p in targets) else None
    return validate.validate_run(spark, matching, tables.required_ids(spark, source1), candidates, valid)
