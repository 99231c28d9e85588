"""The linkage operators as queries over the test tables: documents stand for business records (see sources.tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import blocking, channels, context, decide, features, keys, metrics, model, validate
from spindrift.operators.decide import Rule
from spindrift.operators.model import formula
from spindrift.sources import sinks, tables
from spindrift.sources.scratch import materialize, scratch_path

WEIGHTS = {"blocking_score": 0.15, "name_jaccard": 2.0, "addr_jaccard": 2.0, "name_exact": 3.0, "phon_exact": 1.0}
OFFSET = -4.0
#: The same for the features of the second generation.
PAIR_WEIGHTS = {"r_name_tset": 0.02, "r_addr_tset": 0.03, "name_word_jac": 2.0, "addr_word_jac": 2.0, "c4_keys": 0.5, "n_channels": 0.25}
PAIR_OFFSET = -6.0
THRESH, FALLBACK, EXPF = Rule("thresh", thr=0.5, top_n=4), Rule("fallback", thr=0.6, lo=0.05, top_n=5), Rule("expf", r=0.9, s=1.0, floor=0.05)


class Run:
    """The intermediate frames of one run, each made when first asked for. What several others read is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
        self.made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: materialize(make()))

    records = property(lambda s: s._once("records", lambda: tables.from_documents(s.documents)))
    normal = property(lambda s: s._once("normal", lambda: keys.normalized(s.records)))
    forms = property(lambda s: s._once("forms", lambda: channels.linked_forms(s.records)))
    stored_forms = property(lambda s: s._stored("stored_forms", lambda: s.forms))
    tokens = property(lambda s: s._stored("tokens", lambda: features.record_tokens(s.normal)))
    universe = property(lambda s: s._once("universe", lambda: s.records.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country")))
    truth = property(lambda s: s._once("truth", lambda: tables.truth_from_documents(s.documents)))
    keys = property(lambda s: s._once("keys", lambda: keys.blocking_keys(s.normal)))
    stored_keys = property(lambda s: s._stored("stored_keys", lambda: s.keys))
    freq = property(lambda s: s._once("freq", lambda: keys.key_freq(s.keys)))
    candidates = property(lambda s: s._once("candidates", lambda: blocking.best(blocking.scored(s.probe, s.stored_keys))))
    stored_candidates = property(lambda s: s._stored("stored_candidates", lambda: s.candidates))
    token_features = property(lambda s: s._once("token_features", lambda: features.token_features(s.stored_candidates, s.tokens)))
    scores = property(lambda s: s._stored("scores", lambda: formula(s.token_features, WEIGHTS, OFFSET)))
    stored_union = property(lambda s: s._stored("stored_union", lambda: s.union()))

    @property
    def probe(self) -> DataFrame:
        return self._once("probe", lambda: keys.probe_table(self.stored_keys, keys.key_freq(self.stored_keys), self.records.where("source > 1").count()))

    def union(self, c1: DataFrame | None = None) -> DataFrame:
        return channels.union(channels.channels(self.stored_forms), c1)

    def channel(self, field: str, name: str, pad: bool) -> DataFrame:
        return channels.tfidf_topk(self.stored_forms, field, name, pad)

    def chosen(self, rule: Rule) -> DataFrame:
        return decide.decide(self.scores, rule)

    def rivals(self, *columns: str) -> DataFrame:
        """q, t, p1, a score by the formula, and some pair features; only what these need is made."""
        x = features.pair_features(self.stored_union, self.stored_forms, list(dict.fromkeys([*PAIR_WEIGHTS, *columns])))
        return formula(x.withColumnsRenamed({"q": "s1_id", "t": "cand_id"}), PAIR_WEIGHTS, PAIR_OFFSET, columns).withColumnsRenamed({"s1_id": "q", "cand_id": "t", "prob": "p1"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Run], DataFrame]):
    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Run(spark, sf_dir))

    QUERIES[make.__name__] = run
    return run


def _rounded(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in ids else F.col(c) for c, kind in df.dtypes])


@query
def normalize_name(r: Run) -> DataFrame:
    name = X.trade_name(F.col("business_name"))
    return r.normal.select("entity_id", "name_norm", name.alias("trade_name"), X.sorted_tokens(name).alias("sorted_name"))


@query
def normalize_addr(r: Run) -> DataFrame:
    return r.records.select("entity_id", X.address(X.fold(F.col("business_address"))).alias("addr_norm"), X.full_address(X.fold(F.col("business_address"))).alias("full_addr"))


@query
def digit_postal_house_tokens(r: Run) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit(""))
    join = lambda x: F.array_join(F.array_sort(x), " ")
    return r.documents.select("doc_id", join(X.digits(raw)).alias("digits"), join(X.postal(raw)).alias("postal"), join(X.house(X.fold(raw))).alias("house"))


@query
def phonetic_key(r: Run) -> DataFrame:
    n = F.col("name_norm")
    own = r.normal.select("entity_id", X.name_sound(n).alias("name_phon"), F.array_join(F.array_sort(X.sound_tokens(n)), " ").alias("phon_tokens"), X.prefix(n).alias("prefix"))
    return own.join(r.forms.select("entity_id", "phon", "phonc"), "entity_id")


@query
def normalize_any_script(r: Run) -> DataFrame:
    """The forms of normalize_name by way of transliteration, as whole runs make them."""
    normal, name = keys.normalized(r.records, X.transliterate), X.trade_name(F.col("business_name"), X.transliterate)
    return normal.select("entity_id", "name_norm", name.alias("trade_name"), X.sorted_tokens(name).alias("sorted_name"))


@query
def entity_split(r: Run) -> DataFrame:
    return model.split(r.universe, 40, 100)


@query
def labelled_pairs(r: Run) -> DataFrame:
    return model.labelled(r.stored_candidates.select("s1_id", "cand_id"), r.truth, ("s1_id", "cand_id"))


@query
def stable_bucket_split(r: Run) -> DataFrame:
    b = X.bucket(F.col("s1_id"))
    return r.universe.select("s1_id", b.alias("bucket"), F.when(b < 15, "val").otherwise("fit").alias("part"))


@query
def blocking_keys(r: Run) -> DataFrame:
    return r.keys


@query
def key_freq(r: Run) -> DataFrame:
    return r.freq


@query
def pruned_keys(r: Run) -> DataFrame:
    return keys.prune(r.keys, r.freq).groupBy("source", "key_type").agg(F.count(F.lit(1)).alias("n"))


@query
def probe_table(r: Run) -> DataFrame:
    return _rounded(r.probe)


@query
def candidates_cheap(r: Run) -> DataFrame:
    return r.candidates


@query
def candidates_escalated(r: Run) -> DataFrame:
    return blocking.escalated(r.probe, r.stored_keys, r.universe)


@query
def candidate_lists(r: Run) -> DataFrame:
    return sinks.id_lists(r.candidates, r.universe)


@query
def exact_channel(r: Run) -> DataFrame:
    return channels.exact_channel(r.stored_forms)


@query
def tfidf_name_topk(r: Run) -> DataFrame:
    return r.channel("name", "c2", True)


@query
def tfidf_phon_topk(r: Run) -> DataFrame:
    return r.channel("phonc", "c2b", False)


@query
def tfidf_addr_topk(r: Run) -> DataFrame:
    return r.channel("addr", "c3", True)


@query
def channel_union(r: Run) -> DataFrame:
    return r.union()


@query
def channel_union_keys(r: Run) -> DataFrame:
    """The union with the key candidates, up to a hundred a record, as a fifth channel."""
    return r.union(materialize(blocking.best(blocking.scored(r.probe, r.stored_keys), 100)))


@query
def token_features(r: Run) -> DataFrame:
    return _rounded(r.token_features)


@query
def word_features(r: Run) -> DataFrame:
    pairs = r.stored_candidates.select(F.col("s1_id").alias("q"), F.col("cand_id").alias("t"))
    return _rounded(features.word_features(pairs, r.stored_forms))


@query
def fuzzy_features(r: Run) -> DataFrame:
    return features.fuzzy_features(r.stored_candidates, r.tokens)


@query
def pair_features(r: Run) -> DataFrame:
    return _rounded(features.pair_features(r.stored_union, r.stored_forms))


@query
def key_features(r: Run) -> DataFrame:
    return _rounded(features.key_features(r.stored_candidates, r.tokens))


@query
def context_base(r: Run) -> DataFrame:
    scored = r.scores.select(F.col("s1_id").alias("q"), F.col("cand_id").alias("t"), F.col("prob").alias("p1"))
    return _rounded(context.context_base(scored))


@query
def context_extra(r: Run) -> DataFrame:
    scored = r.rivals("cand_source", "r_addr_tset", "r_name_tset", "addr_word_ovl", "r_phon")
    return _rounded(context.context_extra(scored))


@query
def decide_thresh(r: Run) -> DataFrame:
    return r.chosen(THRESH)


@query
def decide_fallback(r: Run) -> DataFrame:
    return r.chosen(FALLBACK)


@query
def decide_expf(r: Run) -> DataFrame:
    return r.chosen(EXPF)


@query
def exclusive_decision(r: Run) -> DataFrame:
    return decide.one_owner(r.chosen(FALLBACK))


@query
def exclusive_candidate(r: Run) -> DataFrame:
    return decide.decide(decide.one_owner(r.scores), FALLBACK)


@query
def macro_f05(r: Run) -> DataFrame:
    return metrics.macro_f05(r.universe, r.truth, r.chosen(THRESH))


@query
def rule_grid(r: Run) -> DataFrame:
    rules = [Rule("thresh", thr=t, top_n=n, exclusive=e) for t in (0.3, 0.5, 0.8) for n in (None, 2) for e in (False, True)]
    out = decide.grid(r.scores, r.truth, r.universe, rules)
    part = lambda name: F.regexp_extract("config", rf"{name}=([^,)]+)", 1).alias(name)
    return out.select(part("thr"), part("top_n"), part("exclusive"), "f05", "precision", "recall")


@query
def diagnose_empties(r: Run) -> DataFrame:
    return metrics.diagnose(r.universe, r.truth, r.chosen(THRESH), r.scores)


@query
def retrieval_report(r: Run) -> DataFrame:
    return metrics.retrieval_report(r.universe, r.truth, r.stored_candidates)


@query
def blocking_report(r: Run) -> DataFrame:
    return metrics.blocking_report(r.universe, r.truth, r.stored_candidates)


@query
def leave_one_out(r: Run) -> DataFrame:
    return metrics.channel_recall(r.truth, r.stored_union, r.universe)


@query
def conflict_count(r: Run) -> DataFrame:
    return metrics.conflicts(r.chosen(FALLBACK))


def _conflicted(r: Run) -> DataFrame:
    return metrics.conflicted_entities(r.chosen(FALLBACK), r.universe)


@query
def conflicted_entities(r: Run) -> DataFrame:
    return _conflicted(r)


@query
def hybrid_merge(r: Run) -> DataFrame:
    new = sinks.id_lists(r.chosen(THRESH).withColumn("rank", -F.col("prob")), r.universe.where(X.bucket(F.col("s1_id")) < 50))
    old = sinks.id_lists(r.chosen(FALLBACK).withColumn("rank", -F.col("prob")), r.universe.where(X.bucket(F.col("s1_id")) >= 25))
    return sinks.overlay(r.universe, new, old)


@query
def merge_shards(r: Run) -> DataFrame:
    lists = sinks.id_lists(r.stored_candidates, r.universe)
    b = X.bucket(F.col("s1_id"))
    return sinks.shard_report(lists.where(b < 60).unionByName(lists.where(b.between(50, 89))), r.universe)


@query
def patch_results(r: Run) -> DataFrame:
    return decide.patch(r.chosen(FALLBACK), r.scores, _conflicted(r), Rule("thresh", thr=0.3))


@query
def apply_rule(r: Run) -> DataFrame:
    """Match lists of a rule on scores of which each target's best record keeps it."""
    chosen = decide.decide(decide.one_owner(r.scores), EXPF)
    return sinks.id_lists(chosen.withColumn("rank", -F.col("prob")), r.universe)


@query
def patch_candidate_rows(r: Run) -> DataFrame:
    """Candidate lists with those of conflicted records made anew, longer."""
    conflicted = _conflicted(r)
    wider = blocking.best(blocking.scored(r.probe.join(conflicted, "s1_id", "left_semi"), r.stored_keys), 40)
    return sinks.replace_rows(sinks.id_lists(r.stored_candidates, r.universe), sinks.id_lists(wider, conflicted))


@query
def patch_changes(r: Run) -> DataFrame:
    old, listed = r.chosen(FALLBACK), _conflicted(r)
    return decide.patch_report(old, decide.patch(old, r.scores, listed, Rule("thresh", thr=0.3)), listed)


@query
def hybrid_report(r: Run) -> DataFrame:
    """Where the rows of a merge of a partial new run and a partial old one come from; those that neither has are missing."""
    b = X.bucket(F.col("s1_id"))
    new = sinks.id_lists(r.chosen(THRESH).withColumn("rank", -F.col("prob")), r.universe.where(b < 40))
    old = sinks.id_lists(r.chosen(FALLBACK).withColumn("rank", -F.col("prob")), r.universe.where(b >= 50))
    return sinks.overlay_report(sinks.overlay(r.universe, new, old))


@query
def score_dump(r: Run) -> DataFrame:
    return sinks.printed(r.scores, 0.05)


@query
def records_from_files(r: Run) -> DataFrame:
    """Records by way of a source file each."""
    at = scratch_path(r.spark)
    for source in (1, 2, 3):
        sinks.write_records(r.records.where(F.col("source") == source), f"{at}/{source}")
    read = tables.read_records(r.spark, {source: f"{at}/{source}" for source in (1, 2, 3)}, lines=True)
    return tables.latest(read, "line").select(F.col("source").cast("int").alias("source"), "entity_id", "business_name", "business_address", "country")


@query
def pairs_from_files(r: Run) -> DataFrame:
    """Candidate pairs by way of a file of lists, for the records that a file of ids names."""
    at = scratch_path(r.spark)
    sinks.write_id_lists(sinks.id_lists(r.stored_candidates, r.universe), f"{at}/lists", ("source1_entity_id", "candidate_entity_ids"))
    sinks.write_entities(r.universe.where(X.bucket(F.col("s1_id")) < 70), f"{at}/ids")
    return tables.only(tables.exploded(tables.read_id_lists(r.spark, f"{at}/lists")), tables.required_ids(r.spark, f"{at}/ids"), "s1_id")


@query
def scores_from_files(r: Run) -> DataFrame:
    """Scores by way of a dump, and whether each record is in a universe scanned from a file of lists."""
    at = scratch_path(r.spark)
    sinks.write_scores(r.scores, f"{at}/scores", 0.05)
    sinks.write_id_lists(sinks.id_lists(r.chosen(THRESH).withColumn("rank", -F.col("prob")), r.universe.where(X.bucket(F.col("s1_id")) < 70)), f"{at}/lists", ("source1_entity_id", "matched_entity_ids"))
    known = tables.read_universe(r.spark, f"{at}/lists").withColumn("known", F.lit(True))
    return tables.read_scores(r.spark, f"{at}/scores").join(known, "s1_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query
def validate_rules(r: Run) -> DataFrame:
    b = X.bucket(F.col("s1_id"))
    lists = sinks.id_lists(r.chosen(THRESH).withColumn("rank", -F.col("prob")), r.universe)
    line = F.concat("s1_id", F.when(b == 1, " ").otherwise("\t"), F.when(b == 3, "S9-x,").when(b == 4, "S1-00000003,").when(b == 6, "S2-1,S2-1,").otherwise(""), "ids")
    body = lists.where(b != 5).select(F.explode(F.when(b == 2, F.array(line, line)).otherwise(F.array(line))).alias("line"))
    head = r.spark.createDataFrame([("source1_entity_id\tmatched_entity_ids",)], "line string")
    lines = head.select(F.lit(0).alias("line_no"), "line").unionByName(body.select(F.lit(1).alias("line_no"), "line"))
    within = r.stored_candidates.where("rank <= 2").select("s1_id", "cand_id")
    valid = r.records.where("source > 1").select(F.col("entity_id").alias("cand_id"))
    return validate.validate_lines(lines, r.universe, ("source1_entity_id", "matched_entity_ids"), valid, within)
