"""Decisions on scored candidates, one owner for each target, and the search for the best rule.

Scores are (s1_id, cand_id, prob). Candidates of a record are its own few, ordered by (prob, cand_id) descending.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: thresh (thr, top_n), fallback (thr, lo, top_n) or expf (r, s, floor)."""

    kind: str
    thr: float = 0.5
    lo: float = 0.2
    top_n: int | None = None
    r: float = 0.9
    s: float = 1.0
    floor: float = 0.2
    exclusive: bool = False

    @classmethod
    def parse(cls, text: str) -> Rule:
        """For instance "expf r=0.9 s=1.0 floor=0.2 exclusive=True"."""
        kind, *rest = text.split()
        values: dict = {}
        for key, value in (x.split("=") for x in rest):
            key = "thr" if key == "hi" else key
            values[key] = value == "True" if key == "exclusive" else (None if value == "None" else int(value)) if key == "top_n" else float(value)
        return cls(kind, **values)


    @classmethod
    def parse_repr(cls, text: str) -> Rule:
        """Rule(kind='thresh', ...), as grid names it."""
        values = dict(x.split("=") for x in text.removeprefix("Rule(").removesuffix(")").split(", "))
        read = {"kind": lambda x: x.strip("'"), "exclusive": lambda x: x == "True", "top_n": lambda x: None if x == "None" else int(x)}
        return cls(**{k: read.get(k, float)(v) for k, v in values.items()})


def listed(scores: DataFrame) -> DataFrame:
    """(s1_id, pairs): the candidates of each record, best first, ties to the larger id."""
    return scores.groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct("prob", "cand_id")), asc=False).alias("pairs"))


def _first(pairs: Column, n) -> Column:
    return pairs if n is None else F.slice(pairs, 1, n)


def kept_by_threshold(pairs: Column, thr: float, top_n: int | None) -> Column:
    return _first(F.filter(pairs, lambda x: x["prob"] >= thr), top_n)


def kept_with_fallback(pairs: Column, thr: float, lo: float, top_n: int | None) -> Column:
    """As by threshold; if nothing passes, the best candidate if it reaches lo."""
    kept = kept_by_threshold(pairs, thr, top_n)
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(F.slice(pairs, 1, 1), lambda x: x["prob"] >= lo))


def kept_by_expectation(pairs: Column, r: float, s: float, floor: float) -> Column:
    """As many of the best as have the largest expected F0.5; none if none is likelier."""

    def choose(able: Column) -> Column:
        total = F.aggregate(able, F.lit(0.0), lambda a, x: a + x["prob"])
        none = F.aggregate(able, F.lit(float(s)), lambda a, x: a * (1.0 - x["prob"]))
        start = F.struct(none.alias("best"), F.lit(0).alias("m"), F.lit(0.0).alias("run"), F.lit(0).alias("at"), total.alias("total"))

        def step(a: Column, x: Column) -> Column:
            run, at = a["run"] + x["prob"], a["at"] + 1
            value = 1.25 * run / (0.25 * (a["total"] / r) + at)
            better = value > a["best"]
            return F.struct(F.when(better, value).otherwise(a["best"]).alias("best"), F.when(better, at).otherwise(a["m"]).alias("m"), run.alias("run"), at.alias("at"), a["total"].alias("total"))

        return F.slice(able, 1, F.aggregate(able, start, step, lambda a: a["m"]))

    return F.transform(F.array(F.filter(pairs, lambda x: x["prob"] >= floor)), choose)[0]


def kept(pairs: Column, rule: Rule) -> Column:
    if rule.kind == "thresh":
        return kept_by_threshold(pairs, rule.thr, rule.top_n)
    if rule.kind == "fallback":
        return kept_with_fallback(pairs, rule.thr, rule.lo, rule.top_n)
    if rule.kind == "expf":
        return kept_by_expectation(pairs, rule.r, rule.s, rule.floor)
    raise ValueError(f"no rule {rule.kind}")


def decide(scores: DataFrame, rule: Rule) -> DataFrame:
    """The chosen (s1_id, cand_id, prob); with rule.exclusive each target stays with its best record after deciding."""
    chosen = listed(scores).select("s1_id", F.explode(kept(F.col("pairs"), rule)).alias("x")).select("s1_id", "x.cand_id", "x.prob")
    return one_owner(chosen) if rule.exclusive else chosen


def one_owner(pairs: DataFrame) -> DataFrame:
    """Each target with the record that has its highest prob, ties to the least s1_id. Before or after deciding, results differ."""
    order = Window.partitionBy("cand_id").orderBy(F.col("prob").desc(), "s1_id")
    return pairs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def patch(old: DataFrame, scores: DataFrame, listed_ids: DataFrame, rule: Rule) -> DataFrame:
    """old decisions, with those of the listed records taken anew: targets that other records own are locked."""
    kept_old = old.join(listed_ids, "s1_id", "left_anti")
    open_ = scores.join(listed_ids, "s1_id", "left_semi").join(kept_old.select("cand_id").distinct(), "cand_id", "left_anti")
    new = one_owner(decide(open_.select("s1_id", "cand_id", "prob"), rule))
    return kept_old.select("s1_id", "cand_id").withColumn("origin", F.lit("old")).unionByName(new.select("s1_id", "cand_id").withColumn("origin", F.lit("new")))


def patch_report(old: DataFrame, patched: DataFrame, listed_ids: DataFrame) -> DataFrame:
    """How many listed records changed, pairs removed and added, and empty records filled."""
    own = lambda df, name: df.join(listed_ids, "s1_id", "left_semi").groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias(name))
    none = F.array().cast("array<string>")
    both = listed_ids.join(own(old, "a"), "s1_id", "left").join(own(patched, "b"), "s1_id", "left").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    return both.agg(
        count(F.col("a") != F.col("b")).alias("changed"),
        count(F.size(F.array_except("a", "b"))).alias("removed"),
        count(F.size(F.array_except("b", "a"))).alias("added"),
        count((F.size("a") == 0) & (F.size("b") > 0)).alias("filled"),
    )


def grid(scores: DataFrame, truth: DataFrame, universe: DataFrame, rules: list[Rule]) -> DataFrame:
    """(config, f05, precision, recall) of each rule, best first.

    All rules decide in one pass over the candidate lists. Records that a rule leaves empty need no rows: without
    truth they count 1, with truth 0.
    """
    from spindrift.operators.metrics import f05

    ids = universe.select("s1_id").distinct()
    own = truth.join(ids, "s1_id", "left_semi").select("s1_id", "cand_id").distinct()
    lists = listed(scores.join(ids, "s1_id", "left_semi"))
    tried = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(rule.exclusive).alias("exclusive"), kept(F.col("pairs"), rule).alias("kept")) for k, rule in enumerate(rules)])
    chosen = lists.select("s1_id", F.explode(tried).alias("x")).select("s1_id", "x.rule", "x.exclusive", F.explode("x.kept").alias("y")).select("s1_id", "rule", "exclusive", "y.*")
    order = Window.partitionBy("rule", "cand_id").orderBy(F.col("prob").desc(), "s1_id")
    chosen = chosen.withColumn("__n", F.row_number().over(order)).where("not exclusive or __n = 1").select("rule", "s1_id", "cand_id")
    n_true = own.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    per = chosen.join(own.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("rule", "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    per = per.join(n_true, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    sums = per.groupBy("rule").agg(
        F.sum(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f"),
        F.sum(F.col("tp") / F.col("n_pred")).alias("p"),
        F.sum(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)).alias("r"),
        F.sum((F.col("n_true") == 0).cast("long")).alias("false_alarms"),
    )
    sizes = ids.agg(F.count(F.lit(1)).alias("n")).crossJoin(n_true.agg(F.count(F.lit(1)).alias("with_truth")))  # one row
    names = chosen.sparkSession.createDataFrame([(k, str(rule)) for k, rule in enumerate(rules)], "rule int, config string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    judged = F.greatest(F.col("with_truth") + zero("false_alarms"), F.lit(1))
    return (
        names.join(sums, "rule", "left").crossJoin(F.broadcast(sizes))
        .select(
            "config",
            F.round((zero("f") + F.col("n") - F.col("with_truth") - zero("false_alarms")) / F.greatest("n", F.lit(1)), 6).alias("f05"),
            F.round(zero("p") / judged, 6).alias("precision"), F.round(zero("r") / judged, 6).alias("recall"),
        )
        .orderBy(F.col("f05").desc(), "config")
    )


# The grids of rules that are searched, on the validation entities of either generation and off line on score dumps.
GRIDS = {
    "channels": {
        "thresh": {"thr": (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), "top_n": (None, 4, 6, 8)},
        "expf": {"r": (0.6, 0.75, 0.9, 1.0), "s": (0.4, 0.7, 1.0), "floor": (0.05, 0.2)},
    },
    "keys": {
        "thresh": {
            "thr": (*(k / 100 for k in range(10, 80, 5)), *(k / 100 for k in range(80, 99)), 0.99, 0.995),
            "top_n": (None, 2, 3, 4, 5, 6, 8, 10, 12, 20),
        },
    },
    "offline": {
        "thresh": {"thr": (0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85), "top_n": (None, 4, 5, 6, 8)},
        "fallback": {"thr": (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8), "lo": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4), "top_n": (None, 5, 6, 8)},
        "expf": {"r": (0.55, 0.65, 0.75, 0.85, 1.0), "s": (0.2, 0.4, 0.6, 0.8, 1.0), "floor": (0.05, 0.1, 0.2)},
    },
}


def rules_of(name: str, exclusive: tuple[bool, ...] = (False,)) -> list[Rule]:
    """All rules of a grid, each without or with one owner a target, or both."""
    kinds = GRIDS[name].items()
    return [Rule(kind, **dict(zip(values, chosen, strict=True)), exclusive=e) for kind, values in kinds for chosen in product(*values.values()) for e in exclusive]
