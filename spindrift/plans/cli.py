"""Command line of the linkage jobs: python -m spindrift.plans.cli JOB --options. Exit 0 if the job, or the check, succeeded."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import validate
from spindrift.operators.decide import Rule
from spindrift.plans import jobs
from spindrift.sources import tables

#: For each job its options: those that must be given, then those that may.
JOBS = {
    "build": ("store source1 source2 source3", ""),
    "refresh": ("store", "skip_stats"),
    "train": ("store truth models", "val fit extra with_keys"),
    "train-keys": ("store truth models", "val fit top_k"),
    "predict": ("store models out rule", "countries shard shards s1_list select force"),
    "predict-keys": ("store models out", "rule countries shard shards s1_list select top_k force"),
    "merge": ("store out", "lenient"),
    "recall": ("store truth", "top_k"),
    "tune": ("scores truth universe", ""),
    "apply": ("scores universe rule out", ""),
    "conflicts": ("base", "out include_empty"),
    "patch": ("base scores rescored rule out", ""),
    "patch-cands": ("base rescored out", ""),
    "hybrid": ("source1 new old_matching out", "old_candidates"),
    "validate": ("matching source1", "candidates targets"),
}
NUMBERS = {"val": 40_000, "fit": 30_000, "shard": 0, "shards": 1, "top_k": None}
FLAGS = ("skip_stats", "extra", "with_keys", "force", "lenient", "include_empty")
LISTS = ("countries", "targets")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    commands = out.add_subparsers(dest="job", required=True)
    for name, (needed, maybe) in JOBS.items():
        one = commands.add_parser(name)
        for option in needed.split() + maybe.split():
            flag = f"--{option.replace('_', '-')}"
            if option in FLAGS:
                one.add_argument(flag, action="store_true")
            elif option in NUMBERS:
                one.add_argument(flag, type=int, default=NUMBERS[option])
            else:
                one.add_argument(flag, required=option in needed.split(), nargs="+" if option in LISTS else None)
    return out


def _part(spark: SparkSession, a: argparse.Namespace) -> dict:
    chosen = {"countries": a.countries, "listed": tables.required_ids(spark, a.s1_list) if a.s1_list else None, "select": a.select}
    return {k: v for k, v in chosen.items() if v is not None} | ({"shard": a.shard, "shards": a.shards} if a.shards > 1 else {})


def _truth(spark: SparkSession, path: str) -> DataFrame:
    return tables.exploded(tables.read_id_lists(spark, path))


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    store = jobs.Store(spark, a.store) if "store" in a else None
    rule = Rule.parse(a.rule) if getattr(a, "rule", None) else None
    if a.job == "build":
        jobs.build(store, {k: getattr(a, f"source{k}") for k in (1, 2, 3)})
    elif a.job == "refresh":
        jobs.refresh(store, stats=not a.skip_stats)
    elif a.job == "train":
        print(jobs.train(store, _truth(spark, a.truth), a.models, a.val, a.fit, extra=a.extra, with_keys=a.with_keys)["best"])
    elif a.job == "train-keys":
        print(jobs.train_keys(store, _truth(spark, a.truth), a.models, a.val, a.fit, a.top_k or 25)["best"])
    elif a.job == "predict":
        jobs.predict(store, a.models, rule, out=a.out, force=a.force, **_part(spark, a))
    elif a.job == "predict-keys":
        jobs.predict_keys(store, a.models, a.out, rule, a.top_k, a.force, **_part(spark, a))
    elif a.job == "merge":
        jobs.merge(store, a.out, not a.lenient)
    elif a.job == "recall":
        jobs.recall_check(store, _truth(spark, a.truth), a.top_k or 25).show(truncate=False)
    elif a.job == "tune":
        jobs.tune(tables.read_scores(spark, a.scores), _truth(spark, a.truth), tables.read_universe(spark, a.universe)).show(15, truncate=False)
    elif a.job == "apply":
        jobs.apply(tables.read_scores(spark, a.scores), tables.read_universe(spark, a.universe), rule, a.out)
    elif a.job == "conflicts":
        jobs.conflicts(a.base, spark, a.out, a.include_empty).show(truncate=False)
    elif a.job == "patch":
        jobs.patch(a.base, tables.read_scores(spark, a.scores), tables.read_universe(spark, a.rescored), rule, a.out).show(truncate=False)
    elif a.job == "patch-cands":
        jobs.patch_candidates(spark, a.base, a.rescored, a.out)
    elif a.job == "hybrid":
        ids = tables.read_records(spark, {1: a.source1}).selectExpr("entity_id AS s1_id", "country").distinct()
        jobs.hybrid(ids, a.new, a.old_matching, a.out, a.old_candidates).show(truncate=False)
    else:
        report = jobs.validate_files(spark, a.matching, a.source1, a.candidates, a.targets)
        report.where("n > 0").show(truncate=False)
        return 0 if validate.passes(report) else 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("spindrift").getOrCreate(), sys.argv[1:]))
