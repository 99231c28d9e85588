"""Learned scorers: splits by entity, gradient-boosted trees, out-of-fold first stage, second stage on context."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import bucket
from spindrift.operators.context import BASE, EXTRA, context_features

CONTEXT = BASE


def split(ids: DataFrame, n_val: int, n_fit: int, share: int = 15, key: str = "s1_id") -> DataFrame:
    """ids with part: val below the share of stable buckets, fit above, the first of each by the order of a hash.

    Each task keeps its own first n_val or n_fit, so nothing but these is sorted.
    """
    ids = ids.select(key).distinct()
    low = bucket(F.col(key)) < share
    first = lambda part, n, which: which.orderBy(F.md5(key), key).limit(n).withColumn("part", F.lit(part))
    return first("val", n_val, ids.where(low)).unionByName(first("fit", n_fit, ids.where(~low)))


def labelled(pairs: DataFrame, truth: DataFrame, on: tuple[str, str] = ("q", "t")) -> DataFrame:
    """pairs with label 1.0 for true ones."""
    true = truth.select(F.col("s1_id").alias(on[0]), F.col("cand_id").alias(on[1]), F.lit(1.0).alias("label")).distinct()
    return pairs.join(true, list(on), "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def train(rows: DataFrame, columns: list[str], key: str = "q", rounds: int = 40, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Boosted trees; a tenth of the entities, not of the pairs, decides when to stop."""
    rows = rows.withColumn("dev", bucket(F.col(key)) % 10 == 0)
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, validationIndicatorCol="dev")
    return PipelineModel([assemble, trees.fit(assemble.transform(rows))])


def score(model: PipelineModel, rows: DataFrame, out: str = "p1") -> DataFrame:
    return model.transform(rows).withColumn(out, F.round(vector_to_array("probability")[1], 5)).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, columns: list[str], folds: int = 3, **kw) -> DataFrame:
    """rows with p1 from a model that has not seen the row's entity."""
    fold, out = bucket(F.col("q"), 3 if folds == 3 else folds), None
    for k in range(folds):
        one = score(train(rows.where(fold != k), columns, **kw), rows.where(fold == k))
        out = one if out is None else out.unionByName(one)
    return out


def two_stages(rows: DataFrame, columns: list[str], extra: bool = False, **kw) -> tuple[PipelineModel, PipelineModel]:
    """A first model on all rows, and a second on their features and the context of out-of-fold scores, the extra one if wanted."""
    second = context_features(out_of_fold(rows, columns, **kw).select("q", "t", "label", *columns, "p1"), extra)
    return train(rows, columns, **kw), train(second, [*columns, *CONTEXT, *(EXTRA if extra else [])], **kw)


def score_pairs(models: tuple[PipelineModel, PipelineModel | None], rows: DataFrame, extra: bool = False) -> DataFrame:
    """(s1_id, cand_id, prob) by the first stage, or by both; extra as in training."""
    first = score(models[0], rows)
    if models[1] is not None:
        first = score(models[1], context_features(first, extra), "p2").withColumn("p1", F.col("p2"))
    return first.select(F.col("q").alias("s1_id"), F.col("t").alias("cand_id"), F.col("p1").alias("prob"))


def importance(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def formula(features: DataFrame, weights: dict[str, float], offset: float, kept: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, cand_id, prob) and columns kept: a fixed logistic formula over features, for runs that must be the same everywhere."""
    x = F.lit(offset)
    for name, w in weights.items():
        x = x + F.col(name) * F.lit(w)
    return features.select("s1_id", "cand_id", F.round(1 / (1 + F.exp(-x)), 5).alias("prob"), *kept)
