"""Quality classifier by hierarchical empirical Bayes.

A logistic model of a document's own features, fitted on labelled rows, gives the log odds that it is good; less those of
the labelled rows' share of good ones, they are its evidence, a log likelihood ratio. With that share as the prior, every
document has a probability, and sites have shares of good documents, their means. Each host's share is shrunk
towards the corpus' by a strength that the spread of the hosts decides (method of moments); each path of a host is
shrunk towards its host in the same way. With its path's share as the prior each document has another probability, from
which the shares are taken anew, ROUNDS times in all (expectation and maximisation: with one prior for all, sites would seem
more alike than they are). A document's own probability is left out of the shares that judge it at last; the posterior
log odds are the evidence plus those of its path's share.

Everything that covers the corpus is a grouped aggregation, pre-aggregated before the shuffle, so hot hosts cost
one row a task. The model alone is fitted on a bounded sample of labelled rows (SAMPLE, by the order of a hash).

Null hosts and paths are groups of their own. Null and empty texts have features of an empty text. Labels that are
null, or that name no document, aren't used; without labels of both kinds there is no evidence and the prior is one half.
Repeated rows are judged alike. Sums are those of whole millionths, so their order doesn't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import WHITE, materialize, words_of
from spindrift.llm.quality_rules import STOP_WORDS, SYMBOLS

#: Labelled rows that the driver sees to fit the model, whatever the corpus.
SAMPLE = 20_000
RIDGE = 1.0
FEATURES = ("symbols", "stop", "length", "distinct", "stutter", "dup_lines", "log_words", "digits")
BROADCAST_SITES = 50_000
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
ROUNDS = 4


def features(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of FEATURES, from built-in expressions."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(out, words_of(F.col(text)))
    words = F.col(out)
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_replace(line, WHITE, "") != "")
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()\"'")))
    shifted = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    stutter = F.aggregate(F.zip_with(words, shifted, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))
    values = {
        "symbols": F.least((F.length(body) - F.length(F.translate(body, SYMBOLS, ""))) / n, F.lit(3.0)),
        "stop": F.size(F.filter(words, lambda w: bare(w).isin(stop))) / n,
        "length": F.least(F.length(F.regexp_replace(body, WHITE, "")) / n, F.lit(30.0)),
        "distinct": F.size(F.array_distinct(words)) / n,
        "stutter": stutter / n,
        "dup_lines": F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)))[0],
        "log_words": F.log1p(F.size(words)),
        "digits": (F.length(body) - F.length(F.translate(body, "0123456789", ""))) / n,
    }
    return df.withColumn(out, F.array(*[values[k].cast("double") for k in FEATURES]))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float, float]:
    """Weights of a ridge logistic model, by Newton's method on standardised features, its offset less the prior log odds, and the prior."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0, 0.5
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    prior = float(y.mean())
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum() - np.log(prior / (1 - prior))), prior


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sum(x: Column) -> Column:
    """A sum in whole millionths: the same in whatever order."""
    return (F.sum(F.round(x * 1_000_000).cast("decimal(38,0)")) / 1_000_000).cast("double")


def strength(groups: DataFrame) -> float:
    """How many documents a prior is worth, from groups(n, good, prior): the method of moments for Beta-binomial shares."""
    share = F.col("good") / F.col("n")
    row = groups.where("n > 1").agg(
        _sum(F.col("n") * (share - F.col("prior")) ** 2).alias("spread"),
        _sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"),
        _sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("all"),
    ).first()
    if row["spread"] is None or row["all"] <= 0:
        return MOST_STRENGTH
    between = max(0.0, row["spread"] - row["noise"]) / row["all"]  # the intra-class correlation
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / between - 1))) if between > 0 else MOST_STRENGTH


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, evidence (log likelihood ratio), host_share, path_share, quality (posterior probability), kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    slim = materialize(features(slim, "text", "features").drop("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = slim.join(F.broadcast(known), "doc_id").select("features", "y").orderBy(F.xxhash64("features"), "y").limit(2 * sample).collect()
    weights, offset, prior = fit(np.array([r["features"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))
    evidence = F.lit(offset)
    for k, w in enumerate(weights.tolist()):
        evidence = evidence + F.col("features")[k] * F.lit(w)
    scored = slim.withColumn("evidence", F.greatest(F.least(evidence, F.lit(20.0)), F.lit(-20.0))).drop("features")
    share = lambda good, n, m, k: (good + k * m) / (n + k)
    chance = lambda of: F.round(1 / (1 + F.exp(-F.col("evidence") - _logit(of))), 6)
    out = scored.withColumn("p", chance(F.lit(prior)))
    for _ in range(ROUNDS):
        paths = materialize(out.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), _sum(F.col("p")).alias("good")))
        total = paths.agg(F.sum("n").alias("n"), _sum(F.col("good")).alias("good")).first()
        corpus = min(1 - 1e-6, max(1e-6, (total["good"] or 0.0) / total["n"])) if total["n"] else prior
        hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), _sum(F.col("good")).alias("host_good")))
        host_strength = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(corpus).alias("prior")))
        host_prior = share(F.col("host_good"), F.col("host_n"), F.lit(corpus), host_strength)
        sites = materialize(paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("prior", host_prior))
        path_strength = strength(sites.select("n", "good", "prior"))
        count = sites.count()
        sites = sites.withColumnsRenamed({"host": "h", "path": "q"})
        sites = F.broadcast(sites) if count <= BROADCAST_SITES else sites
        # p is that of the round before, by which these shares were taken; the next round has its own.
        before = out.select("doc_id", "host", "path", "evidence", "p")
        out = before.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
        judged = out
        out = out.withColumn("p", chance(share(F.col("good"), F.col("n"), F.col("prior"), path_strength)))
    out = judged
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("host_share", clip(share(F.col("host_good") - F.col("p"), F.col("host_n") - 1, F.lit(corpus), host_strength)))
    out = out.withColumn("path_share", clip(share(F.col("good") - F.col("p"), F.col("n") - 1, F.col("host_share"), path_strength)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("path_share")))))
    return out.select("doc_id", "evidence", "host_share", "path_share", "quality", (F.col("quality") >= 0.5).alias("kept"))
