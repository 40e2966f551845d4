"""Quality by hierarchical empirical Bayes.

A logistic classifier over a text's surface gives the document's evidence.
Sites are two-level: a host (the source) and a path below it (source and
language).  Each level's rate of good documents is a grouped sum over all
documents - the label where a training row has one, else the classifier's
probability - shrunk toward the level above with a strength estimated by the
method of moments, so sparse sites stay near the global rate.  The posterior
log-odds of a document add the classifier's and the path's, less the global
ones.  Only DataFrame functions run on the executors; the few weights are
fitted on a bounded sample of features.

Defined results: null and empty texts have the surface of no characters and
are judged by it and by their site; null source or language is a site of its
own; repeated rows get equal scores; without both labels the score is the
global rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small, written

SAMPLE = 20_000  # labelled rows that the weights are fitted on, about, by a hash of the id
WEIGHT_OF_GUESS = 0.2  # of a classifier's probability among labels
STRENGTHS = (2.0, 500.0)  # bounds of the shrinkage, in documents


def surface(text: Column) -> list[Column]:
    """Numbers that describe a text's surface, each of a small range."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / n

    words = F.split(text, " ")
    lines = F.split(text, "\n")
    return [
        F.log1p(F.length(text).cast("double")) / 10,
        F.least(share("!") * 10, F.lit(2.0)),
        F.least(share("#$%&*") * 10, F.lit(3.0)),
        F.least(share("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") * 4, F.lit(4.0)),
        F.least(share("0123456789") * 10, F.lit(3.0)),
        F.least(share("|<>{}[]\\") * 10, F.lit(3.0)),
        F.size(F.array_distinct(words)) / F.size(words),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.least(F.size(words) / n * 5, F.lit(3.0)),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights, the last for the constant, by Newton steps."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 1.0), 1e-3]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, learn: Column, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """One row for each of docs: doc_id, p_document, p_host, p_path, score, predicted.

    labels (doc_id, quality) are used where `learn` (over doc_id) holds.
    """
    host = F.coalesce(F.col("source"), F.lit("")) if host is None else host
    path = F.coalesce(F.col("lang"), F.lit("")) if path is None else path
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(learn).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), *(c.alias(f"x{i}") for i, c in enumerate(surface(F.col("text")))))
    rows = written(rows.join(known, rows["doc_id"] == known["_id"], "left").drop("_id"))
    names = [c for c in rows.columns if c[0] == "x"]
    total = rows.where("quality is not null").count()
    dice = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where("quality is not null").where(dice < min(1.0, SAMPLE / max(1, total))).select(*names, "quality").collect()
    y = np.array([r.quality for r in got], float)
    both = len(set(y)) == 2
    w = fit(np.array([r[:-1] for r in got], float), y) if both else np.zeros(len(names) + 1)
    prior = float(y.mean()) if len(y) else 0.5
    z = F.lit(float(w[-1]))
    for name, x in zip(names, w):
        z = z + F.col(name) * float(x)
    p = 1 / (1 + F.exp(-z)) if both else F.lit(prior)
    rows = rows.withColumn("p_document", p)
    guess = F.when(F.col("quality").isNull(), F.lit(WEIGHT_OF_GUESS)).otherwise(1.0)
    sums = [F.sum(F.coalesce(F.col("quality").cast("double"), F.col("p_document")) * guess).alias("good"), F.sum(guess).alias("n")]
    paths = written(rows.groupBy("host", "path").agg(*sums))  # a row for each site
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("good"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else prior
    moments = [F.count("*"), F.sum("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, F.lit(2)))]
    k_host, k_path = (_moments(mean, *f.agg(*moments).first()) for f in (hosts, paths))
    hosts = hosts.select("host", ((F.col("good") + k_host * mean) / (F.col("n") + k_host)).alias("p_host"))
    sites = paths.join(hosts, "host").select("host", "path", "p_host", ((F.col("good") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path"))
    sites = small(written(sites))
    out = rows.join(sites, ["host", "path"], "left")
    z = _logit(F.col("p_document")) + _logit(F.col("p_path")) - _logit(F.lit(mean)) if both else _logit(F.lit(mean))
    final = 1 / (1 + F.exp(-z))
    return out.select("doc_id", "p_document", "p_host", "p_path", final.alias("score"), (final >= 0.5).cast("int").alias("predicted"))


def _moments(mean: float, groups: int, n: float | None, spread: float | None) -> float:
    """The strength of the shrinkage toward `mean`, from the sums of a level's groups."""
    if not n or groups < 2:
        return STRENGTHS[1]
    inside = max(mean * (1 - mean), 1e-6)
    between = spread / n - inside * (groups - 1) / n
    return float(np.clip(inside / max(between, 1e-9) - 1, *STRENGTHS))
