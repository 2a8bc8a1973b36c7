"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: mean log-ratio of byte trigrams between good and bad labelled texts, turned into a probability by a
logistic curve; both are fitted on a sample of at most SAMPLE labels, the first by hash of their ids, one text for each. The curve is fitted on
scores out of fold: each half of the sample is scored by the counts of the other. A host's mean is shrunk to
the corpus's, a path's to its host's; how strongly is estimated from the spread between hosts and between paths
(moments of a beta distribution, by grouped aggregation over all documents). A document's odds are its own times
those of its site without itself, against the corpus's.

Cases: a null or empty text has no evidence of its own (its probability is the corpus's share of good labels) and is
not kept. A null source is a site of its own. Without labels of both kinds every probability is the prior and
all documents with text are kept. Repeated rows count each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import row_key, written
from tapeline.llm.grams import class_log_probabilities, scored

#: Labels for fitting at most; bounds of the priors' strengths and of probabilities; how strongly a site may move odds.
SAMPLE, WEAKEST, STRONGEST, EDGE, SITE_WEIGHT = 20_000, 2.0, 10_000.0, 1e-6, 0.5


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small penalty; flat if only one class is there."""
    if len(set(y.tolist())) < 2:
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        beta = beta + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        beta = np.clip(beta, -60, 60)
    return float(beta[0]), float(beta[1])


def label_sample(labels: DataFrame, ident: str, label: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` labels, one per id (the least), by hash order."""
    one = labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(ident).alias("__id")).agg(F.min(label).alias("label"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(most)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(q / (1 - q))


def strength(mean: Column, prior: Column, n: Column) -> Column:
    """Pseudo-count of a beta prior over group means: v(1 - v) / (spread beyond sampling) - 1."""
    spread = F.sum(n * (mean - prior) * (mean - prior)) / F.sum(n)
    noise = F.sum(prior * (1 - prior)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(F.coalesce(F.avg(prior * (1 - prior)) / between - 1, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST))


def classify(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", site: str = "source", label: str = "quality", least: float = 0.35, sample: int = SAMPLE, train: DataFrame | None = None) -> DataFrame:
    """train: a table like docs that the labels belong to, docs themselves if none is given. One row per document: doc_id, content, host, path, doc_probability, host_posterior, path_posterior, quality_probability, kept."""
    host, path = F.substring_index(F.coalesce(F.col(site), F.lit("")), "/", 1), F.regexp_extract(F.coalesce(F.col(site), F.lit("")), r"^[^/]*/([^/?#]*)", 1)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("content", row_key("text", "host", "path"))
    chosen = written(label_sample(labels, ident, label, sample), "quality-labels")
    known = rows if train is None else train.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = known.join(F.broadcast(chosen), known["doc_id"] == chosen["__id"])  # at most `sample` rows of two numbers
    one = known.groupBy("__id").agg(F.min("label").cast("string").alias("label"), F.min("text").alias("text"))
    fitted = written(one.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)).cast("int")), "quality-sample")
    of = lambda part: class_log_probabilities(part.select("label", "text"), ["0", "1"], fold=False)
    evidence = lambda part: part.withColumn("evidence", F.col("mean_ll")[1] - F.col("mean_ll")[0]).drop("mean_ll")
    score = written(evidence(scored(rows, "text", of(fitted), fold=False)), "quality-scores")
    halves = [evidence(scored(fitted.where(F.col("half") == h), "text", of(fitted.where(F.col("half") != h)), fold=False)) for h in (0, 1)]
    pairs = halves[0].unionByName(halves[1]).where("n_grams > 0").select("evidence", F.col("label").cast("double")).toArrow()  # one row per label of the sample
    y = pairs["label"].to_numpy()
    slope, offset = fit_logistic(pairs["evidence"].to_numpy(), y) if len(y) else (0.0, 0.0)
    share = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        least = 0.0

    own = F.when(F.col("n_grams") > 0, 1 / (1 + F.exp(-F.least(F.greatest(F.col("evidence") * slope + offset, F.lit(-13.0)), F.lit(13.0))))).otherwise(F.lit(share))
    score = score.withColumn("p", own)
    sites = written(score.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "quality-sites")
    whole = sites.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mu = float(((whole["good"] or 0.0) + 0.5) / ((whole["n"] or 0) + 1.0))
    hosts = sites.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    host_strength = float(hosts.agg(strength(F.col("host_good") / F.col("host_n"), F.lit(mu), F.col("host_n"))).first()[0])
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + host_strength * mu) / (F.col("host_n") + host_strength))
    sites = written(sites.join(hosts, "host"), "quality-posteriors")
    path_strength = float(sites.agg(strength(F.col("good") / F.col("n"), F.col("host_posterior"), F.col("n"))).first()[0])
    joined = score.join(sites.withColumnsRenamed({"host": "__h", "path": "__p"}), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")))
    # without the document itself
    host_rest = (F.col("host_good") - F.col("p") + host_strength * mu) / (F.col("host_n") - 1 + host_strength)
    joined = joined.withColumn("host_rest", host_rest)
    joined = joined.withColumn("site_rest", (F.col("good") - F.col("p") + path_strength * F.col("host_rest")) / (F.col("n") - 1 + path_strength))
    odds = logit(F.col("p")) + SITE_WEIGHT * (logit(F.col("site_rest")) - logit(F.lit(mu)))
    joined = joined.withColumn("quality_probability", 1 / (1 + F.exp(-odds)))
    return joined.select(
        "doc_id", "content", "host", "path", F.col("p").alias("doc_probability"), "host_posterior",
        ((F.col("good") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)).alias("path_posterior"),
        "quality_probability", ((F.col("n_grams") > 0) & (F.col("quality_probability") >= least)).alias("kept"),
    )
