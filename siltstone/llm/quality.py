"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic classifier over surface features of the whole text gives each document its own
evidence. Every document's probability (its label, where one may be learned from) counts towards its
host and its path within the host. Site rates are shrunk: paths towards their host, hosts towards
the global rate, with strengths estimated from the data by moments (grouped sums over all
documents). The posterior odds of the site's other documents, relative to the global odds, then shift
the document's. `host` and `path` name columns; `documents` has no URL, so its source and language
stand for them.

The classifier is fitted on at most about `max_rows` labelled texts, by hash. Site sums are
aggregated before they are joined back, so a host with a third of all rows is one row a task.

Nulls: a null text is empty; a null host or path is the site of its own `null`; a null label is no
label; without labels of both classes the evidence is the share of good labels (a half if none).
Repeated rows are scored each; repeated labels of an id count once, as the lowest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.folds import fold, sampled
from siltstone.scratch import written

FEATURES = ("log_words", "distinct_share", "mean_word", "upper_share", "digit_share", "symbol_share", "bar_share", "mark_share", "line_words", "squeeze", "repeat_share")
#: A document that is not labelled counts this much towards its site.
SOFT_WEIGHT = 0.25
KEEP_FROM = 0.5
NO_ID = -(2**63)
_CLASS = np.zeros(256, np.int8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b"#$%&*@^~<>{}[]=+\\_":
    _CLASS[_c] = 3
_CLASS[ord("|")] = 4
for _c in b"!?":
    _CLASS[_c] = 5
_WORDS = re.compile(r"\S+")


def features(text: str | None) -> list[float]:
    """Surface features of a whole text, in the order of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = _WORDS.findall(text)
    n, size = max(1, len(words)), max(1, len(data))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) / size
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(len(words))), len(set(words)) / n, min(len(text) / n, 40.0), float(kinds[1]), float(kinds[2]), float(kinds[3]), float(kinds[4]), float(kinds[5]),
        float(np.log1p(n / (1 + text.count("\n")))), len(zlib.compress(data, 1)) / size if data else 1.0, repeats / n,
    ]


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = 4000, rounds: int = 3000) -> dict:
    """Standardised logistic regression with squares: {mean, scale, weights, intercept}."""
    known = _known(labels, keep)
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.5
    none = np.zeros(2 * len(FEATURES))
    constant = {"mean": none, "scale": none + 1, "weights": none, "intercept": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}
    if not sizes.get(0) or not sizes.get(1):
        return constant
    rate = F.when(F.col("good") == 1, F.lit(min(1.0, max_rows / sizes[1]))).otherwise(F.lit(min(1.0, max_rows / sizes[0])))
    chosen = known.where(sampled(F.col("label_id"), rate))
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).select("text", "good").mapInPandas(_featured, "good int, x array<double>").toPandas()
    if rows["good"].nunique() < 2:
        return constant
    x = _widened(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)))
    y = rows["good"].to_numpy(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    w, b, step = np.zeros(z.shape[1]), 0.0, 1.0
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(rounds):
        gap = share * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w -= step * (z.T @ gap / len(y) + 1e-3 * w) / 4
        b -= step * gap.mean()
    return {"mean": mean, "scale": scale, "weights": w, "intercept": float(b + np.log(sizes[1] / sizes[0]))}


def _widened(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x], axis=1)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"good": batch["good"].astype("int32"), "x": [features(t) for t in batch["text"]]})


def _known(labels: DataFrame, keep: Column | None) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    if keep is not None:
        known = known.where(keep)
    return known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("good"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, rate: Column) -> float:
    """Pseudo-counts by moments: how much the rates of sites vary beyond what their sizes explain."""
    w, x = F.col("n"), F.col("good") / F.col("n")
    r = sites.where("n > 0").agg(F.sum(w).alias("w"), F.sum(w * (x - rate) ** 2).alias("s"), F.sum(w * w).alias("w2"), F.count("*").alias("k"), F.sum(w * rate * (1 - rate)).alias("v")).first()
    if not r["k"] or r["k"] < 2 or not r["w"]:
        return 100.0
    within = r["v"] / r["w"]
    between = (r["s"] - (r["k"] - 1) * within) / max(r["w"] - r["w2"] / r["w"], 1e-9)
    return float(min(1e6, max(1.0, within / max(between, 1e-9) - 1)))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: Column | None = None) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score (0 to 1) and keep (0 or 1) of every row of `docs`."""
    model = fit(docs, labels, keep)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        x = _widened(np.array([features(t) for t in texts]))
        z = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["weights"] + model["intercept"]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    sited = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("null")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("null")).alias("path"), evidence("text").alias("evidence"),
    )
    known = _known(labels, keep)
    weight = F.when(F.col("good").isNull(), F.lit(SOFT_WEIGHT)).otherwise(F.lit(1.0))
    value = F.coalesce(F.col("good").cast("double"), F.col("evidence"))
    told = sited.join(known, sited["id"] == known["label_id"], "left")
    told = written(told.select("id", "host", "path", "evidence", weight.alias("own"), (weight * value).alias("own_good")), "quality-evidence")
    paths = told.groupBy("host", "path").agg(F.sum("own").alias("n"), F.sum("own_good").alias("good"))
    paths = written(paths, "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = whole["good"] / whole["n"] if whole["n"] else 0.5
    host_strength = _strength(hosts, F.lit(rate))

    def shrunk(good: Column, n: Column, towards: Column, strength: float) -> Column:
        return (good + strength * towards) / (n + strength)

    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), shrunk(F.col("good"), F.col("n"), F.lit(rate), host_strength).alias("host_rate"))
    paths = written(paths.join(hosts, "host"), "quality-sites")
    path_strength = _strength(paths, F.col("host_rate"))
    paths = paths.withColumn("path_rate", shrunk(F.col("good"), F.col("n"), F.col("host_rate"), path_strength))
    out = told.join(paths, ["host", "path"])
    # What a document itself adds to its site is taken out again before the site shifts it.
    others = shrunk(F.col("host_good") - F.col("own_good"), F.col("host_n") - F.col("own"), F.lit(rate), host_strength)
    others = shrunk(F.col("good") - F.col("own_good"), F.col("n") - F.col("own"), others, path_strength)
    z = _logit(F.col("evidence")) + _logit(others) - _logit(F.lit(rate))
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("keep"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all of `docs`, learning from labels outside fold 3 of 5; `held_out` tells that fold."""
    out = quality_scores(docs, labels, keep=fold(F.col("doc_id"), 5) != 3)
    return out.withColumn("held_out", fold(F.col("doc_id"), 5) == 3)
