"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram of a word (lower case, marked at both ends) and is present in a text
if any word of the whole text has it. Its value is the log ratio of its smoothed counts in toxic and
clean texts; logistic regression with an L2 penalty weighs the scaled features.

The fit takes a bounded sample of labelled rows (`max_rows` a class, by hash, equal texts once) and
at most `max_features` n-grams, so the model is of fixed size and goes to every task. Scoring reads
whole texts, word by word, each word's features looked up once and kept in a bounded cache.

Null and empty texts score as texts without features; a null label is no label; repeated rows are
scored each; without labels of both classes the score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import small_batches, trim
from siltstone.llm.folds import fold, sampled

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 6
CACHE_WORDS = 100_000
#: Texts whose n-grams a task counts at once.
COUNT_TEXTS = 100


@dataclass
class Model:
    """Feature n-grams, the weight of each (ratio included), and the intercept."""

    grams: list[str]
    weights: np.ndarray
    intercept: float
    _index: dict[str, int] | None = None
    _cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "weights": self.weights, "intercept": self.intercept, "_index": None, "_cache": {}}

    def features(self, text: str | None) -> set[int]:
        """Positions of the n-grams present in a text."""
        if self._index is None:
            self._index = {g: i for i, g in enumerate(self.grams)}
        cache, index, found = self._cache, self._index, set()
        for word in set(WORD.findall((text or "").lower())):
            own = cache.get(word)
            if own is None:
                own = tuple({index[g] for g in grams_of(word) if g in index})
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = own
            if own:
                found.update(own)
        return found

    def score(self, text: str | None) -> float:
        found = self.features(text)
        z = self.intercept + (float(self.weights[sorted(found)].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def grams_of(word: str) -> list[str]:
    """N-grams of a word between `<` and `>`; a shorter word is one n-gram."""
    marked = f"<{word}>"
    size = len(marked)
    if size <= SHORTEST:
        return [marked]
    return [marked[i : i + n] for n in range(SHORTEST, min(LONGEST, size) + 1) for i in range(size - n + 1)]


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many clean and toxic texts each n-gram is, for a few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), COUNT_TEXTS):
            part = batch.iloc[at : at + COUNT_TEXTS]
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(part["text"], part["toxic"]):
                found: set[str] = set()
                for word in set(WORD.findall(text.lower())):
                    found.update(grams_of(word))
                counts[int(label)].update(found)
            grams = list(counts[0].keys() | counts[1].keys())
            if grams:  # Arrow makes no record of a frame without rows
                yield pd.DataFrame({"gram": grams, "clean": [counts[0][g] for g in grams], "toxic": [counts[1][g] for g in grams]})
    trim()


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = 2500, max_features: int = 4000, min_texts: int = 3, min_z: float = 4.5, min_ratio: float = 0.7, penalty: float = 1e-3) -> Model:
    """Fit on at most about `max_rows` toxic and twice as many clean texts, of the rows of `labels` for which `keep` holds.

    Features are the `max_features` n-grams whose shares in the classes differ by most standard
    deviations, of those in at least `min_texts` texts with `min_z` deviations and a log ratio of
    `min_ratio`. If few labels let none pass, the n-grams that differ most are taken without these two.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([], np.zeros(0), 500.0 if sizes.get(1) else -500.0)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_rows / sizes[1]))).otherwise(F.lit(min(1.0, 2 * max_rows / sizes[0])))
    chosen = known.where(sampled(F.col("doc_id"), rate))
    # The chosen labels are bounded by max_rows, so they go to the texts and not the texts to them.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    try:
        n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        counted = texts.mapInPandas(_gram_counts, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        p, q = (F.col("toxic") + 1) / (n1 + 1), (F.col("clean") + 1) / (n0 + 1)
        # How far the shares of the classes differ, in standard deviations of a shared one.
        pooled = (F.col("toxic") + F.col("clean")) / (n1 + n0)
        deviation = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / max(n1, 1) + 1 / max(n0, 1)))
        z = (F.col("toxic") / max(n1, 1) - F.col("clean") / max(n0, 1)) / deviation
        counted = counted.where(F.col("clean") + F.col("toxic") >= min(min_texts, n1 + n0)).select("gram", F.log(p / q).alias("ratio"), z.alias("z"))
        passing = (F.abs("z") >= min_z) & (F.abs("ratio") >= min_ratio)
        top = counted.orderBy(passing.desc(), F.abs("z").desc(), "gram").limit(max_features).select("gram", "ratio", passing.alias("passing")).collect()
        if any(r["passing"] for r in top):
            top = [r for r in top if r["passing"]]
        grams, ratios = [r["gram"] for r in top], np.array([r["ratio"] for r in top])
        model = Model(grams, np.zeros(len(grams)), 0.0)
        if not grams:
            share = sizes[1] / (sizes[0] + sizes[1])
            return Model([], np.zeros(0), float(np.log(share / (1 - share))))

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "found": [sorted(model.features(t)) for t in batch["text"]]})

        rows = texts.mapInPandas(features, "toxic int, found array<int>").toPandas()
    finally:
        texts.unpersist()
    shift = np.log(sizes[1] / sizes[0]) - np.log(max(n1, 1) / max(n0, 1))
    weights, intercept = _logistic(rows["found"].tolist(), rows["toxic"].to_numpy(float), ratios, penalty)
    return Model(grams, weights * ratios, float(intercept + shift))


def _logistic(found: list, y: np.ndarray, ratios: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps over sparse presence features scaled by `ratios`."""
    n, k = len(found), len(ratios)
    row = np.repeat(np.arange(n), [len(f) for f in found])
    col = np.concatenate([np.asarray(f, dtype=np.int64) for f in found]) if len(row) else np.zeros(0, np.int64)
    value = ratios[col]
    # Each step is scaled by the feature's own curvature.
    curve = np.bincount(col, weights=value**2, minlength=k) / (4 * n) + penalty
    share = max(1.0, float(np.bincount(row, minlength=n).mean()) ** 0.5) if n else 1.0
    w, b, lead_w, lead_b = np.zeros(k), 0.0, np.zeros(k), 0.0
    for step in range(rounds):
        z = np.bincount(row, weights=lead_w[col] * value, minlength=n) + lead_b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(col, weights=gap[row] * value, minlength=k) / n + penalty * lead_w
        new_w, new_b = lead_w - grad / curve / (share * 4), lead_b - gap.mean()
        pace = step / (step + 3)
        lead_w, lead_b = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    return w, b


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `score` (replaced if there is one): how likely the text is toxic."""
    small_batches(docs.sparkSession)
    plain = docs.drop("score")
    held = plain.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.score(t) for t in texts], dtype="float64")
        held.value._cache.clear()
        trim()

    return plain.withColumn("score", score(F.col("text")))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all of `docs` with a model of the rows outside fold 2 of 4."""
    model = fit(docs, labels, keep=fold(F.col("doc_id"), 4) != 2)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
