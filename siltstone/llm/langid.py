"""Language identification: unigram pieces of a fixed public vocabulary, segmentations summed out.

Each language has a probability for every piece of the vocabulary. A word's likelihood is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. The probabilities are learned by expectation maximisation over word counts of a bounded
sample (`max_rows` texts a language, by hash, equal texts once); the model has a fixed size.

Words are runs of letters in lower case. Whole texts are read; the likelihoods of words are kept in
a bounded cache. A null text, or one without a letter, is `und` with score 0, as is any text when
nothing could be learned. Rows without language are not learned from; repeated rows are predicted
each; other columns are ignored. Equal likelihoods go to the first language in order of name.
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

from siltstone.llm.folds import fold, sampled

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNDETERMINED = "und"
ROUNDS = 4
#: Longer words are scored in logarithms, one by one, as their probabilities underflow.
LONG_WORD = 24
CACHE_WORDS = 400_000


def vocabulary(path: str) -> list[str]:
    """The pieces of letters of a sentencepiece model, in lower case, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if p == MARK or (body := p.removeprefix(MARK)).isalpha() and body == body.lower()]


class Lattice:
    """All pieces inside words, as arcs; the last piece number stands for a letter outside the vocabulary."""

    def __init__(self, pieces: list[str]) -> None:
        self.unknown = len(pieces)
        self.table: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            for k in range(1, len(piece)):
                self.table.setdefault(piece[:k], -1)
            self.table[piece] = i

    def arcs_of(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) over the word with its mark."""
        s, get, arcs = MARK + word, self.table.get, []
        size = len(s)
        for i in range(size):
            single = False
            for j in range(i + 1, size + 1):
                piece = get(s[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    arcs.append((i, j, piece))
                    single = single or j == i + 1
            if not single:
                arcs.append((i, i + 1, self.unknown))
        return arcs

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every arc of some words, in order of word and start."""
        of, flat = [], []
        for k, word in enumerate(words):
            own = self.arcs_of(word)
            of.append(len(own))
            flat += own
        table = np.array(flat, dtype=np.int32).reshape(-1, 3)
        return np.repeat(np.arange(len(words), dtype=np.int32), of), table[:, 0], table[:, 1], table[:, 2]


def forward(arcs: tuple, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: probability of all segmentations up to a position."""
    word, start, end, piece = arcs
    alpha = np.zeros((len(sizes), int(sizes.max()) + 1, p.shape[1]))
    alpha[:, 0] = 1
    order = np.argsort(end, kind="stable")
    bounds = np.searchsorted(end[order], np.arange(1, alpha.shape[1] + 1))
    for e in range(1, alpha.shape[1]):
        own = order[bounds[e - 1] : bounds[e]]
        if len(own):
            w = word[own]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[w[first], e] = np.add.reduceat(alpha[w, start[own]] * p[piece[own]], first, axis=0)
    return alpha


def backward(arcs: tuple, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """beta[word, position, language]: probability of all segmentations from a position on."""
    word, start, end, piece = arcs
    beta = np.zeros((len(sizes), int(sizes.max()) + 1, p.shape[1]))
    beta[np.arange(len(sizes)), sizes] = 1
    order = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[order], np.arange(0, beta.shape[1] + 1))
    for s in range(beta.shape[1] - 1, -1, -1):
        own = order[bounds[s] : bounds[s + 1]]
        if len(own):
            w = word[own]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            beta[w[first], s] = np.add.reduceat(beta[w, end[own]] * p[piece[own]], first, axis=0)
    return beta


def learn(lattice: Lattice, words: list[str], counts: np.ndarray, smoothing: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over its word counts.

    A word of more than LONG_WORD letters is learned from in stretches of so many.
    """
    size = lattice.unknown + 1
    cuts = [[w[k : k + LONG_WORD] for k in range(0, len(w), LONG_WORD)] for w in words]
    counts = np.repeat(counts, [len(c) for c in cuts]) if words else counts
    words = [part for c in cuts for part in c]
    p = np.full((size, 1), 1 / size)
    if not words:
        return p[:, 0]
    arcs = lattice.arcs(words)
    sizes = np.array([len(w) + 1 for w in words])
    word, start, end, piece = arcs
    for _ in range(ROUNDS):
        alpha, beta = forward(arcs, sizes, p)[:, :, 0], backward(arcs, sizes, p)[:, :, 0]
        share = alpha[word, start] * p[piece, 0] * beta[word, end] / beta[word, 0]
        expected = np.bincount(piece, weights=share * counts[word], minlength=size) + smoothing
        p = (expected / expected.sum())[:, None]
    return p[:, 0]


@dataclass
class Model:
    """Languages, pieces, and p[piece, language]."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray
    _lattice: Lattice | None = None
    _at: dict[str, int] = field(default_factory=dict)
    _known: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p, "_lattice": None, "_at": {}, "_known": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word under each language."""
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            chosen = [words[i] for i in part]
            sizes = np.array([len(w) + 1 for w in chosen])
            alpha = forward(self._lattice.arcs(chosen), sizes, self.p)
            out[part] = np.log(alpha[np.arange(len(part)), sizes])
        logs = np.log(self.p)
        for i in set(range(len(words))) - set(short):
            best = [np.zeros(len(self.languages))] + [np.full(len(self.languages), -np.inf)] * (len(words[i]) + 1)
            for s, e, piece in self._lattice.arcs_of(words[i]):
                best[e] = np.logaddexp(best[e], best[s] + logs[piece])
            out[i] = best[-1]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability (equal priors) of each text."""
        found = [WORD.findall((t or "").lower()) for t in texts]
        if len(self._at) > CACHE_WORDS:
            self._at, self._known = {}, None
        new = list({w for words in found for w in words if w not in self._at})
        if new:
            base = len(self._at)
            self._at.update(zip(new, range(base, base + len(new))))
            scores = self.word_scores(new)
            self._known = scores if self._known is None else np.concatenate([self._known, scores])
        names, scores = [], []
        for words in found:
            if not self.languages or not any(c.isalpha() for w in words for c in w):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self._known[[self._at[w] for w in words]].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return names, scores


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"]):
            counts.update((lang, w) for w in WORD.findall(text.lower()))
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])


def fit(docs: DataFrame, vocab_path: str, keep: Column | None = None, max_rows: int = 500) -> Model:
    """Learn from at most about `max_rows` texts of each language, of the rows for which `keep` holds."""
    pieces = vocabulary(vocab_path)
    known = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    if keep is not None:
        known = known.where(keep)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, max_rows / n))])
    # Rows without id are told apart by their text.
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"))
    chosen = known.where(sampled(key, rates[F.col("lang")])).groupBy("text").agg(F.min("lang").alias("lang"))
    counts = chosen.mapInPandas(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    lattice, languages = Lattice(pieces), sorted(counts["lang"].unique())
    columns = []
    for language in languages:
        own = counts[counts["lang"] == language].sort_values("word")
        columns.append(learn(lattice, own["word"].tolist(), own["n"].to_numpy(float)))
    return Model(languages, pieces, np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs`, from its whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for batch in batches:
            # A few hundred texts at a time keep the words of a batch few.
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                names, scores = own.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, lang_pred string, score double")


def language_query(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Predict all of `docs` with a model of the rows outside fold 1 of 3."""
    model = fit(docs, vocab_path, keep=fold(F.col("doc_id"), 3) != 1)
    return predicted(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
