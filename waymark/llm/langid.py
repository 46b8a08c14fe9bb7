"""Language identification: the average of hashed subword embeddings through a linear
softmax, trained by stochastic gradient descent, with calibrated rejection."""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, for_python, held_out, sampled

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
DIMENSIONS = 16
#: Labelled documents of each language that the model is fitted on, at most (about).
PER_LANGUAGE = 800
#: Share of right answers that the kept ones shall have, for rejection.
PRECISION = 0.98
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)),
        dtype=bool, count=sys.maxunicode + 1,
    )


def subwords(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram size the bucket of every n-gram of the texts' words, a mark at
    either end, with the number of its text; and the number of letters of each text."""
    lowered = [t.lower() for t in texts]
    joined = "".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letters()[codes.astype(np.int64)]
    counts = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what stands between words, one character is left
    keep[0] = True
    codes = np.where(letter, codes, np.uint64(0))[keep]
    owner = owner[keep]
    found = []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        whole = np.ones(m, dtype=bool)
        h = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            part = codes[j : j + m]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                whole &= part != 0
        whole &= (codes[:m] != 0) | (codes[1 : m + 1] != 0)
        ids = ((h[whole] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(BUCKETS)
        found.append((ids.astype(np.int64), owner[1 : m + 1][whole]))
    return found, counts


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float  # below it, a caller may reject

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each language for each text, and the texts' numbers of letters."""
        out = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), dtype=np.int64)
        for first, some in blocks(texts):
            found, counts = subwords(some)
            sums, n = np.zeros((len(some), len(self.languages))), np.zeros(len(some))
            for ids, owner in found:
                n += np.bincount(owner, minlength=len(some))
                for k in range(len(self.languages)):
                    sums[:, k] += np.bincount(
                        owner, weights=self.logits[ids, k], minlength=len(some)
                    )
            out[first : first + len(some)] = sums / np.maximum(n, 1)[:, None]
            letters[first : first + len(some)] = counts
        return _softmax((out + self.bias) / self.temperature), letters


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with their shares."""
    ids = np.concatenate([i for i, _ in subwords([text])[0]])
    found, n = np.unique(ids, return_counts=True)
    return found, n / max(1, n.sum())


def fit(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 6) -> Model | None:
    """None if there is nothing to learn from. Whole texts and short pieces of them are
    learned; a fifth of the texts is kept for temperature and threshold."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    order = rng.permutation(len(texts))
    train, calibrate = [], []
    for place, i in enumerate(order):
        words = texts[i].split()
        pieces = [texts[i]]
        for size in (3, 12):
            if len(words) > size:
                at = int(rng.integers(0, len(words) - size))
                pieces.append(" ".join(words[at : at + size]))
        side = calibrate if place % 5 == 0 else train
        side += [(*_bag(p), number[labels[i]]) for p in pieces]
    train = [x for x in train if len(x[0])]
    k = len(languages)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    weights += rng.normal(0, 0.1, weights.shape)
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for i in rng.permutation(len(train)):
            ids, share, label = train[i]
            x = share @ table[ids]
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            weights -= 0.1 * rate * np.outer(x, p)
            bias -= 0.01 * rate * p
            table[ids] -= rate * share[:, None] * back
    logits = table @ weights
    temperature, threshold = 1.0, 0.0
    known = [x for x in calibrate if len(x[0])]
    if known:
        z = np.array([share @ logits[ids] for ids, share, _ in known]) + bias
        y = np.array([label for *_, label in known])
        picks = np.geomspace(0.05, 20, 61)
        losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in picks]
        temperature = float(picks[int(np.argmin(losses))])
        p = _softmax(z / temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y
        best = np.argsort(-score, kind="stable")
        precise = np.cumsum(right[best]) / np.arange(1, len(best) + 1) >= PRECISION
        threshold = float(score[best][np.nonzero(precise)[0][-1]]) if precise.any() else 1.0
    return Model(languages, logits, bias, temperature, threshold)


def train(
    documents: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> Model | None:
    """Fitted on `documents`; rows with null text, lang or id are not learned from."""
    known = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    ).dropna()
    rows = sampled(known, "lang", per_language).select("doc_id", "text", "lang").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "text"])
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def identify(
    documents: DataFrame, model: Model | None, reject: bool = True, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    The score is the calibrated probability of the best language. `und` with score 0
    stands where the text is null or has no letter, or there is no model. A score below
    the model's threshold is `rejected`, and `und` as well if `reject`. Repeated rows
    get equal results.
    """
    docs = for_python(documents).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        best = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
        if m is None or not len(texts):
            return best
        p, letters = m.probabilities(texts.fillna("").tolist())
        score = p.max(axis=1)
        rejected = score < m.threshold
        names = np.array(m.languages, dtype=object)[p.argmax(axis=1)]
        unknown = (letters == 0) | (rejected if reject else False)
        best["lang_pred"] = np.where(unknown, UNKNOWN, names)
        best["score"] = np.where(letters == 0, 0.0, score)
        best["rejected"] = rejected | (letters == 0)
        return best

    return docs.withColumn("p", predict("text")).select("doc_id", "p.*")


def identify_held_out(documents: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned outside the held-out fold,
    predicted everywhere."""
    model = train(documents.where(~held_out(F.col("doc_id"), folds, held)))
    found = identify(documents, model, reject=False)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred",
        "score", "rejected",
    )
