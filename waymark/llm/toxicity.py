"""Toxicity of texts whose words may be disguised: a noisy-channel decoder restores
them under a character language model, and the restored words are scored."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Container, Iterable, Iterator, Set
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, for_python, held_out, sampled, store

#: Labelled documents of each label that the classifier is fitted on, at most (about).
PER_LABEL = 5000
#: Features of the classifier, at most.
FEATURES = 400
#: Share of the toxic documents that a feature is met in, at least.
LEAST = 0.01
#: Words are known by themselves and by beginnings of these lengths.
STEMS = range(4, 9)

#: What a sign may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
    "€": "e", "£": "l", "¡": "i", "&": "a", "%": "x", "#": "h",
}
#: Log probabilities of the channel.
SWAP, DROP, HOLD, FOLD = -1.5, -1.0, -0.2, -0.7
#: Letters of the language model, with the mark of a word's end: a-z, those of Latin-1,
#: and one for all others.
ALPHABET = 60
#: Weight of the next lower order when the model has seen little.
PRIOR = 4.0
#: Letters of what is put together from parts of a word, at most; nothing said is that
#: long. Longer pieces of text are read as well, but not remembered.
LONGEST = 40
#: Words that a worker remembers.
MEMORY = 400_000
NOTHING: frozenset[str] = frozenset()

#: Three or more single characters with white space between.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
LETTERS = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(.)\1*", re.S)
DOUBLED = re.compile(r"(.)\1")
#: Signs that stand between words: any, or only those that are never letters.
SIGNS = re.compile(r"[\W_]+")
JOINTS = re.compile("(?:(?![" + re.escape("".join(LEET)) + r"])[\W_])+")


def symbol(letter: str) -> int:
    code = ord(letter)
    if 97 <= code <= 122:
        return code - 96
    return code - 0xDF + 27 if 0xDF <= code <= 0xFE else ALPHABET - 1


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Counts, by number, of the trigrams of the words of `texts`, with two marks before
    a word and one behind."""
    if not _symbols:
        letters = (chr(c) for c in range(0x10000))
        _symbols.append(np.array([symbol(c) if c.isalpha() else 0 for c in letters]))
    joined = "\n".join(["", *texts, ""]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _symbols[0][np.minimum(codes, 0xFFFF)]
    a, b, c = low[:-2], low[1:-1], low[2:]
    grams = ((a * ALPHABET + b) * ALPHABET + c)[b != 0]
    first = low[1:][(low[:-1] == 0) & (low[1:] != 0)]
    return np.bincount(np.concatenate((grams, first)), minlength=ALPHABET**3)


_symbols: list[np.ndarray] = []


def trigram_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over all `documents`; there are ALPHABET ** 3 different ones at most."""
    docs = for_python(documents).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ALPHABET**3, dtype=np.int64)
        for batch in batches:
            for _, some in blocks(batch["text"].tolist()):
                total += count_trigrams(some)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"gram": met, "n": total[met]})

    return docs.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Speller:
    """The language model and the decoder. `grams` maps trigrams to counts; counts of
    pairs and letters follow from them."""

    grams: dict[int, int]
    pairs: dict[int, int] = field(default_factory=dict)
    follow: dict[int, int] = field(default_factory=dict)
    single: dict[int, int] = field(default_factory=dict)
    total: int = 0

    def __post_init__(self) -> None:
        for g, n in self.grams.items():
            ab, c = divmod(g, ALPHABET)
            b = ab % ALPHABET
            self.pairs[ab] = self.pairs.get(ab, 0) + n
            bc = b * ALPHABET + c
            self.follow[bc] = self.follow.get(bc, 0) + n
            self.single[c] = self.single.get(c, 0) + n
            self.total += n
        self._after: dict[int, int] = {}
        for bc, n in self.follow.items():
            self._after[bc // ALPHABET] = self._after.get(bc // ALPHABET, 0) + n
        self._memo: dict[int, float] = {}

    def step(self, a: int, b: int, c: int) -> float:
        """Log probability of c after a, b; orders are interpolated."""
        key = (a * ALPHABET + b) * ALPHABET + c
        found = self._memo.get(key)
        if found is None:
            p1 = (self.single.get(c, 0) + 0.1) / (self.total + 0.1 * ALPHABET)
            p2 = (self.follow.get(b * ALPHABET + c, 0) + PRIOR * p1) / (self._after.get(b, 0) + PRIOR)
            p3 = (self.grams.get(key, 0) + PRIOR * p2) / (
                self.pairs.get(a * ALPHABET + b, 0) + PRIOR
            )
            found = self._memo[key] = math.log(p3)
        return found

    def letters(self, word: str) -> list[str]:
        """The likeliest letters behind each run of a lower-case `word` by Viterbi. Runs of
        one sign may stand for one or two letters, signs for letters or for nothing. The
        cost is that of the runs, however long they are."""
        # A state has its score and, as a chain, the letters of the runs so far.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for m in RUN.finditer(word):
            sign, length = m[1], m.end() - m.start()
            choices = _choices(sign, min(length, 3))
            if len(states) == 1 and len(choices) == 1:  # no rival, no score
                _, letters, codes = choices[0]
                (place, (score, chain)), = states.items()
                states = {(place + codes)[-2:]: (score, (chain, letters))}
                continue
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in states.items():
                for cost, letters, codes in choices:
                    x, y, s = a, b, score + cost
                    for k in codes:
                        s += self.step(x, y, k)
                        x, y = y, k
                    best = following.get((x, y))
                    if best is None or s > best[0]:
                        following[x, y] = (s, (chain, letters))
            states = following
        ends = [(s + self.step(a, b, 0), chain) for (a, b), (s, chain) in states.items()]
        chain, out = max(ends, key=lambda e: e[0])[1], []
        while chain is not None:
            chain, letters = chain
            out.append(letters)
        return out[::-1]

    def restore(self, word: str) -> str:
        return "".join(self.letters(word))


@functools.cache
def _choices(sign: str, length: int) -> list[tuple[float, str, tuple[int, ...]]]:
    """What a run of `sign` may stand for, 3 meaning 3 or more, with log probabilities."""
    out: list[tuple[float, str]] = []
    if sign.isalpha():
        out.append((HOLD if length == 1 else FOLD, sign))
        if length > 1:
            out.append((HOLD if length == 2 else FOLD, sign * 2))
    else:
        for x in LEET.get(sign, ""):
            out.append((SWAP, x))
            if length > 1:
                out.append((SWAP + FOLD, x * 2))
        if not sign.isdigit():
            out.append((DROP, ""))
    return [(p, x, tuple(map(symbol, x))) for p, x in out or [(DROP, "")]]


def _noisy(core: str) -> bool:
    """Whether a word may be disguised: signs or repeated letters. Digits alone are a
    number."""
    if core.isalpha():
        return bool(DOUBLED.search(core))
    return any(c.isalpha() or c in LEET and not c.isdigit() for c in core)


class Reader:
    """Restored words of texts, with a memory."""

    def __init__(self, grams: dict[int, int]) -> None:
        self.speller = Speller(grams)
        self.memory: dict[str, Set[str]] = {}

    def restored(self, raw: str) -> set[str]:
        """The words that a piece of text without space may stand for."""
        word = raw.lower()
        if word.isalpha() and not _noisy(word):
            return {word} if len(word) > 2 else set()
        core = word.strip(".,;:!?\"'()[]{}<>*#%&|=~-_+$@/\\")
        found = {core} if core.isalpha() else set(LETTERS.findall(core))
        outer = word.strip(".,;:?\"'[]{}<>*=~-_/\\")
        inner = outer.rstrip("!")
        # Signs at the ends may be letters or not.
        for x in {core, inner, outer}:
            if _noisy(x):
                found |= self.readings(x)
        return {w for w in found if len(w) > 2}

    def readings(self, word: str) -> set[str]:
        """The likeliest letters behind `word` as a whole, behind its parts between signs,
        and what stands between any two signs that are none."""
        letters = self.speller.letters(word)
        out = {"".join(letters)}
        if word.isalpha():
            return out
        for part in {*SIGNS.split(word), *JOINTS.split(word)} - {word}:
            if _noisy(part):
                out.add(self.speller.restore(part))
        parts = [""]
        for x in letters:
            if x:
                parts[-1] += x
            elif parts[-1]:
                parts.append("")
        for i in range(len(parts) if len(parts) > 1 else 0):
            joined = ""
            for k in range(i, len(parts)):
                joined += parts[k]
                if len(joined) > LONGEST:
                    break
                out.add(joined)
        return out

    def features(self, text: str, known: Container[str] | None = None) -> set[str]:
        """Stems of the restored words of `text`; only those in `known`, if given. A
        reader is asked with one `known` only."""
        out: set[str] = set()
        memory = self.memory
        for raw in set(text.split()):
            found = memory.get(raw)
            if found is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                found = stems(self.restored(raw))
                if known is not None:
                    found = {s for s in found if s in known}
                found = found or NOTHING
                if len(raw) <= LONGEST:
                    memory[raw] = found
            if found:
                out |= found
        return out

    def spelled(self, text: str) -> list[str]:
        """What is spelled out in single characters, restored."""
        out = []
        for m in SPACED.finditer(text):
            letters = "".join(m[0].split()).lower()
            if len(set(letters)) > 1:  # one sign again and again says nothing
                out.append(self.speller.restore(letters))
        return out


def stems(words: set[str]) -> set[str]:
    """Features: every word with an end mark, and its beginnings."""
    out = {w + "$" for w in words}
    for w in words:
        for k in STEMS:
            if len(w) < k:
                break
            out.add(w[:k])
    return out


def heard(said: Iterable[str], words: Iterable[str]) -> set[str]:
    """Features of those of `words` that are in spelled-out passages; words of three
    letters or fewer are a passage by themselves."""
    said = list(said)
    return stems({w for w in words for x in said if (w in x if len(w) > 3 else w == x)})


@dataclass(frozen=True)
class Model:
    grams: dict[int, int]
    weights: dict[str, float]
    bias: float
    #: Words that are looked for in spelled-out passages.
    words: tuple[str, ...] = ()


def _logistic(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 0.02
) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with an L2 penalty on the weights. Features
    speak for toxicity only: those that get a negative weight are left out."""
    used = np.arange(x.shape[1])
    while True:
        z = np.hstack([x[:, used], np.ones((len(x), 1))])
        ridge = np.append(np.full(len(used), penalty), 1e-6)
        beta = np.zeros(len(used) + 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gradient = z.T @ (w * (p - y)) + ridge * beta
            hessian = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        good = beta[:-1] >= 0
        if good.all():
            weights = np.zeros(x.shape[1])
            weights[used] = beta[:-1]
            return weights, float(beta[-1])
        used = used[good]


def train(
    documents: DataFrame, labels: DataFrame, corpus: DataFrame | None = None,
    per_label: int = PER_LABEL, features: int = FEATURES,
) -> Model:
    """The language model counts all of `corpus` (`documents` by default). The classifier
    is fitted on a bounded sample of the rows of `documents` (doc_id, text) that
    `labels` (doc_id, toxic) marks 0 or 1; nulls are left out, and of labels that
    contradict each other the higher counts. Without labels every score is 0.5 or less.
    """
    spark = documents.sparkSession
    counts = trigram_counts(documents if corpus is None else corpus)
    grams = {r["gram"]: r["n"] for r in counts.collect()}
    marked = labels.select("doc_id", "toxic").where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Two labels with a bounded number of rows each: small enough to broadcast.
    picked = store(sampled(marked, "toxic", per_label), "toxic-sample")
    shared = spark.sparkContext.broadcast(grams)
    rows = for_python(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), "doc_id"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for batch in batches:
            found = [sorted(reader.features(t)) for t in batch["text"]]
            yield pd.DataFrame({
                "toxic": batch["toxic"].astype("int64"), "rate": batch["_rate"], "stems": found,
                "said": [reader.spelled(t) for t in batch["text"]],
            })

    read_rows = store(
        rows.mapInPandas(
            read, "toxic long, rate double, stems array<string>, said array<string>"
        ),
        "toxic-stems",
    )
    sizes = {r["toxic"]: r["count"] for r in read_rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(grams, {}, 5.0 if n1 else -5.0)
    # How far the share among toxic documents exceeds that among the others.
    a, b = F.col("a"), F.col("n") - F.col("a")
    gain = a * F.log((a + 0.5) / (b + 0.5) * F.lit(n0 / n1))

    def telling() -> DataFrame:
        each = read_rows.select("toxic", F.explode("stems").alias("stem")).groupBy("stem").agg(
            F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")
        ).where((F.col("a") >= 4) & (F.col("a") >= n1 * LEAST))
        return each.where(a * n0 > b * n1 * 3)

    # Words that tell where they are written are known where they are spelled out.
    ends = telling().where(F.col("stem").endswith("$")).orderBy("stem").select("stem").collect()
    words = tuple(r["stem"][:-1] for r in ends)

    @F.pandas_udf("array<string>")
    def told(said: pd.Series) -> pd.Series:
        return pd.Series([sorted(heard(x, words)) for x in said], dtype=object)

    read_rows = store(
        read_rows.select(
            "toxic", "rate",
            F.when(F.size("said") > 0, F.array_union("stems", told("said"))).otherwise(
                F.col("stems")
            ).alias("stems"),
        ),
        "toxic-heard",
    )
    best = telling().orderBy(gain.desc(), "stem").limit(features)
    names = [r["stem"] for r in best.select("stem").collect()]
    wanted = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    data = read_rows.select(
        "toxic", "rate", F.sort_array(F.array_intersect("stems", wanted)).alias("stems")
    ).groupBy("toxic", "rate", "stems").count().collect()
    place = {x: i for i, x in enumerate(names)}
    data.sort(key=lambda r: (r["toxic"], r["stems"]))
    x = np.zeros((len(data), len(names)))
    for i, r in enumerate(data):
        x[i, [place[s] for s in r["stems"]]] = 1
    y = np.array([r["toxic"] for r in data], dtype=float)
    w = np.array([r["count"] / r["rate"] for r in data])
    weights, bias = _logistic(x, y, w)
    known = dict(zip(names, map(float, weights), strict=True))
    return Model(grams, known, bias, tuple(x for x in words if not stems({x}).isdisjoint(known)))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The score from 0 to 1 of a column of texts, none of them null."""
    plain = (model.grams, model.weights, model.bias, model.words)
    shared = spark.sparkContext.broadcast(plain)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, weights, bias, words = shared.value
        reader = Reader(grams)
        for texts in batches:
            out = []
            for text in texts:
                met = reader.features(text, weights)
                met |= heard(reader.spelled(text), words) & weights.keys()
                z = bias + sum(weights[s] for s in sorted(met))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pd.Series(out, dtype="float64")

    return rate


def score(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score from 0 to 1 and predicted (score >= 0.5) of every row. Null text is
    empty; an empty text has the score of no evidence; rows equal in text have equal
    scores."""
    rate = scorer(documents.sparkSession, model)
    scored = for_python(documents).select(
        F.col(id_col).alias("doc_id"),
        rate(F.coalesce(F.col(text_col), F.lit(""))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents` (text and any other columns) that score below `threshold`."""
    rate = scorer(documents.sparkSession, model)
    return for_python(documents).where(rate(F.coalesce("text", F.lit(""))) < threshold)


def train_outside(
    documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0
) -> Model:
    """Labels are learned outside the held-out fold, the language model counts every
    text."""
    fold = held_out(F.col("doc_id"), folds, held)
    return train(documents.where(~fold), labels.where(~fold), corpus=documents)


def score_held_out(
    documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned as in `train_outside`."""
    found = score(documents, train_outside(documents, labels, folds, held))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), "score", "predicted"
    )
