"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Neutral mentions of groups of people, interchangeable within a language.
IDENTITY_TERMS = (
    ("women", "men", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites",
     "asians", "africans", "arabs", "mexicans", "germans", "deaf", "blind", "elderly", "teenagers"),
    ("frauen", "männer", "christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "schwule", "lesben", "asiaten",
     "afrikaner", "araber", "gehörlose", "blinde", "senioren", "jugendliche"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "gays", "lesbiennes", "asiatiques",
     "africains", "arabes", "sourds", "aveugles", "aînés", "adolescents"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "gays", "lesbianas", "asiáticos",
     "africanos", "árabes", "sordos", "ciegos", "ancianos", "adolescentes"),
)
STRIP = ".,;:!?|\"'()[]{}<>*#%&$…«»“”„¿¡"
PREFIXES = (4, 5, 6)
SAMPLE, FEATURES = 20_000, 3_000  # bounds of the training sample and of the vocabulary
LEAST_ROWS, LEAST_GAIN = 4, 5.0  # rows a feature must occur in; nats of information about the label it must give
THRESHOLD, ASIDE = 0.7, 4  # toxic at this score or more; one row in so many is set aside to place it


def features_of(word: str) -> tuple[str, ...]:
    """A word without marks around it, and its beginnings."""
    w = word.strip(STRIP)
    return (w, *[f"{w[:n]}^" for n in PREFIXES if len(w) >= n]) if w else ()


def words_of(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def indices(self, words: set[str], memory: dict[str, tuple[int, ...]]) -> set[int]:
        found: set[int] = set()
        for w in words:
            got = memory.get(w)
            if got is None:
                if len(memory) > 400_000:
                    memory.clear()
                got = memory[w] = tuple(i for f in features_of(w) if (i := self.vocabulary.get(f)) is not None)
            if got:
                found.update(got)
        return found

    def score(self, words: set[str], memory: dict[str, tuple[int, ...]]) -> float:
        z = self.bias + float(self.weights[list(self.indices(words, memory))].sum()) if words else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows one after another, and the row of each."""
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.array([i for r in rows for i in r], np.int64), np.repeat(np.arange(len(rows)), lengths)


def train(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, steps: int = 600, rate: float = 0.2,
          ridge: float = 1e-5, fairness: float = 20.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; ``pairs`` are counterfactual rows whose scores (before the sigmoid) are pulled together.
    Classes weigh alike and weights stay at 0 or above: a word may be evidence of toxicity, and no other word outweighs it."""
    idx, row = _sparse(rows)
    left, lrow = _sparse([a for a, _ in pairs])
    right, rrow = _sparse([b for _, b in pairs])
    n, p = max(1, len(rows)), max(1, len(pairs))
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    w = np.zeros(size + 1)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[idx], minlength=len(rows)) + w[size]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.bincount(idx, error[row], minlength=size + 1) / n
        grad[size] = error.sum() / n
        grad[:size] += ridge * w[:size]
        if pairs:
            gap = np.bincount(lrow, w[left], minlength=len(pairs)) - np.bincount(rrow, w[right], minlength=len(pairs))
            grad += 2 * fairness * (np.bincount(left, gap[lrow], minlength=size + 1) - np.bincount(right, gap[rrow], minlength=size + 1)) / p
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(w[:size], 0, out=w[:size])
    return w[:size], float(w[size])


def counterfactuals(words: set[str], turn: int) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that differ in a mention of a group only: every mention swapped for its neighbour in the list, and the sentence
    with a neutral mention against itself."""
    out = []
    for terms in IDENTITY_TERMS:
        for k, t in enumerate(terms):
            if t in words:
                out.append((words, words - {t} | {terms[(k + 1 + turn) % len(terms)]}))
    terms = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
    out.append((words, words | {terms[turn // len(IDENTITY_TERMS) % len(terms)]}))
    return out


def calibrated(z: np.ndarray, labels: np.ndarray) -> float:
    """A cut for rows set aside: of those within a hundredth of the best F1 the middle of the widest gap between two values."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], labels[order]
    hits, rows = np.cumsum(y), np.arange(1, len(y) + 1)
    ends = np.append(z[:-1] > z[1:], True)
    f1 = np.where(ends, 2 * hits / (rows + y.sum()), -1.0)
    gaps = np.append(z[:-1] - z[1:], 0.0)
    k = int(np.argmax(np.where(f1 >= f1.max() - 0.01, gaps, -1.0)))
    return float(z[k] - gaps[k] / 2)


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from ``labelled`` (key, toxic), rows with a null in either left out; of repeated ids the larger label counts.

    Trains on at most ``sample`` rows, those of smallest hash of the id, on the driver; texts stay on the executors, which send the
    counts of features (at most ``features`` are kept, by information about the label) and the feature numbers of the sample's rows.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = (labelled.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = scratch.keep(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_toxic", "_text"))

    def present(batches):
        for batch in batches:
            found, toxic = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = {f for w in words_of(t) for f in features_of(w)}
                found += got
                toxic += [y] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int64())], names=["feature", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.sum("_toxic").alias("t")).first()
    n, t = float(total["n"] or 0), float(total["t"] or 0)
    counted = rows.select("_text", F.col("_toxic").cast("long")).mapInArrow(present, "feature string, toxic long").groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_ROWS)
    expected = F.col("n") * ((t + 0.5) / (n + 1))
    gain = F.col("t") * F.log((F.col("t") + 0.5) / (expected + 0.5)) + (F.col("n") - F.col("t")) * F.log((F.col("n") - F.col("t") + 0.5) / (F.col("n") - expected + 0.5))
    terms = sorted({f for group in IDENTITY_TERMS for w in group for f in features_of(w)})
    telling = counted.where((gain >= LEAST_GAIN) & (F.col("t") > expected))
    best = [r["feature"] for r in telling.orderBy(gain.desc(), "feature").limit(features).collect()]
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*best, *terms]))}
    blank = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)

    def numbered(batches):
        memory: dict = {}
        for batch in batches:
            out = {"id": [], "toxic": [], "own": [], "left": [], "right": []}
            for i, t, y in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                words = words_of(t)
                out["id"].append(i)
                out["toxic"].append(y)
                out["own"].append(sorted(blank.indices(words, memory)))
                pairs = [(sorted(blank.indices(a, memory)), sorted(blank.indices(b, memory))) for a, b in counterfactuals(words, i % 1009)]
                out["left"].append([a for a, _ in pairs])
                out["right"].append([b for _, b in pairs])
            kinds = {"id": pa.int64(), "toxic": pa.int64(), "own": pa.list_(pa.int32()), "left": pa.list_(pa.list_(pa.int32())), "right": pa.list_(pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))

    seen = rows.select("_id", "_text", F.col("_toxic").cast("long")).mapInArrow(
        numbered, "id long, toxic long, own array<int>, left array<array<int>>, right array<array<int>>").collect()  # at most ``sample`` rows of numbers
    if not seen or not 0 < t < n:
        return Model({}, np.zeros(0), -10.0 if t == 0 else 10.0)
    seen.sort(key=lambda r: r["id"])
    labels = np.array([float(r["toxic"]) for r in seen])
    aside = np.arange(len(seen)) % ASIDE == 0
    aside &= bool(labels[aside].any() and labels[~aside].any())  # too few rows: all of them train
    weights, bias = train([r["own"] for r, out in zip(seen, aside) if not out], labels[~aside],
                          [(a, b) for r in seen for a, b in zip(r["left"], r["right"])], len(vocabulary))
    z = np.array([weights[r["own"]].sum() + bias for r in seen])
    test = aside if aside.any() else ~aside
    return Model(vocabulary, weights, bias + float(np.log(THRESHOLD / (1 - THRESHOLD))) - calibrated(z[test], labels[test]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, from its text alone; null and empty texts get that of a text without words.
    The model is at most ``FEATURES`` and the identity terms' features; nothing is shuffled."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = Model(vocabulary, weights, bias)
        return pd.Series([own.score(words_of(t), memory) for t in texts], dtype="float64")

    memory: dict = {}
    vocabulary, weights, bias = model.vocabulary, model.weights, model.bias
    return docs.withColumn(name, scored(F.col(text)))
