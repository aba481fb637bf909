"""Counterfactual-regularised toxicity classifier.

Features are presences of words and of their first 4, 5 and 6 letters, hashed to ``BUCKETS``. The model is a logistic
regression over the ``N_FEATURES`` features whose log odds between the classes are the surest. It is fitted by Newton
steps to at most ``PER_CLASS`` labelled rows of each class, taken in the order of a hash of the id (the documented bound
of the sample). Every labelled text that names a group gets a counterfactual, the same text with its identity terms
swapped for others; the squared change of the linear score between the two is part of the loss.

Results: a null text is an empty one; a text without a word gets the score of the base rate. Rows are scored one by one,
so repeated rows give repeated rows. Labels that are null, or without a document, are not learned from; a document with
several labels counts as toxic if one of them says so. Without labels of both classes every score is the base rate (0.5
without any). An empty table gives an empty one. Input columns called like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_of

BUCKETS = 1 << 20
PER_CLASS = 3000
N_FEATURES = 600
LEAST_DOCS = 4
# Terms within a row stand for one another.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["muslims", "christians", "jews", "hindus", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "atheist"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino"], ["immigrants", "natives", "refugees"], ["old", "young"], ["deaf", "blind", "disabled"],
    ["frauen", "männer"], ["mujeres", "hombres"], ["femmes", "hommes"],
]
_OTHER = {w: [v for v in row if v != w] for row in IDENTITY for w in row}
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 200_000


@dataclass(frozen=True)
class Model:
    """Weights by feature and the intercept."""

    weights: dict[int, float]
    bias: float


def _keys(word: str) -> tuple[int, ...]:
    parts = {word} | {word[:k] + "*" for k in (4, 5, 6) if len(word) >= k}
    return tuple(zlib.crc32(p.encode()) & (BUCKETS - 1) for p in parts)


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str]) -> set[str]:
    """The words with every identity term replaced by another of its row."""
    return {_OTHER[w][zlib.crc32(w.encode()) % len(_OTHER[w])] if w in _OTHER else w for w in words}


def _featurise(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            part, cols, other = pdf.iloc[lo : lo + 200], [], []
            for t in part["text"]:
                words = word_set(t)
                cols.append(sorted({k for w in words for k in _keys(w)}))
                other.append(sorted({k for w in swapped(words) for k in _keys(w)}) if words & _OTHER.keys() else None)
            yield pd.DataFrame({"toxic": part["toxic"].to_numpy(np.int32), "own": cols, "other": other})


def sample(labelled: DataFrame, docs: DataFrame, key: str, per_class: int) -> DataFrame:
    """Features of at most ``per_class`` labelled texts of each class."""
    order = F.xxhash64(key, F.lit(5))
    picked = None
    for y in (0, 1):
        part = labelled.where(F.col("toxic") == y).orderBy(order, key).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class narrow rows are broadcast.
    rows = docs.select(F.col(key), text_of().alias("text")).join(F.broadcast(picked), key).select("toxic", "text")
    return rows.mapInPandas(_featurise, "toxic int, own array<int>, other array<int>")


def fit_rows(y: np.ndarray, own: list, other: list, rate: float, ridge: float = 1.0, fairness: float = 10.0, n_features: int = N_FEATURES) -> Model:
    """Newton steps on the chosen features; ``rate`` is the share of toxic rows among all labelled ones."""
    flat = np.concatenate(own) if len(own) else np.array([], dtype=np.int64)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    prior = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    if not n1 or not n0:
        return Model({}, prior if len(y) else 0.0)
    with_1 = np.bincount(flat[y[row] == 1], minlength=BUCKETS)
    with_0 = np.bincount(flat[y[row] == 0], minlength=BUCKETS)
    odds = np.log((with_1 + 0.5) / (n1 - with_1 + 0.5)) - np.log((with_0 + 0.5) / (n0 - with_0 + 0.5))
    sure = odds / np.sqrt(1 / (with_1 + 0.5) + 1 / (with_0 + 0.5))
    sure[with_1 + with_0 < LEAST_DOCS] = 0
    chosen = np.sort(np.argsort(-np.abs(sure), kind="stable")[:n_features])
    chosen = chosen[sure[chosen] != 0]
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows):
        x = np.zeros((len(rows), len(chosen) + 1))
        for i, r in enumerate(rows):
            at = place[np.asarray(r, dtype=np.int64)]
            x[i, at[at >= 0]] = 1
        x[:, -1] = 1
        return x

    x = matrix(own)
    pairs = [i for i, o in enumerate(other) if o is not None]
    change = x[pairs] - matrix([other[i] for i in pairs]) if pairs else np.zeros((0, x.shape[1]))
    fixed = fairness * change.T @ change + ridge * np.eye(x.shape[1])
    fixed[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + fixed @ w
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-4)[:, None]) + fixed, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    # The sample holds the classes in other shares than the labels do.
    bias = w[-1] + prior - np.log(n1 / n0)
    return Model({int(k): float(v) for k, v in zip(chosen, w[:-1]) if abs(v) > 1e-9}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fit to ``labels (key, toxic)``."""
    labelled = labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    rate = labelled.agg(F.avg("toxic")).first()[0]
    got = sample(labelled, docs, key, per_class).toArrow()
    y = got["toxic"].to_numpy().astype(np.int64)
    own = [np.asarray(v.as_py(), dtype=np.int64) for v in got["own"]]
    other = [None if v.as_py() is None else np.asarray(v.as_py(), dtype=np.int64) for v in got["other"]]
    # A fixed order, whatever the order in which tasks end.
    rank = sorted(range(len(y)), key=lambda i: (y[i], own[i].tobytes()))
    return fit_rows(y[rank], [own[i] for i in rank], [other[i] for i in rank], 0.5 if rate is None else float(rate))


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, ...]] = {}
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            found: set[int] = set()
            for w in word_set(t):
                k = known.get(w)
                if k is None:
                    k = tuple(x for x in _keys(w) if x in weights)
                    if len(known) >= _CACHED:
                        known.clear()
                    known[w] = k
                if k:
                    found.update(k)
            out[i] = bias + sum(weights[k] for k in sorted(found))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return run(text_of(text))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All input columns, ``score`` and ``predicted``."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    d = docs.select(*own, score(F.col(text), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
