"""Quality classifier by positive-unlabelled learning: a linear model on binned text measures minimises the
non-negative unbiased risk

    prior * R+(trusted) + max(0, R-(unlabelled) - prior * R-(trusted))

with the prior estimated from the data: the ratio of the unlabelled mass to the trusted mass above cuts of a first
score, where that ratio is flat. The unlabelled mass is counted over all training documents.

Trusted positives are training rows labelled 1, the unlabelled part is training documents whatever their label; each
is a hash-chosen sample of at most ``MAX_TRUSTED`` and ``MAX_UNLABELLED`` rows, the documented bound of the gradient fit. What is
gathered is 14 measures a row. Scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts have measures of zero and a score like any other; without trusted rows every
score is 0.5; repeated rows score alike; equal measures tie and score alike; very long texts are measured whole; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, materialize, remainder
from .features import NAMES, bounded, dense, labelled, sample, sigmoid

MOD = 3
MAX_TRUSTED = 12_000
MAX_UNLABELLED = 24_000
BINS = 12
STEPS = 400


@dataclass
class Model:
    edges: np.ndarray  # measures x (BINS - 1)
    weights: np.ndarray
    bias: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges) @ self.weights + self.bias


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of each measure, side by side."""
    out = np.zeros((len(x), edges.shape[0] * (edges.shape[1] + 1)), np.float64)
    rows = np.arange(len(x))
    for j, e in enumerate(edges):
        out[rows, j * (len(e) + 1) + np.searchsorted(e, x[:, j], side="right")] = 1
    return out


def _fit(trusted: np.ndarray, unlabelled: np.ndarray, prior: float, non_negative: bool) -> tuple[np.ndarray, float]:
    """Adam on the logistic PU risk. Where the negative part falls below zero, its gradient is turned, so the model can't fit noise there."""
    w, decay = np.zeros(trusted.shape[1] + 1), 1e-4 + 4 / len(trusted)
    tp, tu = np.c_[trusted, np.ones(len(trusted))], np.c_[unlabelled, np.ones(len(unlabelled))]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        sp, su = sigmoid(tp @ w), sigmoid(tu @ w)
        up, down, rest = tp.T @ (sp - 1) / len(tp), tp.T @ sp / len(tp), tu.T @ su / len(tu)
        negative = np.logaddexp(0, tu @ w).mean() - prior * np.logaddexp(0, tp @ w).mean()
        g = prior * up + rest - prior * down if negative >= 0 or not non_negative else prior * down - rest
        g = g + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def cuts_of(trusted: np.ndarray) -> np.ndarray:
    """Scores that hold back a tenth to half of the trusted."""
    return np.quantile(trusted, np.linspace(0.1, 0.5, 30))


def estimate_prior(trusted: np.ndarray, above: np.ndarray, cuts: np.ndarray) -> float:
    """Share of positives among the unlabelled: the typical ratio of masses above the cuts. above: the unlabelled share at or above each cut."""
    return float(np.clip(np.median(above / [max(1e-9, (trusted >= c).mean()) for c in cuts]), 0.02, 0.98))


def edges_of(trusted: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    both = np.r_[trusted, unlabelled]
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # the tails matter more than the middle: half the edges go to the outer tenths
    tails = np.quantile(both, [0.01, 0.03, 0.06, 0.94, 0.97, 0.99], axis=0).T
    return np.sort(np.c_[edges, tails], axis=1)


def fit(trusted: np.ndarray, unlabelled: np.ndarray, masses) -> Model:
    """masses(model, cuts): the share of all unlabelled rows whose first score is at or above each cut."""
    edges = edges_of(trusted, unlabelled)
    tp, tu = binned(trusted, edges), binned(unlabelled, edges)
    w, b = _fit(tp, tu, 0.5, False)
    cuts = cuts_of(tp @ w + b)
    prior = estimate_prior(tp @ w + b, masses(Model(edges, w, b, 0.5), cuts), cuts)
    w, b = _fit(tp, tu, prior, True)
    return Model(edges, w, b, prior)


def _measured(texts: DataFrame, keep: list[str]) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([dense(t) for t in batch["text"]], columns=list(NAMES), dtype="float64")
            for c in keep:
                out[c] = batch[c].to_numpy()
            yield out

    return texts.select("text", *keep).mapInPandas(each, ", ".join(f"{c} double" for c in NAMES) + "".join(f", {c} long" for c in keep))


def _masses(measured: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """The share of measured rows that score each cut or more: counted per batch and added up by Spark."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = np.sort(model.logit(batch[list(NAMES)].to_numpy(float)))
                yield pd.DataFrame({"cut": np.arange(len(cuts) + 1, dtype=np.int32), "n": np.r_[len(z) - np.searchsorted(z, cuts), len(z)].astype(np.int64)})

    got = measured.mapInPandas(each, "cut int, n long").groupBy("cut").agg(F.sum("n").alias("n")).orderBy("cut").toPandas()  # a row for each cut
    return got["n"].to_numpy(float)[:-1] / got["n"].iloc[-1]


def train(docs: DataFrame, labels: DataFrame, mod: int = MOD, max_trusted: int = MAX_TRUSTED, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    rows = labelled(docs, labels.where("quality = 1"), "quality", mod, max_trusted)
    trusted = bounded(_measured(rows.select("text", "o"), ["o"]), max_trusted).toPandas()
    if not len(trusted):
        return None
    every = materialize(_measured(sample(docs, mod, 1, 1), ["o"]))  # all training rows' measures
    share = max_unlabelled / max(1, every.count())
    unlabelled = bounded(every.where(F.col("o") < int(min(1.0, share) * (1 << 30))), max_unlabelled).toPandas()
    names = list(NAMES)
    # collected rows come in any order; sums must not
    order = lambda x: x[np.lexsort(x.T)]
    model = fit(order(trusted[names].to_numpy(float)), order(unlabelled[names].to_numpy(float)), lambda m, cuts: _masses(every, m, cuts)) if len(unlabelled) else None
    discard(every)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) with score."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([dense(t) for t in batch["text"]], float).reshape(len(batch), len(NAMES))
            s = sigmoid(model.logit(x)) if model else np.full(len(batch), 0.5)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s})

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, score double")


def op2(df: DataFrame, labels: DataFrame) -> DataFrame:
    docs = columns_of(df, doc_id="long", text="string")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), MOD) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """The rows of df that score ``least`` or more, with the named columns, in one pass."""
    docs = columns_of(df, doc_id="long", text="string")
    model = train(docs, labels)
    judge = F.pandas_udf(lambda t: pd.Series(sigmoid(model.logit(np.array([dense(x) for x in t], float).reshape(len(t), len(NAMES)))) if model else np.full(len(t), 0.5)), "double")
    return df.where(judge(F.col("text")) >= least).select(*columns)
