"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: words and word beginnings whose document counts in toxic training rows stand out (``MAX_LABELLED`` rows at
   most, about; the counts are aggregated by Spark). They are dealt to lexicon voters; pattern voters look at a text's shape,
   and two voters speak for clean texts. Every whole text is read once for its lexicon hits, shape and votes.
2. Label model: a generative model of a latent class and the votes, fitted by expectation maximisation over the vote patterns of all training documents,
   which Spark counts. Each voter has, for each class, its own accuracies, given the vote of the voter that it is most correlated with
   (a tree of the strongest correlations within a class, estimated along). Labels anchor the accuracies as added counts; they never stand in for a posterior.
3. A linear classifier on lexicon hits and shape is trained on the posteriors of at most ``MAX_LABELLED`` labelled and ``MAX_SAMPLE`` other training rows
   and scores all documents.

Defined results: null and empty texts have no hits and get the bias's score; without labels every score is 0; repeated
rows score alike; terms of equal evidence are ordered by name; very long texts are read whole; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, materialize, remainder
from .features import LETTERS, NAMES, bounded, dense, labelled, sigmoid

MOD = 3
MAX_LABELLED = 30_000
MAX_SAMPLE = 30_000
MAX_LEXICON = 3000
#: Vote patterns that are gathered, the most frequent ones: a few thousand occur.
MAX_PATTERNS = 1 << 16
LEXICON_VOTERS = 16
STRONG = 0.3
#: Information (nats) that two voters of one class give about each other before the model holds it.
LEAST_TIE = 0.02
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: Beginnings of words that count as features of their own.
STEMS = (4, 5, 6)


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased words and marked beginnings of longer ones."""
    words = set(LETTERS.findall((text or "").lower()))
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def term_counts(rows: DataFrame) -> DataFrame:
    """rows: text, y. Each term's number of documents, clean and toxic."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, y in zip(batch["text"], batch["y"]):
                found = list(terms(t))
                yield pd.DataFrame({"term": found, "y": np.full(len(found), y, np.int32)})

    return rows.mapInPandas(each, "term string, y int").groupBy("term").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))


def lexicon(rows: DataFrame, most: int = MAX_LEXICON) -> list[str]:
    """Terms likelier in toxic documents than chance allows, surest first. The likelihood ratio has to outweigh the number of terms that
    were tried, so that a large vocabulary brings no accidental ones; equal texts count once."""
    rows = rows.select("text", "y").dropDuplicates()
    n = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    tried = materialize(term_counts(rows).where("toxic >= 3"))
    base, both = max(1e-6, n[0] / max(1, n[0] + n[1])), F.col("toxic") + F.col("clean")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    sure = (part("toxic", base) + part("clean", 1 - base)) - float(np.log(3 * max(1, tried.count())))
    top = tried.where(F.col("toxic") > 2 * base * both).withColumn("sure", sure).where("sure > 0").orderBy(F.col("sure").desc(), "term").limit(most).collect()
    return _cover(rows, {r["term"]: r["sure"] for r in top}, n[1], tried.count())  # at most MAX_LEXICON


def _cover(rows: DataFrame, sures: dict[str, float], n_clean: int, tried: int) -> list[str]:
    """The strongest terms (STRONG times the best one's evidence, a beginning standing for its words), then those that explain toxic rows
    which the terms before don't: words that merely stand beside toxic ones, in copies of one text say, fall away. Gathers the hits of
    the training rows (at most MAX_LABELLED, about)."""
    if not sures:
        return []
    found = list(sures)
    words = {w: i for i, w in enumerate(found)}
    hits = bounded(_read(rows.withColumn("o", F.xxhash64("text")), words).select("y", "hits", "o"), MAX_LABELLED).toArrow().to_pandas()
    has = np.zeros((len(hits), len(found)), bool)
    for i, h in enumerate(hits["hits"]):
        has[i, list(h)] = True
    toxic, clean, out = has[hits["y"] == 1], has[hits["y"] == 0].sum(0), []
    for w in found:
        if sures[w] >= STRONG * sures[found[0]] and not any(w.startswith(o.rstrip("*")) or o.startswith(w.rstrip("*")) for o in out):
            out.append(w)
    toxic = toxic[~toxic[:, [words[w] for w in out]].any(1)]
    while len(toxic):
        k, base = toxic.sum(0), len(toxic) / (len(toxic) + n_clean)
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = np.where(k > 0, k * np.log(k / (k + clean) / base), 0) + np.where(clean > 0, clean * np.log(clean / (k + clean) / (1 - base)), 0)
        sure[k <= 2 * base * (k + clean)] = 0
        best = int(np.argmax(sure))  # the first of equals: found is in a fixed order
        if k[best] < 3 or sure[best] <= np.log(3 * max(1, tried)):
            break
        out.append(found[best])
        toxic = toxic[~toxic[:, best]]
    return out


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shape: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES) + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    std: np.ndarray = field(default_factory=lambda: np.ones(len(NAMES)))
    bias: float = -35.0

    def score(self, hits: list, shape: np.ndarray) -> np.ndarray:
        sizes = np.fromiter(map(len, hits), int, len(hits))
        rows, cols = np.repeat(np.arange(len(hits)), sizes), np.fromiter((c for h in hits for c in h), int, sizes.sum())
        x = np.clip(np.c_[(shape - self.mean) / self.std, np.log1p(sizes)], -4, 4)
        return sigmoid(self.bias + np.bincount(rows, self.weights[cols], len(hits)) + x @ self.shape)


def vote(hits: list[int], shape: list[float], n_terms: int) -> list[int]:
    """One vote of each voter."""
    out = [ABSTAIN] * LEXICON_VOTERS
    for h in hits:
        out[h % LEXICON_VOTERS] = TOXIC
    named = dict(zip(NAMES, shape))
    several, sure = len(hits) >= 2, any(h < max(1, n_terms // 4) for h in hits)
    out += [TOXIC if several else ABSTAIN, TOXIC if sure else ABSTAIN, CLEAN if not hits else ABSTAIN, CLEAN if len(hits) <= 1 and named["log_words"] > 6 else ABSTAIN]
    return out + [TOXIC if named[k] > limit else ABSTAIN for k, limit in (("upper", 0.5), ("bangs", 0.2), ("symbols", 0.3), ("runs", 0.2))]


class LabelModel:
    """P(class) and, for each class and voter, P(vote | class, vote of the voter's parent)."""

    def __init__(self, n_voters: int):
        self.parent = np.full(n_voters, -1)
        self.prior = np.array([0.9, 0.1])
        self.tables = np.full((2, n_voters, 3, 3), 1 / 3)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """votes: patterns x voters. The probability of the toxic class."""
        logs = np.repeat(np.log(self.prior)[None], len(votes), 0)
        for v, parent in enumerate(self.parent):
            given = votes[:, parent] if parent >= 0 else 0
            logs += np.log(self.tables[:, v, given, votes[:, v]]).T if parent >= 0 else np.log(self.tables[:, v, 0][:, votes[:, v]]).T
        return sigmoid(logs[:, 1] - logs[:, 0])

    def learn(self, one_hot: np.ndarray, share: np.ndarray, tied: np.ndarray | None, least: float) -> None:
        """share: class x pattern, documents. one_hot: patterns x (voters * 3). tied: find the parents anew, these pairs before others, with ``least`` information."""
        n = one_hot.shape[1] // 3
        self.prior = (share.sum(1) + 1) / (share.sum() + 2)
        joint = np.stack([(one_hot * x[:, None]).T @ one_hot for x in share]).reshape(2, n, 3, n, 3)
        if tied is not None:
            self.parent = _strongest_tree(joint, tied, least)
        for v, parent in enumerate(self.parent):
            if parent >= 0:
                t = joint[:, parent, :, v, :] + 0.3
            else:
                t = np.repeat(np.stack([np.diag(joint[c, v, :, v, :]) for c in (0, 1)])[:, None], 3, 1) + 0.3
            self.tables[:, v] = t / t.sum(2, keepdims=True)


def _same_votes(votes: np.ndarray, counts: np.ndarray, least: float = 0.8) -> np.ndarray:
    """Pairs of voters whose toxic votes are nearly the same whatever the class: else the first rounds would take their agreement for the class."""
    hit, share = (votes == TOXIC).astype(float), counts / max(counts.sum(), 1e-9)
    mean = share @ hit
    cov = (hit * share[:, None]).T @ hit - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return np.abs(cov / np.outer(sd, sd)) > least


def _strongest_tree(joint: np.ndarray, tied: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the tree of the largest information that votes of one class give about each other, tied ones first; -1 where it is below
    ``least``."""
    n, both = joint.shape[1], np.where(tied, 10.0, 0.0)
    total = max(joint[:, 0, :, 0, :].sum(), 1e-9)
    for c in (0, 1):
        j = joint[c].transpose(0, 2, 1, 3) / max(joint[c][0, :, 0, :].sum(), 1e-9)  # voter, voter, vote, vote
        apart = j.sum(3)[:, :, :, None] * j.sum(2)[:, :, None, :]
        both += np.where(j > 0, j * np.log(np.where(j > 0, j, 1) / np.maximum(apart, 1e-300)), 0).sum((2, 3)) * joint[c][0, :, 0, :].sum() / total
    parent, inside = np.full(n, -1), [0]
    while len(inside) < n:
        rest = [v for v in range(n) if v not in inside]
        gain = both[np.ix_(inside, rest)]
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] >= least:
            parent[rest[j]] = inside[i]
        inside.append(rest[j])
    return parent


def fit_label_model(votes: np.ndarray, counts: np.ndarray, anchors: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """votes: patterns x voters; counts: documents of each; anchors: labelled documents of each pattern, clean and toxic, which count beside the
    posteriors when accuracies are estimated."""
    model, anchors = LabelModel(votes.shape[1]), np.zeros((len(votes), 2)) if anchors is None else anchors
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float).reshape(len(votes), -1)
    post = (anchors[:, 1] + np.where((votes == TOXIC).any(1), 0.7, 0.05)) / (anchors.sum(1) + 1)
    tied = _same_votes(votes, counts)
    for number in range(rounds):
        share = np.stack([(1 - post) * counts, post * counts]) + anchors.T
        model.learn(one_hot, share, tied if number in (0, rounds // 2) else None, 5.0 if number == 0 else LEAST_TIE)
        post, old = model.posterior(votes), post
        if number > rounds // 2 and np.abs(post - old).max() < 1e-6:
            break
    return model


def _read(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """rows (with a column text) with hits and shape in place of the text."""

    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"hits": [sorted(words[w] for w in terms(t) & words.keys()) for t in texts], "shape": [dense(t) for t in texts]})

    return rows.withColumn("_f", F.pandas_udf(each, "hits array<int>, shape array<double>")("text")).select(*[c for c in rows.columns if c != "text"], "_f.hits", "_f.shape")


def _pattern_counts(read: DataFrame, n_terms: int) -> pd.DataFrame:
    """votes and n: the documents of each vote pattern."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(tuple(vote(list(h), s, n_terms)) for h, s in zip(batch["hits"], batch["shape"]))
            yield pd.DataFrame({"votes": [list(v) for v in seen], "n": np.array(list(seen.values()), np.int64)})

    got = read.select("hits", "shape").mapInPandas(each, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return got.orderBy(F.col("n").desc(), "votes").limit(MAX_PATTERNS).toArrow().to_pandas()


def train(rows: DataFrame, read: DataFrame, words: dict[str, int], max_labelled: int, max_sample: int) -> Model:
    """rows: text, y and o of labelled training rows. read: hits, shape and o of all training rows."""
    counted = _pattern_counts(read, len(words))
    own = bounded(_read(rows, words), max_labelled).toArrow().to_pandas()
    share = max_sample / max(1, int(counted["n"].sum()))
    other = bounded(read.where(F.col("o") < int(min(1.0, share) * (1 << 30))).select("hits", "shape", "o"), max_sample).toArrow().to_pandas()
    got = pd.concat([own, other.assign(y=-1)], ignore_index=True)
    hits, shape, y = [list(h) for h in got["hits"]], np.array(got["shape"].tolist(), float), got["y"].to_numpy()
    order = np.lexsort((*shape.T, [sum(h) for h in hits], y))  # collected rows come in any order; sums must not
    hits, shape, y = [hits[i] for i in order], shape[order], y[order]
    votes = np.array([vote(h, s, len(words)) for h, s in zip(hits, shape)], int)
    patterns = np.array(counted["votes"].tolist(), int).reshape(len(counted), -1)
    place = {p.tobytes(): i for i, p in enumerate(patterns)}
    anchors = np.zeros((len(patterns), 2))
    for v, label in zip(votes[y >= 0], y[y >= 0]):
        if (at := place.get(v.tobytes())) is not None:
            anchors[at, label] += 1
    model = fit_label_model(patterns, counted["n"].to_numpy(float), anchors)
    return _classifier(words, hits, shape, model.posterior(votes))


def _classifier(words, hits, shape, target, steps: int = 1500) -> Model:
    model = Model(words, np.zeros(len(words)), mean=shape.mean(0), std=shape.std(0) + 1e-6)
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.array([c for h in hits for c in h], int)
    x = np.clip(np.c_[(shape - model.mean) / model.std, np.log1p([len(h) for h in hits])], -4, 4)
    w = np.r_[np.full(len(words), 0.5), np.zeros(x.shape[1]), -2.0]
    balance = np.where(target > 0.5, 0.5 / max(1e-3, target.mean()), 0.5 / max(1e-3, 1 - target.mean())) ** 0.5
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = len(words)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(hits)) + x @ w[n:-1] + w[-1]
        d = (sigmoid(z) - target) * balance / len(hits)
        g = np.r_[np.bincount(cols, d[rows], n), d @ x, d.sum()] + np.r_[np.full(n, 1e-5), np.full(x.shape[1], 1e-3), 0] * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model.weights, model.shape, model.bias = w[:n], w[n:-1], float(w[-1])
    return model


def _features(docs: DataFrame, words: dict[str, int], mod: int) -> DataFrame:
    """doc_id, trains, o (a hash), hits and shape of every row of docs, written."""
    trains, o = remainder(F.col("doc_id"), mod) != 1, F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 30))
    return materialize(_read(docs.select("doc_id", "text", trains.alias("trains"), o.alias("o")), words))


def fitted(docs: DataFrame, labels: DataFrame, mod: int = MOD, max_labelled: int = MAX_LABELLED, max_sample: int = MAX_SAMPLE) -> tuple[Model | None, DataFrame | None]:
    """The model, None if labels give no lexicon, and the features of all docs."""
    rows = materialize(labelled(docs, labels, "toxic", mod, max_labelled))
    model = read = None
    if found := lexicon(rows):
        words = {w: i for i, w in enumerate(found)}
        read = _features(docs, words, mod)
        model = train(rows, read.where("trains"), words, max_labelled, max_sample)
    discard(rows)
    return model, read


def _shapes(shape: pd.Series) -> np.ndarray:
    return np.array(shape.tolist(), float).reshape(len(shape), len(NAMES))


def op8(df: DataFrame, labels: DataFrame) -> DataFrame:
    docs = columns_of(df, doc_id="long", text="string")
    model, read = fitted(docs, labels)
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        judge = F.pandas_udf(lambda hits, shape: pd.Series(model.score(hits.tolist(), _shapes(shape))), "double")
        out = read.select("doc_id", judge("hits", "shape").alias("score"))
    return out.select("doc_id", (remainder(F.col("doc_id"), MOD) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, columns: list[str], limit: float = 0.7) -> DataFrame:
    """The rows of df that score below ``limit``, with the named columns. Texts are read once more rather than written beside their features."""
    model, read = fitted(columns_of(df, doc_id="long", text="string"), labels)
    discard(read)
    if model is None:
        return df.select(*columns)
    judge = F.pandas_udf(lambda t: pd.Series(model.score([sorted(model.terms[w] for w in terms(x) & model.terms.keys()) for x in t], np.array([dense(x) for x in t], float).reshape(len(t), len(NAMES)))), "double")
    return df.where(judge(F.col("text")) < limit).select(*columns)
