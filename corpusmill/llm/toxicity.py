"""Toxicity by a classifier chain.

Categories are predicted one after the other; each later linear model sees the probabilities of the earlier ones.  While
training, those are *out-of-fold* predictions (folds by a hash of doc_id): a fold's features are chosen, and its model is
fitted, without the labels of that fold, so a later model learns how far it may trust the earlier ones.  All are then
refitted on the whole sample.  Features are the presence of words and of word beginnings of 4 and 5 letters, those whose
share differs most between the classes; presence makes one word in a long text count as much as in a short one.

A category's threshold comes from the out-of-fold predictions too: the middle of the range of thresholds that tell most
labels right (a missed document weighs ``MISSED``).

The sample is bounded: about ``SAMPLE_DOCS`` labelled documents by a hash of doc_id, and fewer if their texts have over
``SAMPLE_CHARS`` characters; ``FEATURES`` features for each category.  Everything else reads all rows and whole texts.

Defined results: null texts have no feature, so they get the models' base rate; without labels of both classes a category
is its base rate (0 without any); null labels and labels of unknown documents are not used; of several labels of a
document the largest counts; each row of the table is predicted, by its own text; a carried column that has the name of a
prediction is left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_CHARS, FEATURES, FOLDS = 6000, 200_000_000, 400, 5
#: Least z-score of a feature's difference in share between a category's classes.
LEAST_Z = 4.5
#: The chain: (category, column of labels, the value that means yes).
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: What a missed document weighs against a clean one taken, in choosing a threshold.
MISSED = 1.0
_WORD = re.compile(r"[^\W\d_]+")
_DOCS_AT_ONCE = 512


def features_of(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) > n}


class Chain:
    def __init__(self, categories: list[str], features: dict[str, int], weights: list[np.ndarray], thresholds: list[float]):
        self.categories, self.features, self.weights, self.thresholds = categories, features, weights, thresholds

    def matrix(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), len(self.features)), dtype=np.float32)
        words, whole = self.features, {}
        for row, text in zip(out, texts):
            for w in set(_WORD.findall((text or "").lower())):
                hit = whole.get(w)
                if hit is None:
                    keys = (w, *(w[:n] + "*" for n in (4, 5) if len(w) > n))
                    hit = whole[w] = [words[k] for k in keys if k in words]
                if hit:
                    row[hit] = 1.0
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category, each fed to the next models."""
        out = np.empty((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, probability(np.hstack([x, out]), w)[:, None]])
        return out


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept.  One class only: its base rate."""
    w = np.zeros(x.shape[1] + 1)
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        w[-1] = 30.0 if share else -30.0
        return w
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    w[-1] = np.log(share / (1 - share))

    def loss(v: np.ndarray) -> float:
        z = x1 @ v
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * (penalty * v * v).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, x1.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(step).max() < 1e-5:
            break
    return w


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """All features of the texts, and the numbers of each text's own."""
    place: dict[str, int] = {}
    found = [np.fromiter((place.setdefault(f, len(place)) for f in features_of(t)), dtype=np.int32) for t in texts]
    return list(place), found


def choose_features(names: list[str], found: list[np.ndarray], y: np.ndarray, most: int = FEATURES) -> list[int]:
    """The features of at least 5 documents with the largest z-score of the difference in share."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return []
    of = lambda some: np.bincount(np.concatenate([np.empty(0, np.int32), *some]).astype(np.int64), minlength=len(names))
    counts, ones = of(found), of([f for f, label in zip(found, y) if label])
    share = (counts + 1) / (n0 + n1 + 2)
    z = np.abs(ones / n1 - (counts - ones) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    usable = np.flatnonzero((counts >= 5) & (z >= LEAST_Z)).tolist()
    return sorted(usable, key=lambda f: (-z[f], names[f]))[:most]


def presence(found: list[np.ndarray], chosen: list[int], total: int) -> np.ndarray:
    place = np.full(total, -1)
    place[chosen] = np.arange(len(chosen))
    out = np.zeros((len(found), len(chosen)))
    for row, own in zip(out, found):
        at = place[own]
        row[at[at >= 0]] = 1.0
    return out


def choose_threshold(p: np.ndarray, y: np.ndarray, missed: float = MISSED) -> float:
    """The middle of the widest range of thresholds with the least cost on these predictions."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order] == 1
    # cost of a threshold just above each of the predictions, and below all of them
    cost = np.concatenate([[0.0], np.cumsum(np.where(y, missed, -1.0))])
    edges = np.concatenate([[0.0], p, [1.0]])
    usable = edges[1:] > edges[:-1]
    if not usable.any():
        return 0.5
    best = usable & (cost <= cost[usable].min() + 1e-9)
    wide = np.where(best, edges[1:] - edges[:-1], -1.0)
    at = int(wide.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


def fit(texts: list[str], ys: np.ndarray, folds: np.ndarray, categories: list[str]) -> Chain:
    names, found = numbered(texts)
    shown = lambda some, chosen: presence(some, chosen, len(names))
    earlier = np.empty((len(texts), 0))
    models, thresholds = [], []
    for y in ys.T:
        unseen = np.empty(len(y))
        for fold in np.unique(folds):
            out = folds == fold
            seen, held = ([f for f, o in zip(found, out) if o == side] for side in (False, True))
            chosen = choose_features(names, seen, y[~out])
            w = logistic(np.hstack([shown(seen, chosen), earlier[~out]]), y[~out])
            unseen[out] = probability(np.hstack([shown(held, chosen), earlier[out]]), w)
        thresholds.append(choose_threshold(unseen, y))
        chosen = choose_features(names, found, y)
        models.append(([names[f] for f in chosen], logistic(np.hstack([shown(found, chosen), earlier]), y)))
        earlier = np.hstack([earlier, unseen[:, None]])
    # one table of features for all models
    place = {f: i for i, f in enumerate(dict.fromkeys(f for own, _ in models for f in own))}
    weights = []
    for k, (own, w) in enumerate(models):
        full = np.zeros(len(place) + k + 1)
        full[[place[f] for f in own]] = w[: len(own)]
        full[len(place) :] = w[len(own) :]
        weights.append(full)
    return Chain(categories, place, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Chain:
    columns = [F.max((F.col(c) == v).cast("int")).alias(name) for name, c, v in categories]
    usable = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*columns).dropna()
    n = usable.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(u < min(1.0, sample_docs / max(n, 1)))
    names = [name for name, _, _ in categories]
    # bounded by sample_docs rows, so the labels are the side to ship and the texts are not shuffled
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))
    chars = joined.agg(F.sum(F.char_length("text"))).first()[0] or 0
    keep = F.pmod(F.xxhash64("doc_id", F.lit("chars")), F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample_chars / max(chars, 1))
    rows = joined.where(keep).select("text", "fold", *names).collect()
    ys = np.array([[r[c] for c in names] for r in rows], dtype=np.float64).reshape(-1, len(names))
    return fit([r["text"] for r in rows], ys, np.array([r["fold"] for r in rows]), names)


def _predict(shared, carry: list[str]):
    def run(batches):
        chain = shared.value
        names = [*carry, *(f"p_{c}" for c in chain.categories)]
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(at, _DOCS_AT_ONCE)
                p = chain.predict(chain.matrix(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(v) for v in p.T)], names)

    return run


def classify(docs: DataFrame, chain: Chain, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, p_<category> for each category of the chain, and <category> where it reaches its threshold."""
    own = {x.lower() for c in chain.categories for x in (c, f"p_{c}")}
    carry = [c for c in carry if c.lower() not in own]
    need = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in need.select(*carry).schema)
    schema += "".join(f", p_{c} double" for c in chain.categories)
    run = _predict(docs.sparkSession.sparkContext.broadcast(chain), carry)
    scored = need.mapInArrow(run, schema)
    flags: list[Column] = [(F.col(f"p_{c}") >= t).alias(c) for c, t in zip(chain.categories, chain.thresholds)]
    return scored.select("*", *flags)
