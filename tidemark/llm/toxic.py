"""Toxicity by a classifier chain of logistic models.

Categories are predicted one after another; each model sees the text's features and the probabilities of the categories
before it. In training these are out-of-fold predictions (folds by the hash of the features, so that copies share one), so
that a model meets what it will meet later; in use they come from the models fitted on all training rows. The last category
is the label ``toxic``. The tables label nothing else, so the earlier categories are found in the data: the toxic training
rows are clustered by the features that speak for toxicity, and each cluster is a kind, the largest first. Labels of one's
own for the kinds can be given to ``train`` instead.

Features are the presence of words and of their first four and five letters, hashed; the ``KEEP`` that say most about the
label are used, and none whose difference between the classes may be chance. Whole texts are read, and a text is scored by
its distinct words, whatever its length.

Learned from rows whose crc32 of the id, as text, is not a multiple of ``folds``: at most ``per_class`` documents of each
class and as many as ``most_bytes`` hold, which bounds the training sample; each with all its words. Out-of-fold predictions
use features chosen without their fold. At most KEEP features are used: of more that speak for the label, the strongest.

Defined cases: a null or empty text has no features and gets the models' base rates; null labels are left out, repeated
ones count once (toxic if any is), and of several texts of an id the smallest is learned from; without both classes all get
the smoothed share of toxic rows; a null id counts as not held out; repeated rows get equal scores; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import BYTES, labelled_texts
from .vectors import kmeans, nearest

PER_CLASS = 4000
SPACE = 1 << 20  # hashed features
KEEP = 1024  # features that the models use, at most
KINDS = 3  # categories before the last
LEAST = 2.0  # standard errors from no difference that a feature needs
_WORD = re.compile(r"[^\W\d_]+")


def hashed(text: str) -> np.ndarray:
    """Distinct hashed features of a text."""
    words = set(_WORD.findall(text.lower()))
    parts = words | {f"{w[:4]}*" for w in words if len(w) > 4} | {f"{w[:5]}*" for w in words if len(w) > 5}
    return np.unique(np.fromiter((crc32(p.encode()) for p in parts), np.int64, len(parts)) % SPACE)


@dataclass
class Chain:
    names: list[str]
    place: np.ndarray  # of each hashed feature among the kept ones, or -1
    weights: list[np.ndarray] = field(default_factory=list)  # kept features, earlier categories, bias
    base: float = 0.5

    def rows(self, found: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(found), int(self.place.max(initial=-1)) + 1), dtype=np.float32)
        for i, f in enumerate(found):
            at = self.place[f]
            x[i, at[at >= 0]] = 1
        return x

    def predict(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(found), len(self.names)), self.base)
        if self.weights:
            x = self.rows(found)
            for k, w in enumerate(self.weights):
                out[:, k] = _sigmoid(x @ w[: x.shape[1]] + out[:, :k] @ w[x.shape[1] : -1] + w[-1])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights and bias of a penalised logistic model, by limited-memory quasi-Newton steps with halving."""
    d = x.shape[1]

    def value(w):
        z = x @ w[:d] + w[-1]
        p = _sigmoid(z)
        loss = np.logaddexp(0, z).sum() - (y * z).sum() + penalty / 2 * (w[:d] ** 2).sum()
        return loss, np.append(x.T @ (p - y) + penalty * w[:d], (p - y).sum())

    w = np.zeros(d + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    loss, g = value(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, steps = g.copy(), []
        for s, t in reversed(pairs):
            a = (s @ q) / (s @ t)
            q -= a * t
            steps.append(a)
        if pairs:
            s, t = pairs[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(1.0, np.abs(q).max())
        for (s, t), a in zip(pairs, reversed(steps)):
            q += s * (a - (t @ q) / (s @ t))
        size = 1.0
        while size > 1e-6:
            new, grad = value(w - size * q)
            if new <= loss - 1e-4 * size * (g @ q):
                break
            size /= 2
        else:
            break
        step, change = -size * q, grad - g
        w, g, done = w + step, grad, loss - new < 1e-6 * max(1.0, loss)
        loss = new
        if step @ change > 1e-10:
            pairs = [*pairs[-9:], (step, change)]
        if done:
            break
    return w


def kinds_of(x: np.ndarray, toxic: np.ndarray, kinds: int) -> np.ndarray:
    """The cluster of each toxic row, 0 the largest; -1 for other rows."""
    own = np.flatnonzero(toxic)
    rows = x[own] / np.maximum(np.sqrt((x[own] ** 2).sum(1)), 1.0)[:, None]
    cluster = nearest(rows, kmeans(rows, kinds))
    size = np.bincount(cluster, minlength=kinds)
    rank = np.empty(len(size), dtype=np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
    out = np.full(len(toxic), -1)
    out[own] = rank[cluster]
    return out


def fold_of(found: list[np.ndarray], folds: int) -> np.ndarray:
    return np.array([crc32(f.tobytes()) % folds for f in found], dtype=np.int64)


def chosen(found: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features to use, ascending, and for each the standard errors that its log odds lie from no difference)."""
    count = lambda rows: np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=SPACE)
    on, off = count([f for f, t in zip(found, toxic) if t]), count([f for f, t in zip(found, toxic) if not t])
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((on + 0.5) / (n1 + 1)) - np.log((off + 0.5) / (n0 + 1))
    odds /= np.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))
    odds[on + off < min(4, n1)] = 0
    odds[np.abs(odds) < LEAST] = 0
    best = np.argsort(-np.abs(odds), kind="stable")[:KEEP]
    best = np.sort(best[odds[best] != 0])
    return best, odds[best]


def train(found: list[np.ndarray], toxic: np.ndarray, kinds: int | dict[str, np.ndarray] = KINDS, folds: int = 5) -> Chain:
    """``kinds``: how many categories to find before the last one, or their names with a 0/1 label for each row."""
    names = [*(kinds if isinstance(kinds, dict) else (f"kind_{k + 1}" for k in range(kinds))), "toxic"]
    base = float(toxic.sum() + 1) / (len(toxic) + 2)
    chain = Chain(names, np.full(SPACE, -1, dtype=np.int32), base=base)
    if len(set(toxic.tolist())) < 2:
        return chain

    def present(used: np.ndarray) -> np.ndarray:
        place = np.full(SPACE, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        return Chain([], place).rows(found)[:, : len(used)].astype(np.uint8)

    best, odds = chosen(found, toxic)
    chain.place[best] = np.arange(len(best))
    x, fold = present(best), fold_of(found, folds)
    parts = {k: present(chosen([f for f, o in zip(found, fold != k) if o], toxic[fold != k])[0]) for k in np.unique(fold)}
    if isinstance(kinds, dict):
        labels = [np.asarray(y, dtype=float) for y in kinds.values()]
    else:
        cluster = kinds_of(x[:, odds > 0].astype(float), toxic, kinds)
        labels = [(cluster == k).astype(float) for k in range(kinds)]
    earlier = np.zeros((len(toxic), 0))
    for y in [*labels, toxic.astype(float)]:
        out = np.empty(len(y))
        for k, part in parts.items():
            test, own = fold == k, np.column_stack([part, earlier])
            w = logistic(own[~test], y[~test])
            out[test] = _sigmoid(own[test] @ w[:-1] + w[-1])
        chain.weights.append(logistic(np.column_stack([x, earlier]), y))
        earlier = np.column_stack([earlier, out])
    return chain


def fit(docs: DataFrame, labels: DataFrame, kinds: int = KINDS, folds: int = 5, per_class: int = PER_CLASS, most_bytes: int = BYTES) -> Chain:
    named = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("__label"))
    named = named.filter(F.crc32(F.col("__id").cast("string")) % folds != 0)

    def run(batches):
        for batch in batches:
            bags = [hashed(t.as_py() or "").astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b.tobytes() for b in bags], pa.binary())], names=["label", "bag"])

    rows = labelled_texts(docs, named, per_class, most_bytes).mapInArrow(run, "label int, bag binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (crc32(r["bag"]), r["bag"], r["label"]))
    return train([np.frombuffer(r["bag"], np.int32) for r in rows], np.array([r["label"] for r in rows], dtype=np.int64), kinds)


def score(docs: DataFrame, chain: Chain, folds: int = 5, threshold: float = 0.4) -> DataFrame:
    """(doc_id, held_out, p_<category>..., predicted) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # a table of SPACE places and KEEP weights a category

    def run(batches):
        for batch in batches:
            for s in range(0, len(batch), 512):
                texts = batch.column(1)[s : s + 512]
                p = shipped.value.predict([hashed(t.as_py() or "") for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0)[s : s + 512], *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *(f"p_{n}" for n in chain.names)])

    out = ", ".join(["doc_id long", *(f"p_{n} double" for n in chain.names)])
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), *(f"p_{n}" for n in chain.names), (F.col(f"p_{chain.names[-1]}") >= threshold).cast("int").alias("predicted"))
