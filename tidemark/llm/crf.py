"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad; features of the line and of its two neighbours score it, transitions tie
neighbours together, and a document's quality is the mean of its lines' forward-backward marginals, weighted by their
length and calibrated on the training documents. Lines have no labels of their own: training starts from the document's
label on each line and then once lets clearly good lines of bad documents be good.

Only text is read to score; labels, lang, source and doc_id are not. Labels are learned from rows whose crc32 of the id,
as text, is not a multiple of ``folds``: at most ``per_class`` documents of each class and as many as ``most_bytes`` hold
(the bounds of the training sample), each with all its lines. Scores read every line.

Defined cases: a null text is one empty line, and so is an empty one; null or repeated labels are left out or taken once
(the smaller), and of several texts of an id the smallest is learned from; with no label, or labels of one class, the score is the smoothed share of good ones; a null id counts as
not held out; repeated rows get equal scores; an empty table gives no rows; other columns stay as they are in
``good_documents`` and are ignored by ``quality``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import BYTES, labelled_texts
from .store import tidy

PER_CLASS = 3000
SLICE = 2 << 20

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in "*&%$#@^~<>{}[]\\_=+/"]] = 3
_KIND[ord("|")] = 4
_KIND[ord("!")] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
_KIND[128:] = 7
_KIND[[9, 10, 11, 12, 13, 32]] = 8
_OWN = 19
_NEAR = [0, 1, 3, 4, 5, 10, 11, 12]
WIDTH = _OWN + 2 * len(_NEAR) + 2


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of features a line, lines of each text, bytes of each line)."""
    lines, counts, words = [], np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        own = text.encode().split(b"\n")
        counts[i] = len(own)
        times: dict[bytes, int] = {}
        for line in own:
            times[line] = times.get(line, 0) + 1
        for line in own:
            w = line.split()
            n = len(w)
            if n:
                kinds = set(w)
                most = 0 if len(kinds) == n else max(Counter(w).values())
                twice = sum(map(bytes.__eq__, w, w[1:])) if len(kinds) < n else 0
                words.append((n, len(kinds) / n, twice / n, most / n, times[line] > 1 and len(line) > 0, line[-1:] in (b".", b"!", b"?"), line[:1].isupper()))
            else:
                words.append((0, 1.0, 0.0, 0.0, False, False, False))
        lines += own
    size = np.array([len(x) for x in lines])
    begin = np.cumsum(size + 1) - size - 1
    kind = _KIND[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    full = np.maximum(size, 1)
    share = [np.add.reduceat(kind == k, begin, dtype=np.int64) / full for k in range(1, 8)]
    blank = np.add.reduceat(kind == 8, begin, dtype=np.int64) - 1
    word = np.array(words, dtype=float)
    n = np.maximum(word[:, 0], 1)
    own = np.column_stack([
        np.log1p(size), *share, word[:, 6], np.log1p(word[:, 0]), word[:, 1], word[:, 2], word[:, 4], word[:, 3], word[:, 5],
        (size - blank) / n / 10, share[4] * full / n, share[2] * full / n, (size == 0).astype(float),
    ])
    first = np.zeros(len(lines), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before = np.where(first[:, None], 0, np.roll(own[:, _NEAR], 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own[:, _NEAR], -1, axis=0))
    return np.column_stack([own, before, after, first, last]).astype(np.float32), counts, size


class Chains:
    """Forward-backward of many chains at once; chains sorted by length, so that step t works on those still going."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        start = np.cumsum(counts) - counts
        by = np.argsort(-counts, kind="stable")
        sizes, start = counts[by], start[by]
        going = np.searchsorted(-sizes, -np.arange(int(counts.max(initial=0))), "left")
        self.steps = [start[:k] + t for t, k in enumerate(going)]
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.inner = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.ends = np.cumsum(counts) - 1

    def marginals(self, score: np.ndarray, trans: np.ndarray):
        """(chance that each line is good, expected transitions of each inner line as four columns)."""
        alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        emit = np.column_stack([np.zeros(len(score)), score])
        for t, at in enumerate(self.steps):
            if t:
                past = alpha[at - 1]
                emit_in = np.logaddexp(past[:, :1] + trans[0], past[:, 1:] + trans[1])
                alpha[at] = emit_in + emit[at]
            else:
                alpha[at] = emit[at]
        for at in self.steps[:0:-1]:
            ahead = beta[at] + emit[at]
            beta[at - 1] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
        log_z = np.logaddexp(alpha[self.ends, 0], alpha[self.ends, 1])
        good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - log_z[self.doc], -60, 0))
        i = self.inner
        pairs = np.exp(np.clip(alpha[i - 1][:, :, None] + trans[None] + (emit[i] + beta[i])[:, None, :] - log_z[self.doc[i]][:, None, None], -60, 0))
        return good, pairs.reshape(-1, 4)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def raw(self, texts: list[str]) -> np.ndarray:
        x, counts, size = features(texts)
        good, _ = Chains(counts).marginals(inputs(x, self.mean, self.spread) @ self.weights, self.trans)
        return aggregate(good, counts, size)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.offset)
        return 1 / (1 + np.exp(-(self.slope * self.raw(texts) + self.offset)))


def inputs(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features on one scale and a last column of ones; training and scoring both go through here."""
    return np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(x))])


def aggregate(good: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds of the mean marginal, a line weighing its bytes and one more."""
    begin = np.cumsum(counts) - counts
    mean = np.add.reduceat(good * (size + 1), begin) / np.add.reduceat((size + 1).astype(float), begin)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _ascend(x, target, chains, weight, w, trans, rounds, decay=2.0, rate=0.15):
    """Adam on the penalised log-likelihood of soft line labels."""
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    per_line = weight[chains.doc]
    total = per_line.sum()
    i = chains.inner
    observed = np.column_stack([(1 - target[i - 1]) * (1 - target[i]), (1 - target[i - 1]) * target[i], target[i - 1] * (1 - target[i]), target[i - 1] * target[i]])
    observed = (observed * per_line[i][:, None]).sum(0)
    for step in range(1, rounds + 1):
        good, pairs = chains.marginals(x @ w, trans)
        up = np.concatenate([x.T @ (per_line * (target - good)) - decay * w, observed - (pairs * per_line[i][:, None]).sum(0) - 40 * trans.ravel()]) / total
        state[0] = 0.9 * state[0] + 0.1 * up
        state[1] = 0.99 * state[1] + 0.01 * up * up
        move = rate * (1 - step / (rounds + 1)) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return w, trans


def train(x: np.ndarray, counts: np.ndarray, size: np.ndarray, label: np.ndarray, share: np.ndarray, rounds: int = 80) -> Model:
    """Fits the chain, then the calibration; share: how many documents of the corpus each one stands for."""
    good_share = float((share * label).sum() + 1) / float(share.sum() + 2)
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((2, 2)), 0.0, good_share)
    mean, spread = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
    x = inputs(x, mean, spread)
    chains = Chains(counts)
    weight = 1 / np.sqrt(counts)
    target = label[chains.doc].astype(float)
    w, trans = _ascend(x, target, chains, weight, np.zeros(x.shape[1]), np.zeros((2, 2)), rounds)
    alone = 1 / (1 + np.exp(-(x @ w)))
    worst = np.minimum.reduceat(alone, np.cumsum(counts) - counts)[chains.doc]
    target = np.where((target == 0) & (alone > 0.9) & (alone > worst), 1.0, target)
    w, trans = _ascend(x, target, chains, weight, w, trans, rounds)
    good, _ = chains.marginals(x @ w, trans)
    raw = aggregate(good, counts, size)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a small penalty
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([(share * (label - p) * raw).sum() - 1e-2 * a, (share * (label - p)).sum()])
        v = share * p * (1 - p)
        hess = np.array([[(v * raw * raw).sum() + 1e-2, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + da, b + db
    return Model(mean, spread, w, trans, max(a, 1e-3), b)


def _slices(texts):
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t.as_buffer()) if t.is_valid else 0
        if i > begin and total + n > SLICE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = PER_CLASS, most_bytes: int = BYTES) -> Model:
    """Learns from at most ``per_class`` labelled documents of each class, and ``most_bytes`` of their texts, outside the held-out fold."""
    named = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__label"))
    named = named.filter(F.crc32(F.col("__id").cast("string")) % folds != 0)
    sizes = {r["__label"]: r["n"] for r in named.groupBy("__label").agg(F.count("*").alias("n")).collect()}

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                x, counts, size = features(batch.column(0)[a:b].to_pylist())
                ends = np.cumsum(counts)
                parts = [(x[e - c : e].tobytes(), size[e - c : e].astype(np.int32).tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], *(pa.array(list(p), pa.binary()) for p in zip(*parts))], names=["label", "x", "size"])

    found = labelled_texts(docs, named, per_class, most_bytes)
    rows = found.mapInArrow(tidy(run), "label int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.x)))
    if not rows:
        return train(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))
    size = [np.frombuffer(r["size"], np.int32) for r in rows]
    label = np.array([r.label for r in rows])
    share = np.array([sizes[k] / max(1, (label == k).sum()) for k in label])
    x = np.concatenate([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, WIDTH)
    return train(x, np.array([len(s) for s in size]), np.concatenate(size), label, share)


def quality(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some dozen numbers

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                score = shipped.value.score([t or "" for t in batch.column(1)[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``threshold``; all columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some dozen numbers
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(text)
            for a, b in _slices(texts):
                score = shipped.value.score([t or "" for t in texts[a:b].to_pylist()])
                yield batch.slice(a, b - a).filter(pa.array(score >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
