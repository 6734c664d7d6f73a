"""Hashed word and character n-gram features and softmax regression over them.

A text's features are families of n-grams (words, word pairs, character triples and fours), each as relative frequencies
over hashed buckets, so a text's length doesn't scale its score. A family "p" has the words (of lower-case ASCII, punctuation
taken as space) that are in a text at all, each with one value, the larger the more it tells of a class, so that a few telling
words count in a text of any length. Scoring sums weights over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import ragged

#: Buckets of each family, what relative frequencies are multiplied by in training, and rows below which none are held out.
BUCKETS, SCALE, FEWEST = 1 << 14, 30.0, 50
#: Families by name: word or character n-grams, or words that are present, and the value of those.
ALL, FEW, PRESENT = ("w1", "w2", "c3", "c4"), ("w1", "c3", "p1"), 0.05

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_FOLD[ord("A") : ord("Z") + 1] += 32


def families(data: np.ndarray, offs: np.ndarray, kinds: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each occurrence, row offsets) of each family; of those present, each bucket of a row once."""
    starts, ends, rows = ragged.words(data, offs)
    h = ragged.span_hashes(data, starts, ends)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(ragged._LEAD[data])])[offs]
    cp += np.uint64(1)
    out = []
    for k, kind in enumerate(kinds):
        n = int(kind[1])
        if kind[0] == "p":
            folded = _FOLD[data]
            starts, ends, r = ragged.words(folded, offs)
            g = ragged.span_hashes(folded, starts, ends)
        else:
            g, r = ragged.grams(cp, at, n) if kind[0] == "c" else (h, rows) if n == 1 else ragged.grams(h, rows, n)
        bucket = (g >> np.uint64(40)).astype(np.int64) % BUCKETS
        if kind[0] == "p":
            key = np.unique(ragged.owner(r) * BUCKETS + bucket)
            bucket, r = key % BUCKETS, np.searchsorted(key, np.arange(len(r)) * BUCKETS)
        out.append((bucket + k * BUCKETS, r))
    return out


def sparse_rows(data: np.ndarray, offs: np.ndarray, kinds: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's (indices, values)."""
    found = families(data, offs, kinds)
    for i in range(len(offs) - 1):
        index, value = [], []
        for kind, (g, r) in zip(kinds, found, strict=True):
            u, c = np.unique(g[r[i] : r[i + 1]], return_counts=True)
            index.append(u)
            value.append(c * PRESENT if kind[0] == "p" else c / max(1, c.sum()))
        yield np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


@dataclass
class Model:
    """weights: (families * BUCKETS, classes); scale and shift calibrate the logits class by class."""

    weights: np.ndarray
    bias: np.ndarray
    kinds: tuple[str, ...] = ALL
    scale: float = 1.0
    shift: np.ndarray | float = 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(offs) - 1, 1))
        for kind, (g, r) in zip(self.kinds, families(data, offs, self.kinds), strict=True):
            full = np.diff(r) > 0
            if full.any():
                each = PRESENT if kind[0] == "p" else 1 / np.diff(r)[full][:, None]
                out[full] += np.add.reduceat(self.weights[g], r[:-1][full], axis=0, dtype=np.float64) * each
        return out * self.scale + self.shift

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offs))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def feature_table(df: DataFrame, text: str, label: str, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """(label, index, value) of each row of df."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ragged.chunks(batches, text, 1 << 20):
            found = list(sparse_rows(*ragged.buffer_of(b[text]), kinds))
            yield pa.RecordBatch.from_arrays([b[label], pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))], ["label", "index", "value"])

    return ragged.map_batches(df.select(text, label), work, "label int, index array<int>, value array<float>")


def fit(table: pa.Table, classes: int, kinds: tuple[str, ...] = ALL, rounds: int = 30, penalty: float = 1e-4, held: float = 0.2) -> Model:
    """Softmax regression by L-BFGS on class-weighted rows, then temperature and bias scaling on a held-out part.

    The rows have to be in a fixed order; the held-out part is every (1 / held)th row. Fewer than FEWEST rows are all
    trained on, and the probabilities then stay uncalibrated. Class 0 is the one that the logits of the others are against.
    """
    if not table.num_rows:
        return Model(np.zeros((len(kinds) * BUCKETS, classes), np.float32), np.zeros(classes), kinds)
    y = np.asarray(table["label"].combine_chunks(), dtype=np.int64)
    index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
    del table
    rows = np.asarray(index.offsets, dtype=np.int64)
    # as few bytes a feature as do, which also sorts by radix
    idx, val = np.asarray(index.flatten()).astype(np.min_scalar_type(len(kinds) * BUCKETS - 1)), np.asarray(value.flatten())
    del index, value
    full = np.flatnonzero(np.diff(rows) > 0)
    # the same values by feature: where each feature's run begins, and the row and value of each of its items
    order = np.argsort(idx, kind="stable").astype(np.int32 if len(idx) < 1 << 31 else np.int64)
    idx_sorted = idx[order]
    used_features, begins = np.unique(idx_sorted, return_index=True)
    used_features = used_features.astype(np.int64)
    of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(rows))[order]
    by_feature = val[order]
    del order
    apart = np.arange(len(y)) % max(2, round(1 / held)) == 0 if len(y) >= FEWEST else np.zeros(len(y), bool)
    share = np.bincount(y[~apart], minlength=classes)
    weight = np.where(apart, 0.0, 1.0 / np.maximum(share, 1)[y])
    weight /= weight.sum()
    width, free = len(kinds) * BUCKETS, classes - 1
    hot = np.eye(classes)[y]
    # a present word's value for a class is how much more often the class's rows have it than those of class 0, as a logarithm
    value_of = np.full((free, width), SCALE, np.float32)
    for f in (f for f, kind in enumerate(kinds) if kind[0] == "p"):
        own = slice(*np.searchsorted(idx_sorted, [f * BUCKETS, (f + 1) * BUCKETS]))
        has = np.stack([np.bincount(idx_sorted[own].astype(np.int64) - f * BUCKETS, weights=hot[of[own], k] * ~apart[of[own]], minlength=BUCKETS) for k in range(classes)])
        odds = np.log((has + 1) / (share[:, None] + 2))
        value_of[:, f * BUCKETS : (f + 1) * BUCKETS] *= odds[1:] - odds[0]
    del idx_sorted

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), classes))
        out[:, 1:] = x[-free:]
        for k in range(free):
            w = (x[k * width : (k + 1) * width] * value_of[k]).astype(np.float32)
            if len(full):
                out[full, k + 1] += np.add.reduceat(val * w[idx], rows[:-1][full])
        return out

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The penalized loss at x and its gradient."""
        z = forward(x)
        z -= z.max(1, keepdims=True)
        total = np.log(np.exp(z).sum(1))
        r = (np.exp(z - total[:, None]) - hot) * weight[:, None]
        g = penalty * x
        g[-free:] = r[:, 1:].sum(0)
        for k in range(free):
            if len(begins):
                g[k * width + used_features] += value_of[k][used_features] * np.add.reduceat(by_feature * r[:, k + 1].astype(np.float32)[of], begins)
        return float(weight @ (total - z[np.arange(len(y)), y]) + penalty / 2 * (x[:-free] @ x[:-free])), g

    x = descend(slope, np.zeros(width * free + free), rounds)
    scale, shift = calibrate(forward(x)[apart], y[apart], classes)
    weights = np.zeros((width, classes), np.float32)
    weights[:, 1:] = (x[:-free].reshape(free, width) * value_of).T
    return Model(weights, np.append(0.0, x[-free:]), kinds, scale, shift)


def descend(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """The point that L-BFGS with backtracking reaches in so many rounds, or earlier where the loss stops falling."""
    value, g = slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, rho), alpha in zip(past, reversed(alphas), strict=True):
            d += (alpha - rho * (y @ d)) * s
        along = g @ d
        if along >= -1e-14:
            break
        size = 1.0 if past else min(1.0, 1.0 / np.abs(g).sum())
        while size > 1e-10:
            new, ahead = slope(x + size * d)
            if new <= value + 1e-4 * size * along:
                break
            size /= 2
        else:
            break
        s, y = size * d, ahead - g
        if s @ y > 1e-16:
            past = [*past[-memory + 1 :], (s, y, 1.0 / (s @ y))]
        done = value - new <= 1e-7 * abs(value)
        x, value, g = x + s, new, ahead
        if done:
            break
    return x


def calibrate(z: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300) -> tuple[float, np.ndarray]:
    """The scale and class shifts that give the held-out rows their highest likelihood (Platt scaling for many classes)."""
    scale, shift = 1.0, np.zeros(classes)
    if not len(y):
        return scale, shift
    hot = np.eye(classes)[y]
    for _ in range(rounds):
        r = softmax(z * scale + shift) - hot
        scale = float(np.clip(scale - 0.05 * ((r * z).sum(1).mean() + 0.01 * (scale - 1)), 0.05, 20.0))
        shift = shift - 0.2 * (r.mean(0) + 0.01 * shift)
    return scale, shift


def labelled_sample(docs: DataFrame, labelled: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` labelled rows with their texts: those of the smallest hashes of the key.

    The ids are chosen from the label table alone; the texts then meet a broadcast of at most `most` ids. Of several texts
    under one id the smallest counts.
    """
    ids = labelled.filter(f"{key} is not null and label is not null").groupBy(key).agg(F.min("label").cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64(key), key).limit(most)
    texts = docs.select(key, "text").filter("text is not null")
    return texts.join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit_on(docs: DataFrame, labelled: DataFrame, classes: int, most: int, kinds: tuple[str, ...] = ALL) -> Model:
    """Train on a bounded sample; features are made on the executors and only they come to the driver."""
    sample = labelled_sample(docs, labelled, most).repartition(8, "doc_id").sortWithinPartitions("doc_id")
    return fit(feature_table(sample, "text", "label", kinds).toArrow(), classes, kinds)
