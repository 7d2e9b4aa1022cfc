"""Document quality: random-indexing word vectors, pooled, through a two-layer network with calibrated probabilities.

Every word bucket has a sparse random index vector; a word's vector is the sum of its neighbours'
over the training sample, at unit length. The same is done for word shapes (runs of letter cases,
digits and signs). A document is the mean of its word vectors and of its shape vectors with their
spread, the share of distinct words, the share of words that repeat the one before, and its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, saved, slice_hashes, text_slices

DIMS, NONZERO, WINDOW = 48, 4, 2
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
#: Bound on the labelled rows that are fitted on, those of smallest hash of their id.
MAX_LABELLED = 8000
HIDDEN, EPOCHS, SEED = 32, 60, 7
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def index_vectors(buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every bucket's random index vector."""
    h = mix(np.arange(buckets * NONZERO, dtype=np.uint64) + np.uint64(seed << 32)).reshape(buckets, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def streams(texts: list[bytes]):
    """(text of every word, its word bucket, its shape bucket)."""
    w = Words(texts)
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _SHAPE[joined]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    place = np.cumsum(keep) - 1
    short = np.zeros(int(keep.sum()) + 8, dtype=np.uint8)
    short[: len(short) - 8] = kind[keep]
    # every word starts with a byte that is kept; its shape ends where its last byte was merged to
    start = place[w.start] if len(w.start) else w.start
    size = (place[w.end - 1] - start + 1) if len(w.start) else w.start
    shape = slice_hashes(short, start, size)
    return w, (w.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), (shape % np.uint64(SHAPE_BUCKETS)).astype(np.int64)


def neighbour_sums(doc: np.ndarray, bucket: np.ndarray, buckets: int, seed: int) -> np.ndarray:
    """Sum of the index vectors of every bucket's neighbours within WINDOW words and itself, flat."""
    at, sign = index_vectors(buckets, seed)
    out = np.zeros(buckets * DIMS)
    for lag in range(WINDOW + 1):
        same = doc[lag:] == doc[: len(doc) - lag]
        a, b = bucket[lag:][same], bucket[: len(bucket) - lag][same]
        for x, y in ((a, b), (b, a))[: 1 + (lag > 0)]:
            for k in range(NONZERO):
                out += np.bincount(x * DIMS + at[y, k], weights=sign[y, k], minlength=len(out))
    return out


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def features(self, texts: list[bytes]) -> np.ndarray:
        m = len(texts)
        w, word, shape = streams(texts)
        out = np.zeros((m, 2 * DIMS + 5), dtype=np.float32)
        out[:, 2 * DIMS : 2 * DIMS + 2] = 1  # the spread of no words, whatever texts share the slice
        n = np.maximum(w.count, 1)
        full = np.flatnonzero(w.count)
        if len(full):
            for k, (table, bucket) in enumerate(((self.words, word), (self.shapes, shape))):
                mean = np.zeros((m, DIMS), dtype=np.float32)
                mean[full] = np.add.reduceat(table[bucket], w.first[full], axis=0)
                mean /= n[:, None]
                out[:, k * DIMS : (k + 1) * DIMS] = mean
                out[:, 2 * DIMS + k] = np.sqrt(np.maximum(0, 1 - (mean**2).sum(axis=1)))
            order = np.lexsort((w.hash, w.doc))
            h, d = w.hash[order], w.doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            out[:, 2 * DIMS + 2] = np.bincount(d, weights=new, minlength=m) / np.sqrt(n)
            again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
            out[:, 2 * DIMS + 4] = np.bincount(w.doc[1:], weights=again, minlength=m) / n
        out[:, 2 * DIMS + 3] = np.log1p(w.count)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def train(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the network by Adam on four fifths of the rows and its temperature on the rest."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float64)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(x))
    fit, rest = order[len(x) // 5 :], order[: len(x) // 5]
    z = (x - model.mean) / model.spread
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[at] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(e, p[2]) * (1 - h**2)
            grads = [z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(p)
    if len(rest):
        logit, scale = model.logits(x[rest]), np.geomspace(0.8, 8, 60)
        loss = [np.mean(np.logaddexp(0, np.where(y[rest] == 1, -logit, logit) / s)) for s in scale]
        model.temperature = float(scale[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of label_col (0 or 1) from at most max_labelled rows of labels, those of smallest xxhash64(id).

    Labels that are null, and ids without a text row, are left out. Without any usable label the model
    gives 0.5 for every text; where all labels are equal it tends to that label. Texts stay on the
    executors: the driver gets neighbour sums of fixed size and one vector per sampled row.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = saved(rows.join(F.broadcast(saved(chosen, "labels")), "_id").repartition(6, "_id"), "labelled")

    def sums(batches):
        words, shapes = np.zeros(WORD_BUCKETS * DIMS), np.zeros(SHAPE_BUCKETS * DIMS)
        for pdf in batches:
            for _, texts in text_slices(pdf["_id"], pdf["_text"]):
                w, word, shape = streams(texts)
                words += neighbour_sums(w.doc, word, WORD_BUCKETS, 1)
                shapes += neighbour_sums(w.doc, shape, SHAPE_BUCKETS, 2)
        yield pd.DataFrame({"w": [words.astype("<f4").tobytes()], "s": [shapes.astype("<f4").tobytes()]})

    words, shapes = np.zeros(WORD_BUCKETS * DIMS), np.zeros(SHAPE_BUCKETS * DIMS)
    for r in sample.mapInPandas(sums, "w binary, s binary").toLocalIterator():
        words += np.frombuffer(r[0], dtype="<f4")
        shapes += np.frombuffer(r[1], dtype="<f4")
    unit = lambda t: (t.reshape(-1, DIMS) / np.maximum(np.linalg.norm(t.reshape(-1, DIMS), axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model = Model(unit(words), unit(shapes))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches):
        for pdf in batches:
            for at, texts in text_slices(range(len(pdf)), pdf["_text"]):
                yield pd.DataFrame({"id": pdf["_id"].iloc[at].to_numpy(), "y": pdf["y"].iloc[at].to_numpy(), "x": list(shared.value.features(texts))})

    got = sorted(sample.mapInPandas(vectors, "id long, y int, x array<float>").collect())
    if not got:
        got = [(0, 0, [0.0] * (2 * DIMS + 5)), (1, 1, [0.0] * (2 * DIMS + 5))]
    return train(model, np.array([r[2] for r in got]), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (probability of label 1) and predicted (1 if score >= threshold), rows in place, no shuffle.

    Null and empty texts are scored as a text of no words; repeated rows get equal scores; all columns
    of docs stay, unless they are named score or predicted, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: pd.Series) -> pd.Series:
        out = [shared.value.probability(shared.value.features(texts)) for _, texts in text_slices(range(len(batches)), batches)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    out = docs.withColumn("score", probability(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
