"""Toxicity by a classifier chain over hashed words.

Categories are predicted one after another; each linear model also gets the probabilities of the categories before it.
In training these are out-of-fold: a document's own label never shaped the probability that a later model sees for it.
The labels have one flag, so the categories before it are latent: the toxic documents of the fit are parted by spherical
k-means over the words and word beginnings that tell them most from the others, and each part is a category, the largest
first. No word list is used. toxic, the last link, is the label itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .embed_dedup import spherical_kmeans, unit

#: Latent kinds of toxic documents, the columns, those of the highest log-odds, that part them, and the links of the chain.
KINDS, TELLING = 3, 256
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
#: Labelled documents, at most about, that the chain is fitted on, those of the least hash. Fixed here, whatever the corpus.
FIT_ROWS = 4000
#: Hash buckets of words and word beginnings, folds, steps of a fit, penalty on squared weights.
BUCKETS, FOLDS, STEPS, PENALTY = 1 << 18, 3, 60, 1e-4
#: Documents that a feature must be in, and the share of them beyond which a feature tells nothing.
LEAST, COMMON = 3, 0.3
#: Lengths of the word beginnings that count beside the word.
HEADS = (5, 6)
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(100_000)
def _buckets(word: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh32_intdigest(x) % BUCKETS for x in (word, *(f"{word[:n]}*" for n in HEADS if len(word) > n)))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how much each counts: 1 for a word that is there, 1 + log(n) for a beginning of n different words."""
    n: dict[int, int] = {}
    for w in words_of(text):
        for b in _buckets(w):
            n[b] = n.get(b, 0) + 1
    return np.fromiter(n.keys(), np.int32, len(n)), (1 + np.log(np.fromiter(n.values(), np.float32, len(n)))).astype(np.float32)


class Sparse:
    """A matrix as row, column and value of its entries."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.n, self.row, self.col, self.val = n, row, col, val

    @classmethod
    def of(cls, sizes: np.ndarray, col: np.ndarray, val: np.ndarray) -> Sparse:
        return cls(len(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), col, val)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def t_dot(self, e: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.val * e[self.row], minlength=width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the columns and of the dense extra ones (bias last), by accelerated gradient steps; weight: of the rows, 0 leaves one out.

    A column enters times its log-odds between the classes of the rows that count, so that telling words lead.
    """
    dense = np.hstack([extra, np.ones((x.n, 1))])
    total = weight.sum()
    scale = _log_odds(x, weight, y, width)
    val = x.val * scale[x.col]
    scaled = Sparse(x.n, x.row, x.col, val)
    w, v = np.zeros(width), np.zeros(dense.shape[1])
    p = min(max((weight * y).sum() / total, 1e-3), 1 - 1e-3)
    v[-1] = np.log(p / (1 - p))
    pw, pv = w, v
    norm = np.bincount(x.row, val**2, minlength=x.n) + (dense**2).sum(axis=1)
    step = 4 / max(1e-9, np.percentile(norm, 95))
    for t in range(STEPS):
        m = t / (t + 3)
        yw, yv = w + m * (w - pw), v + m * (v - pv)
        e = weight * (_sigmoid(scaled.dot(yw) + dense @ yv) - y) / total
        pw, pv = w, v
        w = yw - step * (scaled.t_dot(e, width) + PENALTY * yw)
        v = yv - step * (dense.T @ e)
    return w * scale, v


def _log_odds(x: Sparse, weight: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Log-odds of the columns between the classes of the rows with a weight."""
    for_, against = ((weight > 0) & (y > 0)).astype(np.float64), ((weight > 0) & (y == 0)).astype(np.float64)
    ones = np.bincount(x.col, for_[x.row], minlength=width) + 0.5, np.bincount(x.col, against[x.row], minlength=width) + 0.5
    return np.log(ones[0] / (for_.sum() + 1)) - np.log(ones[1] / (against.sum() + 1))


def kinds(x: Sparse, toxic: np.ndarray, width: int) -> np.ndarray:
    """A column for each latent kind: which toxic rows are of it. A toxic row without any telling column is of the first."""
    out = np.zeros((x.n, KINDS), bool)
    rows = np.flatnonzero(toxic)
    if not len(rows):
        return out
    odds = _log_odds(x, np.ones(x.n), toxic, width)
    top = np.argsort(-odds, kind="stable")[:TELLING]
    top = top[odds[top] > 0]
    at, place = np.full(width, -1), np.full(x.n, -1)
    at[top], place[rows] = np.arange(len(top)), np.arange(len(rows))
    own = (place[x.row] >= 0) & (at[x.col] >= 0)
    m = np.zeros((len(rows), len(top)))
    m[place[x.row[own]], at[x.col[own]]] = odds[x.col[own]]
    some = np.flatnonzero(m.any(axis=1))
    part = np.zeros(len(rows), np.int64)
    if len(some):
        m = unit(m[some])
        part[some] = (m @ spherical_kmeans(m, KINDS).T).argmax(axis=1)
    rank = np.argsort(np.argsort(-np.bincount(part, minlength=KINDS), kind="stable"))
    out[rows, rank[part]] = True
    return out


class Chain:
    def __init__(self):
        self.words = np.zeros((BUCKETS, len(CATEGORIES)), np.float32)
        self.links = [np.zeros(k + 1) for k in range(len(CATEGORIES))]
        for v in self.links:
            v[-1] = -30.0  # without labels nothing is toxic
        self.threshold = 0.5

    def fit(self, raw: Sparse, toxic: np.ndarray, fold: np.ndarray) -> None:
        """toxic: a label for each document."""
        docs = np.bincount(raw.col, minlength=BUCKETS)
        used = np.flatnonzero((docs >= LEAST) & (docs <= COMMON * raw.n))
        index = np.full(BUCKETS, -1)
        index[used] = np.arange(len(used))
        keep = index[raw.col] >= 0
        x = Sparse(raw.n, raw.row[keep], index[raw.col[keep]].astype(np.int32), raw.val[keep])
        before, y = np.zeros((x.n, 0)), np.column_stack([kinds(x, toxic, len(used)), toxic])
        for k in range(len(CATEGORIES)):
            target = y[:, k].astype(np.float64)
            rare = min(20.0, max(1.0, 0.3 * (len(target) - target.sum()) / max(1.0, target.sum())))
            weight = np.where(target > 0, rare, 1.0)
            out = np.zeros(x.n)
            for f in range(FOLDS):
                w, v = logistic(x, before, target, weight * (fold != f), len(used)) if (fold != f).any() else (np.zeros(len(used)), np.zeros(k + 1))
                own = fold == f
                out[own] = _sigmoid(x.dot(w) + before @ v[:-1] + v[-1])[own]
            w, v = logistic(x, before, target, weight, len(used))
            self.words[used, k], self.links[k] = w, v
            before = np.hstack([before, out[:, None]])
        # the cut with the best F1 out of fold
        order = np.argsort(-out, kind="stable")
        hit = np.cumsum(target[order])
        f1 = 2 * hit / (np.arange(1, x.n + 1) + max(1.0, target.sum()))
        best = int(f1.argmax())
        self.threshold = float(np.clip((out[order[best]] + (out[order[best + 1]] if best + 1 < x.n else 0)) / 2, 0.05, 0.95)) if target.any() else 0.5

    def predict(self, x: Sparse) -> np.ndarray:
        out = np.zeros((x.n, 0))
        for k in range(len(CATEGORIES)):
            z = x.dot(self.words[:, k]) + out @ self.links[k][:-1] + self.links[k][-1]
            out = np.hstack([out, _sigmoid(z)[:, None]])
        return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Chain:
    """A chain from the labelled documents of the least hash, FIT_ROWS at most about. Null labels are left out; one toxic label of several makes a document toxic; without labels nothing is toxic."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * FIT_ROWS / n))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [_features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc_id", "y", "at", "value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id")
    got = rows.mapInArrow(run, "doc_id long, y int, at array<int>, value array<float>").toArrow().sort_by("doc_id")  # FIT_ROWS documents
    chain = Chain()
    if not got.num_rows:
        return chain
    y = got["y"].to_numpy().astype(bool)
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in got["doc_id"].to_pylist()])
    at, value = (got[c].combine_chunks() for c in ("at", "value"))
    at, value = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (at, value))
    chain.fit(Sparse.of(pa.compute.list_value_length(at).to_numpy(), at.flatten().to_numpy(), value.flatten().to_numpy()), y, fold)
    return chain


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, a probability p_<category> for each link of the chain and predicted (1: toxic) of every row of docs.

    Each whole text is scored; a null text is an empty one, which is toxic only if the labels say so of most texts. Null
    ids and repeated rows pass through; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id, label))  # BUCKETS * len(CATEGORIES) weights

    def run(batches):
        chain = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [_features(t) for t in part.column("text").to_pylist()]
                p = chain.predict(Sparse.of(np.array([len(f[0]) for f in found]), *(np.concatenate([f[k] for f in found]) for k in (0, 1))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, j]) for j in range(len(CATEGORIES))), pa.array((p[:, -1] >= chain.threshold).astype(np.int32))], ["doc_id", *(f"p_{c}" for c in CATEGORIES), "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'p_{c} double' for c in CATEGORIES)}, predicted int")
