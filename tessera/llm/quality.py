"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over standardized statistics of a whole text. Each partition of the training
rows sums its own normal equations, one set for each fold; the sums give the ridge weights and, less one fold each, scores
that their own rows took no part in. Pool-adjacent-violators over these scores makes probabilities of them.
"""

from __future__ import annotations

import math
import zlib
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, slices, stash, text_or_empty

#: Labelled documents, at most about, that the model is fitted on (those of the least hash), and parts that they are summed in.
FIT_ROWS, FIT_PARTS = 40_000, 8
#: Random features, folds, ridge penalty a row, bandwidth as a share of the root of the statistics' number, bins of the calibration.
FEATURES, FOLDS, RIDGE, BANDWIDTH, BINS = 256, 4, 1e-4, 0.7, 2000

STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "spaces", "symbols", "non_ascii", "vowel_like", "entropy", "deflated", "distinct_words", "distinct_pairs", "same_as_last",
    "upper_words", "title_words", "symbol_words", "ends_in_symbol", "bare_symbol_words", "log_words_per_line", "distinct_lines", "short_lines", "log_longest_run", "log_longest_word", "top_word", "stops",
)

_UPPER, _DIGIT, _SPACE = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _DIGIT[48:58] = 1
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_VOWEL = np.zeros(256)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = 1
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_SYMBOL = np.zeros(256)
_SYMBOL[33:127] = 1
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = 0
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _SYMBOL, _HIGH, _VOWEL])
_ORDINARY_ENDS = frozenset(".,;:?")


def statistics(text: str) -> list[float]:
    """The STATISTICS of a whole text; an empty one has zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, space, symbol, high, vowel = (_CLASSES @ counts / n).tolist()
    p = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    ends = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in _ORDINARY_ENDS)
    bare = sum(c for w, c in seen.items() if not any(map(str.isalnum, w)))
    return [
        math.log1p(n), math.log1p(len(words)), n / m, upper, digit, space, symbol, high, vowel, float(-(p * np.log2(p)).sum()), len(zlib.compress(raw, 1)) / (n + 20), len(seen) / m, len(set(pairwise(words))) / m,
        sum(map(str.__eq__, words, words[1:])) / m, sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / m, sum(c for w, c in seen.items() if w.istitle()) / m, sum(c for w, c in seen.items() if not w.isalpha()) / m, ends / m, bare / m,
        math.log1p(m / k), len(set(lines)) / k, sum(1 for x in lines if len(x) < 40) / k, math.log1p(max((sum(1 for _ in g) for _, g in groupby(words)), default=0)), math.log1p(max(map(len, words), default=0)), max(seen.values(), default=0) / m, text.count(". ") / m,
    ]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit to y at ascending x with weights w (pool adjacent violators), joined by straight lines."""
    blocks: list[list[float]] = []  # mean, weight, weighted x
    for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([yi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, v, z = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + m * v) / (b[1] + v)
            b[1] += v
            b[2] += z
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Means and scales of the statistics, the random features, ridge weights (all, then less a fold each) and the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES)) / (BANDWIDTH * math.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros((FOLDS + 1, FEATURES + 1))
        self.knots, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def solve(self, grams: np.ndarray, rights: np.ndarray, rows: np.ndarray) -> None:
        penalty = np.eye(FEATURES + 1)
        penalty[-1, -1] = 0
        for k in range(FOLDS + 1):
            less = 0 if k == 0 else 1
            g, r, n = grams.sum(0) - less * grams[k - 1], rights.sum(0) - less * rights[k - 1], rows.sum() - less * rows[k - 1]
            self.beta[k] = np.linalg.solve(g + (RIDGE * max(n, 1) + 1e-9) * penalty + 1e-9 * np.eye(FEATURES + 1), r)

    def raw(self, x: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        f = self.features(x)
        return f @ self.beta[0] if fold is None else np.einsum("ij,ij->i", f, self.beta[fold + 1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from the training; a null id's are."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(STATISTICS))


def _measured(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """A model from the labelled documents that are not held out, those of the least hash, FIT_ROWS at most about. Null labels are left out, several of one document averaged; without any all scores are 0.5."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    if (n := known.count()) > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * FIT_ROWS / n))

    def measure(batches):
        for b in slices(batches):
            x = _measured(b.column("text").to_pylist()).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([lists, b.column("y"), b.column("h")], ["x", "y", "h"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("h"))
    rows = chosen.mapInArrow(measure, "x array<float>, y int, h long")
    rows = stash(rows.withColumn("fold", F.pmod(F.shiftright("h", 24), F.lit(FOLDS)).cast("int")).repartition(FIT_PARTS, "h"), "quality-fit")
    each = [F.col("x")[k].cast("double") for k in range(len(STATISTICS))]
    n, *got = rows.agg(F.count("*"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    moments = np.array([v or 0.0 for v in got])
    model = Model(moments[: len(each)], np.maximum(moments[len(each) :], 1e-6))
    if not n:
        return model

    def sums(batches):
        g, r, m = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
        for b in batches:
            f, y, fold = model.features(_vectors(b.column("x"))), b.column("y").to_numpy().astype(np.float64), b.column("fold").to_numpy()
            for k in range(FOLDS):
                own = f[fold == k]
                g[k] += own.T @ own
                r[k] += own.T @ y[fold == k]
                m[k] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["g", "r", "m"])

    parts = rows.select("x", "y", "fold").mapInArrow(sums, "g binary, r binary, m binary").collect()  # FIT_PARTS matrices of fixed size
    total = {k: sum(np.frombuffer(p[k]) for p in parts) for k in ("g", "r", "m")}
    model.solve(total["g"].reshape(FOLDS, FEATURES + 1, FEATURES + 1), total["r"].reshape(FOLDS, FEATURES + 1), total["m"])

    def scored(batches):
        for b in batches:
            s = model.raw(_vectors(b.column("x")), b.column("fold").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(s, -1, 2) * BINS).astype(np.int64)), pa.array(s), b.column("y")], ["bin", "s", "y"])

    bins = rows.select("x", "y", "fold").mapInArrow(scored, "bin long, s double, y int").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()  # 3 * BINS rows at most
    drop_stash(rows)
    model.knots, model.values = isotonic(bins["s"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) of every row of docs.

    The score follows from the text alone; null texts count as empty ones, which have a score like any other. Null ids
    and repeated rows pass through; other columns are ignored; an empty table gives none.
    """
    model = fit(docs, labels, text, doc_id, label)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_measured(b.column("text").to_pylist())))], ["doc_id", "score"])

    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of docs, as they are, whose texts score at least 0.5."""
    model = fit(docs, labels, text, doc_id, label)
    place = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.score(_measured(b.column(place).to_pylist())) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
