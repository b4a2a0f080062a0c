"""Vector codes by product quantisation, the codebooks learnt with Elkan's variant of Lloyd's rounds.

A vector's integer components are cut into parts; each part is coded by the nearest entry of its position's codebook. Between
rounds a table keeps, for each vector and part, the entry, an upper bound of the distance to it and one lower bound for
every entry. When entries move, upper bounds grow and lower bounds shrink by the movement. An entry is left out only if a
bound says that it is strictly farther than the present one: its lower bound, or half the distance between the two entries.
All others are compared by exact integer squared distances, ties to the lower index, so codes are those of full search.

Lower bounds are stored as bytes, in steps of a 255th of the largest one of the vector and part, rounded down: they stay
bounds, and a vector of 64 components takes a kilobyte between rounds instead of eight. Sums of a round are made per task;
the driver sees the codebooks and their sums, entries x components numbers whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stash, stash

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components' absolute values, at most: their squared distances then fit 64 bits.
LARGEST = 1 << 28
#: Vectors that a task works on at once.
TOGETHER = 1024
#: What rounding may add to a distance, relatively.
_SLACK = 1e-12

#: Of each part its codebook: rows are entries.
Book = list[np.ndarray]


def cuts(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal parts where the width allows it, else as equal as can be."""
    return [width * p // parts for p in range(parts + 1)]


class Bounds:
    """Codes of some vectors' part with an upper bound for each, and a lower bound for each entry."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.upper, self.lower = code, upper, lower

    @classmethod
    def full(cls, x: np.ndarray, entries: np.ndarray) -> Bounds:
        """All distances."""
        d2 = squared(x, entries)
        code = d2.argmin(axis=1)
        d = np.sqrt(d2.astype(np.float64))
        return cls(code, d[np.arange(len(x)), code] * (1 + _SLACK), d * (1 - _SLACK))

    def moved(self, moves: np.ndarray) -> None:
        self.upper = (self.upper + moves[self.code]) * (1 + _SLACK)
        self.lower = np.maximum(0, (self.lower - moves) * (1 - _SLACK))

    def settle(self, x: np.ndarray, entries: np.ndarray) -> int:
        """Assigns again after a movement; how many distances it took."""
        half = np.sqrt(squared(entries, entries).astype(np.float64)) / 2 * (1 - _SLACK)
        rows = np.arange(len(x))

        def open_to(r: np.ndarray) -> np.ndarray:
            """Entries, besides the own one, that no bound excludes."""
            u = self.upper[r, None]
            may = (self.lower[r] <= u) & (half[self.code[r]] <= u)
            may[np.arange(len(r)), self.code[r]] = False
            return may

        own = rows[open_to(rows).any(axis=1)]
        if not len(own):
            return 0
        d = x[own] - entries[self.code[own]]
        best = (d * d).sum(axis=1)
        exact = np.sqrt(best.astype(np.float64))
        self.upper[own], self.lower[own, self.code[own]] = exact * (1 + _SLACK), exact * (1 - _SLACK)
        r, j = np.nonzero(open_to(own))
        d = x[own[r]] - entries[j]
        d2 = (d * d).sum(axis=1)
        self.lower[own[r], j] = np.sqrt(d2.astype(np.float64)) * (1 - _SLACK)
        all_ = np.full((len(own), len(entries)), np.iinfo(np.int64).max)
        all_[r, j] = d2
        all_[np.arange(len(own)), self.code[own]] = best
        code = all_.argmin(axis=1)  # the lower index on ties
        self.code[own] = code
        self.upper[own] = np.sqrt(all_[np.arange(len(own)), code].astype(np.float64)) * (1 + _SLACK)
        return len(own) + len(r)

    def errors(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        d = x - entries[self.code]
        return (d * d).sum(axis=1)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def stored_bounds(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (vectors, entries) as bytes and their steps."""
    step = lower.max(axis=1) / 255
    return np.floor(lower / np.where(step > 0, step, 1)[:, None] * (1 - _SLACK)).astype(np.uint8), step


_STATE = "width int, v binary, code binary, upper binary, step binary, lower binary"
_ASIDE = ["id", "label"]


def _flat(b: pa.RecordBatch, column: str, kind: str) -> np.ndarray:
    """A binary column of equal lengths as the rows of a matrix."""
    return np.stack([np.frombuffer(x.as_buffer(), kind) for x in b.column(column)])


def _by_width(batches, together: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        for at in range(0, b.num_rows, together):
            part = b.slice(at, together)
            w = part.column("width").to_numpy(zero_copy_only=False)
            for width in np.unique(w):
                yield int(width), part.take(pa.array(np.flatnonzero(w == width)))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _state(part: pa.RecordBatch, bounds: list[Bounds]) -> pa.RecordBatch:
    kept = [stored_bounds(b.lower) for b in bounds]
    columns = [_bytes(np.stack([b.code for b in bounds], 1).astype(np.uint8)), _bytes(np.stack([b.upper for b in bounds], 1)), _bytes(np.stack([s for _, s in kept], 1)), _bytes(np.concatenate([low for low, _ in kept], 1))]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in (*_ASIDE, "width", "v")), *columns], [*_ASIDE, "width", "v", "code", "upper", "step", "lower"])


def _bounds(part: pa.RecordBatch, parts: int) -> list[Bounds]:
    code, upper, step, lower = _flat(part, "code", "u1"), _flat(part, "upper", "<f8"), _flat(part, "step", "<f8"), _flat(part, "lower", "u1")
    lower = lower.reshape(len(code), parts, -1)
    return [Bounds(code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p] * step[:, p, None] * (1 - _SLACK)) for p in range(parts)]


def _first_codes(books: dict[int, Book], parts: int, together: int):
    def run(batches):
        for width, part in _by_width(batches, together):
            v, at = _flat(part, "v", "<i8"), cuts(width, parts)
            yield _state(part, [Bounds.full(v[:, at[p] : at[p + 1]], books[width][p]) for p in range(parts)])

    return run


def _next_codes(books: dict[int, Book], moves: dict[int, list[np.ndarray]], parts: int, together: int, last: bool):
    def run(batches):
        for width, part in _by_width(batches, together):
            v, at, bounds = _flat(part, "v", "<i8"), cuts(width, parts), _bounds(part, parts)
            error = np.zeros(len(v), np.int64)
            for p, b in enumerate(bounds):
                x = v[:, at[p] : at[p + 1]]
                b.moved(moves[width][p])
                b.settle(x, books[width][p])
                error += b.errors(x, books[width][p])
            if last:
                codes = np.stack([b.code for b in bounds], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*_ASIDE, "width")), _bytes(codes), pa.array(error)], [*_ASIDE, "width", "codes", "error"])
            else:
                yield _state(part, bounds)

    return run


def _sums(parts: int, entries: int, together: int):
    """For each task and width the sums and counts of the entries' parts."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for width, part in _by_width(batches, together):
            v, code, at = _flat(part, "v", "<i8"), _flat(part, "code", "u1"), cuts(width, parts)
            own = total.setdefault(width, np.zeros((entries, width + parts), np.int64))
            for p in range(parts):
                np.add.at(own[:, at[p] : at[p + 1]], code[:, p], v[:, at[p] : at[p + 1]])
                own[:, width + p] += np.bincount(code[:, p], minlength=entries)
        for width, own in total.items():
            entry, place = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), width, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(own[entry, place])], ["width", "entry", "place", "s"])

    return run


def _updated(state: DataFrame, books: dict[int, Book], parts: int, entries: int, together: int) -> tuple[dict[int, Book], dict[int, list[np.ndarray]]]:
    """The codebooks of the next round and how far each entry moves."""
    sums = state.select("width", "v", "code").mapInArrow(_sums(parts, entries, together), "width int, entry int, place int, s long").groupBy("width", "entry", "place").agg(F.sum("s").alias("s")).toArrow().to_pydict()
    width_of, entry, place, s = (np.array(sums[c], np.int64) for c in ("width", "entry", "place", "s"))
    new, moves = {}, {}
    for width, book in books.items():
        own = np.zeros((entries, width + parts), np.int64)
        rows = width_of == width
        own[entry[rows], place[rows]] = s[rows]
        at, new[width], moves[width] = cuts(width, parts), [], []
        for p, old in enumerate(book):
            n, now = own[: len(old), width + p], old.copy()
            used = n > 0
            now[used] = own[: len(old), at[p] : at[p + 1]][used] // n[used, None]  # floors
            d = (now - old).astype(np.float64)
            new[width].append(now)
            moves[width].append(np.sqrt((d * d).sum(axis=1)) * (1 + _SLACK))
    return new, moves


def digest(book: Book) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for entry in part.tolist() for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", together: int = TOGETHER) -> tuple[DataFrame, dict[int, Book]]:
    """Codes (vec_id, label, width, codes as bytes, error) of all rows with a fit vector, and the codebooks by vector length.

    Components x count as floor(scale * x), x as double. A part position's codebook starts as that part of the vectors of
    the smallest ids (null ids last, ties by the vectors themselves), fewer than entries if there are fewer rows; each
    round assigns all parts to the nearest entry (squared Euclidean distance, ties to the lower index) and moves each
    entry to the floor of its parts' mean; entries without parts stay. Then parts are assigned again.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of each length have codebooks
    of their own; a length that the number of parts does not divide is cut as equally as can be, so that a vector shorter
    than that has empty parts (code 0, distance 0). Rows with one id, or none, are coded like others; other columns are
    ignored; an empty table gives none. Components beyond 2^28 in absolute value are an error.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("a code is a byte: 1 to 256 entries; one round at least")
    fit = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("e")).where("e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    fit = fit.select("id", "label", F.size("e").alias("width"), F.expr(f"transform(e, x -> cast(floor(cast(x as double) * {scale}D) as bigint))").alias("v"))
    nth = F.row_number().over(W.partitionBy("width").orderBy(F.col("id").asc_nulls_last(), "v"))
    books: dict[int, Book] = {}
    for r in fit.withColumn("nth", nth).where(F.col("nth") <= entries).orderBy("width", "nth").select("width", "v").collect():
        at = cuts(r.width, parts)
        book = books.setdefault(r.width, [[] for _ in range(parts)])
        for p in range(parts):
            book[p].append(r.v[at[p] : at[p + 1]])
    books = {w: [np.array(x, np.int64).reshape(len(x), -1) for x in book] for w, book in books.items()}

    def packed(batches):
        for b in batches:
            flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column("width").to_numpy(zero_copy_only=False))
            if len(flat) and max(-int(flat.min()), int(flat.max())) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} in absolute value")
            raw = flat.astype("<i8").tobytes()
            starts = np.append(0, ends[:-1]) * 8
            v = pa.array([raw[i:j] for i, j in zip(starts.tolist(), (ends * 8).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("width"), v], ["id", "label", "width", "v"])

    aside = ", ".join(f"{c} {fit.schema[c].dataType.simpleString()}" for c in _ASIDE)
    rows = fit.mapInArrow(packed, f"{aside}, width int, v binary")
    state = stash(rows.mapInArrow(_first_codes(books, parts, together), f"{aside}, {_STATE}"), "code-state")
    for k in range(rounds):
        books, moves = _updated(state, books, parts, entries, together)
        last = k == rounds - 1
        schema = f"{aside}, width int, codes binary, error long" if last else f"{aside}, {_STATE}"
        after = stash(state.mapInArrow(_next_codes(books, moves, parts, together, last), schema), "codes" if last else "code-state")
        drop_stash(state)
        state = after
    return state.withColumnRenamed("id", "vec_id"), books


def coded(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256 (of the decimal components of the codebooks of the vector's length) of the rows that compress() codes."""
    codes, books = compress(vectors, **options)
    # labels may be as many as rows: the planner broadcasts their sums only where they turn out small
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    said = F.create_map(*(F.lit(x) for w, b in sorted(books.items()) for x in (w, digest(b)))) if books else F.lit(None).cast("map<int,string>")
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", said[F.col("width")].alias("codebooks_sha256"))
