"""Variable-capacity best-fit packing of documents into training sequences.

Pieces of documents go, the largest first, into the open bin with the least room that still takes them; where none does,
a bin opens. Its length is chosen among all permitted ones by what is left to pack: for each length, the bin is filled on
trial with the largest pieces still to come that fit, from one histogram of sizes, and the length opens whose bin, shrunk to
that filling, costs least a token. So lengths mix within a packing. The packings with one usual length each are a bound:
where one of them costs less, it is taken. At the end each bin shrinks to the least permitted length that holds its contents.
Documents are packed in parcels of bounded size, dealt by hash, so that the work spreads over the cluster; a parcel loses
less than its last few bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Permitted sequence lengths in tokens, and what a sequence costs beside its length.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 16
#: Rows of a parcel, about.
PARCEL = 20_000


class _Left:
    """How many pieces of each size are still to come."""

    def __init__(self, sizes: Sequence[int]):
        values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
        self.values, self.counts = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def filling(self, size: int, length: int) -> int:
        """Tokens in a bin of the length that opens with a piece of the size (already taken out) and takes the largest pieces that fit, again and again. All larger pieces are placed."""
        room, k = length - size, bisect_right(self.values, size)
        while room and (k := bisect_right(self.values, room, 0, k)):
            v = self.values[k - 1]
            room -= v * min(self.counts[v], room // v)
            k -= 1
        return length - room


def best_fit(sizes: Sequence[int], lengths: Sequence[int], usual: int | None = None, overhead: int = OVERHEAD) -> tuple[np.ndarray, list[int]]:
    """The bin of each piece and each bin's used tokens. Bins open with the length usual, larger ones only for pieces that need them; without one, with the length of least cost (ties: the smaller length)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = _Left(sizes)
    room: list[tuple[int, int]] = []  # of the open bins, ascending
    used: list[int] = []
    at = np.zeros(len(sizes), np.int64)

    def opened(size: int) -> int:
        fits = lengths[bisect_left(lengths, size) :]
        if usual is not None:
            return max(usual, fits[0])
        filled = [left.filling(size, n) for n in fits]
        return min(zip(fits, filled, strict=True), key=lambda x: ((lengths[bisect_left(lengths, x[1])] + overhead) / x[1], x[0]))[0]

    for i in order:
        size = sizes[i]
        left.counts[size] -= 1
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b, free = len(used), opened(size)
            used.append(0)
        at[i] = b
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return at, used


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and each bin's length: of the joint packing, or of that with one usual length if it costs less after shrinking (ties: the joint one, then the smaller length)."""
    best = None
    for usual in (None, *lengths):
        at, used = best_fit(sizes, lengths, usual, overhead)
        final = np.array(lengths, np.int64)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = (cost, at, final)
    return best[1], best[2]


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, text: str = "text", doc_id: str = "doc_id", tokens: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, bin (parcel:number), bin_length and offset: where each piece of each row's tokens goes.

    tokens: a column of token counts; without one, words at white space are counted. A row longer than the largest length
    is cut into pieces of that length and a rest; rows without tokens (null texts, empty ones, counts of null or 0) need
    no place and are left out. Null ids and repeated rows are packed like others; other columns are ignored; an empty
    table gives none. Pieces in a bin follow each other from offset 0 without gaps. Pieces of equal size go in the order of
    their rows' hashes, ids and counts.
    """
    lengths = sorted(lengths)
    count = F.size(F.filter(F.split(text_or_empty(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long") if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), count.alias("n"), F.xxhash64(F.col(doc_id), text_or_empty(text) if tokens is None else F.col(tokens)).alias("h")).where("n > 0")
    parcels = max(1, -(-docs.count() // PARCEL))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["h", "doc_id", "n"], kind="stable")
        n = t["n"].to_numpy(np.int64)
        pieces = -(-n // lengths[-1])
        row = np.repeat(np.arange(len(t)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(lengths[-1], n[row] - piece * lengths[-1])
        at, final = pack(size.tolist(), lengths, overhead)
        order = np.lexsort((np.arange(len(at)), at))
        before = np.cumsum(size[order]) - size[order]
        starts = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        offset = np.zeros(len(at), np.int64)
        offset[order] = before - np.repeat(before[starts], np.diff(np.append(starts, len(at))))
        parcel = int(t["parcel"].iloc[0])
        return pd.DataFrame({"doc_id": t["doc_id"].to_numpy()[row], "piece": piece, "start": piece * lengths[-1], "length": size, "bin": [f"{parcel}:{b}" for b in at], "bin_length": final[at], "offset": offset})

    dealt = rows.withColumn("parcel", F.pmod("h", F.lit(parcels)).cast("int"))
    return dealt.groupBy("parcel").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, bin string, bin_length long, offset long")
