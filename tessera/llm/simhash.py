"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints at 3 or fewer differing bits differ by at most one
bit in one of the segments (two and two would make four), so they agree there on the segment as it is or with one bit
struck out. Both forms are keys; those that share one are verified on all 64 bits there and joined by few links.

A crowded key is dealt on by the same rule for its other segment, whose halves take the place of segments: again one half
differs by one bit at most. What shares a half too is cut by quarters in its task; what shares all that has 11 free
bits left, so no more than 2048 fingerprints ever meet pair by pair.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, slices, stash, text_or_empty
from .components import components
from .similar import pieces, runs

BITS, SEGMENTS = 64, 2
WIDTH = BITS // SEGMENTS
HALF = WIDTH // 2
#: Fingerprints of a key that are compared in one task, pair by pair.
TOGETHER = 2048


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits over all word shingles, repeats included; A-Z count as a-z; no words: 0."""
    words = text.encode().lower().split()  # of bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), "<u8", len(grams))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])

    body = text_or_empty(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, th long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """For each segment its value as it is, and with each of its bits struck out in turn. The key holds segment and place above that value."""
    n = WIDTH + 1  # places of a segment: its bits, then none
    form = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * n - 1))).alias("form"))
    form = form.withColumns({"place": F.expr(f"form % {n}"), "value": F.expr(f"shiftrightunsigned(fp, {WIDTH} * (form div {n})) & {2**WIDTH - 1}L")})
    return form.select(F.expr(f"shiftleft(cast(form as bigint), {WIDTH}) | if(place = {WIDTH}, value, value & ~shiftleft(1L, place))").alias("key"), "fp")


def _least_linked(fp: np.ndarray, distance: int) -> np.ndarray:
    """The place of the first fingerprint that each reaches over links, all compared."""
    least, changed = np.arange(len(fp)), True
    while changed:
        before = least.copy()
        for k in range(0, len(fp), 512):
            near = np.bitwise_count(fp[k : k + 512, None] ^ fp[None, :]) <= distance
            low = np.where(near, least[None, :], len(fp)).min(axis=1)
            least[k : k + 512] = np.minimum(least[k : k + 512], low)
        least = least[least]
        changed = (least != before).any()
    return least


def _linked(fp: np.ndarray, distance: int, together: int, low: int, width: int):
    """Links (a, b) that join different fingerprints as all pairs would, given that they differ, besides the width bits from low on, in few bits only. Many are cut by the halves of these bits."""
    if len(fp) == 2:
        if int(fp[0] ^ fp[1]).bit_count() <= distance:
            yield fp[1:], fp[:1]
        return
    if len(fp) <= together or width < 16:
        least = _least_linked(fp, distance)
        own = np.flatnonzero(least != np.arange(len(fp)))
        if len(own):
            yield fp[own], fp[least[own]]
        return
    half = width // 2
    for h in (0, 1):
        value = (fp >> np.uint64(low + h * half)) & np.uint64(2**half - 1)
        for place in range(half + 1):
            form = value if place == half else value & ~np.uint64(1 << place)
            order = np.argsort(form, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(form[order])) + 1):
                if len(own) > 1:
                    yield from _linked(fp[own], distance, together, low + (1 - h) * half, half)


def _runs(batches, together: int):
    """(key, fingerprints, crowded) of runs of one key in batches in order of key: whole ones, and those of more than together in pieces as they come."""
    key, fp, crowd = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for x in batches:
        key, fp = np.r_[key, x.column("key").to_numpy()], np.r_[fp, x.column("fp").to_numpy()]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        start, end = np.r_[0, cut], np.r_[cut, len(key)]
        wanted = end - start > 1
        wanted[0] |= len(key) > 0 and key[0] == crowd
        for k in np.flatnonzero(wanted[:-1]).tolist():
            at = int(key[start[k]])
            yield at, fp[start[k] : end[k]], at == crowd or end[k] - start[k] > together
        key, fp = key[start[-1] :], fp[start[-1] :]
        if len(key) and (key[0] == crowd or len(key) > together):
            crowd = int(key[0])
            yield crowd, fp, True
            key, fp = key[:0], fp[:0]
    if len(key) > 1 or (len(key) and key[0] == crowd):
        yield int(key[0]), fp, len(key) > together or int(key[0]) == crowd


def _dealt(crowded: DataFrame) -> DataFrame:
    """The rows of crowded keys under these and the forms of the halves of their other segment."""
    n = HALF + 1
    form = crowded.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))).alias("form"))
    other = f"if(shiftright(key, {WIDTH}) div {WIDTH + 1} = 0, {WIDTH}, 0)"
    form = form.withColumns({"place": F.expr(f"form % {n}"), "value": F.expr(f"shiftrightunsigned(fp, cast({other} + {HALF} * (form div {n}) as int)) & {2**HALF - 1}L")})
    return form.select(F.expr(f"shiftleft(key, {HALF + 6}) | shiftleft(cast(form as bigint), {HALF}) | if(place = {HALF}, value, value & ~shiftleft(1L, place))").alias("key"), "fp")


def links(fps: DataFrame, distance: int = 3, together: int = TOGETHER) -> DataFrame:
    """A stash of links (a, b) that join all different fingerprints of fps(fp) at no more than the distance (3 at most).

    Two of them differ in one bit of some segment at most and meet under the segment as it is or with that bit struck out.
    A key gives each of its fingerprints one link at most, to the first that it reaches there, not one for each pair; one of
    more than together fingerprints, one for each form of a half, or of a quarter, that it is dealt by.
    """
    if not 0 <= distance <= 2 * SEGMENTS - 1:
        raise ValueError(f"{SEGMENTS} segments find distances up to {2 * SEGMENTS - 1}")

    def told(held):
        for a, b in pieces(held):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def meet(batches):
        held, n = [], 0
        for key, fp, crowded in _runs(batches, together):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key))], ["a", "b", "key"])
                continue
            for pair in _linked(fp.view(np.uint64), distance, together, 0, 0):
                held.append(pair)
                n += len(pair[0])
            if n > 100_000:
                yield from told(held)
                held, n = [], 0
        yield from told(held)

    def meet_dealt(batches):
        def found():
            for key, fp in runs(batches, ("key", "fp"), "fp", None):
                segment, half = (int(key[0]) >> HALF + 6 + WIDTH) // (WIDTH + 1), (int(key[0]) >> HALF & 63) // (HALF + 1)
                yield from _linked(fp.view(np.uint64), distance, together, WIDTH * (1 - segment) + HALF * (1 - half), HALF)

        for a, b in pieces(found()):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    by_key = lambda d: d.repartition("key").sortWithinPartitions("key")
    met = stash(by_key(_keys(fps)).mapInArrow(meet, "a long, b long, key long"), "fp-met")
    found, crowded = met.where("key is null").select("a", "b"), met.where("key is not null").select("key", F.col("a").alias("fp"))
    if crowded.head(1):
        found = found.union(by_key(_dealt(crowded)).mapInArrow(meet_dealt, "a long, b long"))
    out = stash(found.distinct(), "fp-links")
    drop_stash(met)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (a hash of the text), fp, root (the same for all of a group) and component_id (the smallest doc_id
    reachable over links, its own included) of every row.

    A null text is an empty one; texts without words have fingerprint 0 and link like any other. Null ids never become a
    component's id unless it has no other; repeated rows are returned as often as they come; other columns are ignored;
    an empty table gives none.
    """
    rows = stash(fingerprints(docs, text, doc_id, shingle, seed), "fingerprints")
    distinct = stash(rows.select("fp").distinct(), "fp")
    linked = links(distinct, distance)
    roots = components(linked, "a", "b", "fp-components")
    drop_stash(distinct, linked)
    of = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")
