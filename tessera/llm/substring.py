"""Repeated passages by relative Lempel-Ziv parsing.

Documents are read in reference blocks. A block is indexed by every window of `window` words; each of its documents is
greedily factored against it: at an indexed window the longest copy from an earlier document is taken, and windows that
start near the end of a factor, so that they cross its boundary, are looked up on their own. What a block does not hold is
asked of all other blocks at once: windows meet by key in a shuffle, where the smallest doc_id with a window is its
reference. A key is the least hash of the five-word shingles within a window, so that neighbouring windows travel as one
row and a window's copies come to the same place wherever they are. A window that its own block has already answered is
never sent, so a passage that all documents share travels once for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, slices, text_or_empty

#: Words of a reference block, about; a longer document is a block of its own.
BLOCK_WORDS = 1 << 19
#: Words of the shingle whose least hash within a window is the key.
ANCHOR_WORDS = 5
#: Documents, about, from which crowded keys are learnt, and rows there that make a key crowded. They decide where windows meet, never what is found.
CROWD_SAMPLE, CROWDED = 4096, 16
#: Rows that a task of the second step holds at a time.
STEP_ROWS = 100_000

#: n: words of a span that needs no answer; tags: 32 hash bits of each window of a row, packed.
_SENT = "key long, rid long, th long, pos int, n int, tags binary"


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each n neighbours."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, seed, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : len(words) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _copied(words: np.ndarray, i: int, s: int, most: int) -> int:
    """How many words from i on equal those from s on, most at most."""
    done, step = 0, 64
    while done < most:
        k = min(step, most - done)
        if len(odd := np.flatnonzero(words[i + done : i + done + k] != words[s + done : s + done + k])):
            return done + int(odd[0])
        done, step = done + k, step * 4
    return most


class Block:
    """A reference block: the word hashes of some documents in the order of their ids, indexed by all their windows."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]], window: int):
        docs = sorted(docs, key=lambda d: d[:2])
        self.window = window
        self.rid, self.th = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
        self.words = np.concatenate([d[2] for d in docs]) if docs else np.zeros(0, np.uint64)
        sizes = np.array([len(d[2]) for d in docs], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.hash = _rolling(self.words, window, 1)
        n = len(self.hash)
        at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 : window - 1 + n])  # windows within one document
        order = at[np.argsort(self.hash[at], kind="stable")]
        first = np.ones(len(order), bool)
        first[1:] = self.hash[order[1:]] != self.hash[order[:-1]]
        source = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
        known = self.rid[self.doc[order]] > self.rid[self.doc[source]]
        self.source = np.full(n, -1, np.int64)
        self.source[order[known]] = source[known]
        self.hits = np.flatnonzero(self.source >= 0)
        self.misses = at[self.source[at] < 0]

    def factors(self) -> list[tuple[int, int]]:
        """Greedy parse: (place, words) of the longest copies from documents with smaller ids, the windows over a factor's end parsed anew."""
        out, k = [], 0
        while k < len(self.hits):
            i = int(self.hits[k])
            s = int(self.source[i])
            size = _copied(self.words, i, s, int(min(self.end[self.doc[i]] - i, self.end[self.doc[s]] - s)))
            if size >= self.window:
                out.append((i, size))
            k = int(np.searchsorted(self.hits, i + max(1, size - self.window + 1)))
        return out

    def questions(self, crowded: np.ndarray):
        """Places, key and tags of the windows that no earlier document of the block holds; neighbours with one key together."""
        at = self.misses
        key = _least_of(_rolling(self.words, ANCHOR_WORDS, 2), self.window - ANCHOR_WORDS + 1)[at]
        tags = (self.hash[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
        if len(crowded) and len(at):
            alone = crowded[np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)] == key
            key = np.where(alone, self.hash[at], key)
            new |= alone
        starts = np.flatnonzero(new)
        return at[starts], key[starts], np.append(starts, len(at)), tags


def _blocks(batches, window: int):
    """Reference blocks from batches of rid, th and body (bytes)."""
    memo, docs, n = _WordHash(), [], 0
    for part in slices(batches):
        for rid, th, body in zip(*(part.column(c).to_pylist() for c in ("rid", "th", "body")), strict=True):
            words = body.split()  # of bytes: at ASCII white space
            if len(words) < window:
                continue
            docs.append((rid, th, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))))
            n += len(words)
            if n >= BLOCK_WORDS:
                yield Block(docs, window)
                docs, n = [], 0
    if docs:
        yield Block(docs, window)


def _ask(window: int, crowded: np.ndarray):
    """First step: spans that a block answers itself (n words, no tags), and rows of windows for the other blocks."""

    def run(batches):
        for block in _blocks(batches, window):
            if found := np.array(block.factors(), np.int64).reshape(-1, 2).tolist():
                at, size = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
                d = block.doc[at]
                pos = at - block.start[d]
                spread = (block.rid[d] * 31 + pos) * np.int64(0x5851F42D4C957F2D)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(block.rid[d]), pa.array(block.th[d]), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.nulls(len(at), pa.binary())], ["key", "rid", "th", "pos", "n", "tags"])
            at, key, offsets, tags = block.questions(crowded)
            for k in range(0, len(at), STEP_ROWS):
                part = slice(k, min(k + STEP_ROWS, len(at)))
                o = offsets[part.start : part.stop + 1]
                d = block.doc[at[part]]
                packed = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(((o - o[0]) * 4).astype(np.int32)), pa.py_buffer(tags[o[0] : o[-1]])])
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(block.rid[d]), pa.array(block.th[d]), pa.array((at[part] - block.start[d]).astype(np.int32)), pa.array(np.zeros(len(d), np.int32)), packed], ["key", "rid", "th", "pos", "n", "tags"])

    return run


def _answer(window: int):
    """Second step, over rows in the order of key and rid: spans of windows that a smaller rid has under the same key and tag."""

    def spans(rid, th, pos, n):
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["rid", "th", "pos", "n"])

    def step(t: pa.Table, seen):
        own = t.filter(pa.compute.is_null(t["tags"]))
        if own.num_rows:
            yield spans(*(own[c].to_numpy() for c in ("rid", "th", "pos", "n")))
        t = t.filter(pa.compute.is_valid(t["tags"]))
        key, rid, th, pos = (t[c].to_numpy() for c in ("key", "rid", "th", "pos"))
        if not len(key):
            return
        same = key[1:] == key[:-1]
        kept = np.zeros(len(key), bool)
        kept[1:] |= same
        kept[:-1] |= same
        kept |= (key == key[-1]) | (key == seen[0][0] if len(seen[0]) else False)
        if not kept.all():
            t = t.filter(pa.array(kept))
            key, rid, th, pos = (x[kept] for x in (key, rid, th, pos))
        n = pa.compute.binary_length(t["tags"]).to_numpy() // 4
        tags = np.frombuffer(b"".join(t["tags"].to_pylist()), np.int32)
        row = np.repeat(np.arange(len(key)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        old = len(seen[0])
        k, g, r = (np.concatenate([a, b]) for a, b in zip(seen, (key[row], tags, rid[row]), strict=True))
        order = np.lexsort((g, k))  # stable: rids stay in order
        first = np.ones(len(order), bool)
        first[1:] = (k[order[1:]] != k[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hit = np.zeros(len(order), bool)
        hit[order] = r[order] > r[head]
        hit = np.flatnonzero(hit[old:])
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
            at = np.flatnonzero(new)
            w = hit[at]
            yield spans(rid[row[w]], th[row[w]], pos[row[w]] + within[w], np.diff(np.append(at, len(hit))) + window - 1)
        last = order[first & (k[order] == key[-1])]
        seen[:] = [k[last], g[last], r[last]]

    def run(batches):
        held, rows = [], 0
        seen = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]  # of the key that may go on
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= STEP_ROWS:
                yield from step(pa.Table.from_batches(held), seen)
                held, rows = [], 0
        if held:
            yield from step(pa.Table.from_batches(held), seen)

    return run


def _crowded(rows: DataFrame, n: int, window: int) -> np.ndarray:
    """Keys that many different passages of a sample of documents share; the windows of these are dealt one by one."""

    def run(batches):
        for block in _blocks(batches, window):
            _, key, _, _ = block.questions(np.zeros(0, np.uint64))
            keys, counts = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= CROWDED].view(np.int64))], ["key"])

    sample = rows.sample(min(1.0, CROWD_SAMPLE / max(n, 1)), seed=7).repartition(1)
    return np.unique(np.array([r.key for r in sample.mapInArrow(run, "key long").distinct().collect()], np.int64).view(np.uint64))


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["pos"], x["pos"] + x["n"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _without(words: list[bytes], spans: list[list[int]]) -> bytes:
    for s, e in reversed(spans):
        del words[s:e]
    return b" ".join(words)


def _with_spans(docs: DataFrame, text: str, doc_id: str, window: int) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names) and spans: unmerged pieces (pos, n) of words that a smaller doc_id's windows cover."""
    if window < ANCHOR_WORDS:
        raise ValueError(f"a window has {ANCHOR_WORDS} words at least")
    n, ids = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
    body = F.encode(text_or_empty(text), "UTF-8")
    th = F.xxhash64(body) if n > ids else F.lit(0).cast("long")  # a text's hash is only needed to tell rows of one id apart
    rid = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))

    rows = docs.select(rid.alias("rid"), th.alias("th"), body.alias("body"))
    asked = rows.mapInArrow(_ask(window, _crowded(rows, n, window)), _SENT)
    found = asked.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_answer(window), "rid long, th long, pos int, n int")
    spans = found.groupBy(F.col("rid").alias("_rid"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), rid.alias("_rid"), th.alias("_th"))
    return keyed.join(spans.hint("shuffle_hash"), ["_rid", "_th"], "left").select("row", "spans")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, spans (merged, of word numbers, end exclusive) and kept of every row of docs.

    Removed is each word that lies in a window whose words, in order, also start somewhere in a document with a smaller
    doc_id. kept: the other words joined by one space. Null and empty texts have no words; a null id ranks last, and
    rows with one id are one document, each judged by its own text; other columns are ignored; an empty table gives none.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches):
        for b in slices(batches):
            n_words, n_removed, merged, kept = [], [], [], []
            ids, texts = b.column("row").flatten()
            for body, spans in zip(texts.cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, own = body.split(), _merged(spans)
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in own))
                merged.append([{"start": s, "end": e} for s, e in own])
                kept.append(_without(words, own))
            out = pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), out, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _with_spans(plain, "text", "doc_id", window).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


def cut(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 13, n_chars: str = "n_chars") -> DataFrame:
    """The rows of docs with repeated passages (see remove_repeats) taken out of the text and, where there is such a column, n_chars counted anew. Texts without any stay as they are; of those with some, the other words are joined by one space."""
    place, names = docs.columns.index(text), docs.columns

    def run(batches):
        for b in slices(batches):
            cols = b.column("row").flatten()
            texts = cols[place].to_pylist()
            for k, spans in enumerate(b.column("spans").to_pylist()):
                if spans:
                    texts[k] = _without(texts[k].encode().split(), _merged(spans)).decode()
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    done = _with_spans(docs, text, doc_id, window).mapInArrow(run, docs.schema)
    return done.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else done
