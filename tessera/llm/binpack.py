"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens at once.

Each task packs its own partition, parcel by parcel, without a shuffle. One bin is open at a time. It takes, again and again,
the piece that fits with the largest dot product of its demand and the bin's remaining room, the limits weighted by what
the parcel demands of them. Where pieces may be cut and none fits, or one segment is left, the largest piece gives what fills
the bin. A bin that still is not full is cut at powers of two, which need no padding, where that saves more than it costs.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_or_empty

#: Tokens, at most, that a task holds to be packed together, about, and pieces.
PARCEL_TOKENS, PARCEL_PIECES = 1 << 22, 20_000
#: Tokens that one more sequence counts as, where a bin could be cut at powers of two.
OVERHEAD = 16
#: Different words whose ids a task remembers before it starts anew; speed only.
MEMO = 2_000_000


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class _Pool:
    """Pieces by their tokens and loss-bearing tokens, in the order of these; equal ones wait in a stack."""

    def __init__(self, tokens: Sequence[int], loss: Sequence[int]):
        self.stacks: dict[tuple[int, int], list[int]] = {}
        for k in range(len(tokens) - 1, -1, -1):
            self.stacks.setdefault((tokens[k], loss[k]), []).append(k)
        keys = np.array(sorted(self.stacks), np.int64).reshape(-1, 2)
        self.t, self.l = keys[:, 0], keys[:, 1]

    def __bool__(self) -> bool:
        return len(self.t) > 0

    def take(self, at: int) -> int:
        key = (int(self.t[at]), int(self.l[at]))
        stack = self.stacks[key]
        piece = stack.pop()
        if not stack:
            del self.stacks[key]
            self.t, self.l = np.delete(self.t, at), np.delete(self.l, at)
        return piece

    def put(self, tokens: int, loss: int, piece: int) -> None:
        stack = self.stacks.setdefault((tokens, loss), [])
        stack.append(piece)
        if len(stack) == 1:
            at = int(np.searchsorted(self.t, tokens))
            while at < len(self.t) and self.t[at] == tokens and self.l[at] < loss:
                at += 1
            self.t, self.l = np.insert(self.t, at, tokens), np.insert(self.l, at, loss)


def fill(examples: Sequence[np.ndarray], pieces: list[tuple[int, int, int]], limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """The bins of pieces (example, start, end), each a list of pieces in their order; examples: cumulative loss-bearing tokens, from 0. A piece must fit an empty bin."""
    pieces = list(pieces)
    loss_of = lambda k: int(examples[pieces[k][0]][pieces[k][2]] - examples[pieces[k][0]][pieces[k][1]])
    pool = _Pool([e - s for _, s, e in pieces], [loss_of(k) for k in range(len(pieces))])
    demand = [sum(e - s for _, s, e in pieces) / limits.tokens, sum(map(loss_of, range(len(pieces)))) / limits.loss]  # one segment a piece: the same for all
    weight = [demand[0] / limits.tokens**2, demand[1] / limits.loss**2]
    bins = []
    while pool:
        own, tokens, segments, loss = [], limits.tokens, limits.segments, limits.loss
        while pool and tokens and segments:
            end = int(np.searchsorted(pool.t, tokens, side="right"))
            fits = pool.l[:end] <= loss
            whole = int(np.where(fits, weight[0] * tokens * pool.t[:end] + weight[1] * loss * pool.l[:end], -1.0)[::-1].argmax()) if fits.any() else -1
            whole = end - 1 - whole if whole >= 0 else -1  # the larger piece on ties
            largest = len(pool.t) - 1
            if whole >= 0 and not (cut and segments == 1 and pool.t[largest] > tokens):
                k = pool.take(whole)
                example, start, stop = pieces[k]
            elif cut:
                example, start, stop = pieces[k := pool.take(largest)]
                seen = examples[example]
                stop_at = min(start + tokens, int(np.searchsorted(seen, seen[start] + loss, side="right")) - 1, stop)
                if stop_at <= start:  # not one more token's loss fits
                    pool.put(stop - start, loss_of(k), k)
                    break
                if stop_at < stop:
                    pieces.append((example, stop_at, stop))
                    pool.put(stop - stop_at, loss_of(len(pieces) - 1), len(pieces) - 1)
                stop = stop_at
            else:
                break
            own.append((example, start, stop))
            tokens -= stop - start
            segments -= 1
            loss -= int(examples[example][stop] - examples[example][start])
        bins += shortened(own, limits.tokens) if cut and tokens else [own]
    return bins


def shortened(own: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """The bin itself, or its contents in bins of powers of two if that saves more tokens than the further bins count for."""
    used = sum(e - s for _, s, e in own)
    powers = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    if most - used <= OVERHEAD * (len(powers) - 1):
        return [own]
    out, rest = [], list(own)[::-1]
    for size in powers:
        now = []
        while size:
            example, start, end = rest.pop()
            stop = min(end, start + size)
            now.append((example, start, stop))
            size -= stop - start
            if stop < end:
                rest.append((example, stop, end))
        out.append(now)
    return out


def first_pieces(seen: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """(start, end) of an example's longest pieces, from its start on, that fit an empty bin."""
    out, at, n = [], 0, len(seen) - 1
    while at < n:
        end = min(at + limits.tokens, int(np.searchsorted(seen, seen[at] + limits.loss, side="right")) - 1, n)
        out.append((at, end))
        at = end
    return out


def pack_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False, example_id: str = "id", ids: str = "ids", mask: str | None = None, parcel_tokens: int = PARCEL_TOKENS) -> DataFrame:  # noqa: B008  frozen
    """id, start, length, loss, tokens, ids_crc32, sequence_id, offset and segment: where each piece of each example goes.

    ids: a column of token ids, packed as little-endian unsigned 32-bit integers; mask: a column with a byte for each id,
    zero where it bears no loss; without one, and where it is null, all ids bear loss. Examples that no sequence could hold
    are cut into the longest pieces that fit; other examples stay whole unless cut is set. Pieces of a sequence follow each
    other from offset 0 without gaps. sequence_id is unique, not gapless: it holds the partition's number.

    Examples without ids (null or empty) need no place and are left out; null ids and repeated rows are packed like others;
    a mask shorter than its ids bears loss beyond its end; other columns are ignored; an empty table gives none. Pieces of
    equal size go in the order of their rows.
    """
    rows = examples.select(F.col(example_id).alias("id"), F.col(ids).alias("ids"), (F.col(mask) if mask else F.lit(None)).cast("binary").alias("mask"))
    return rows.mapInArrow(_packing(limits, cut, parcel_tokens), _placed(examples.schema[example_id]))


def pack_texts(docs: DataFrame, path: str, limits: Limits = Limits(), cut: bool = False, end: int | None = 1, text: str = "text", doc_id: str = "doc_id", parcel_tokens: int = PARCEL_TOKENS) -> DataFrame:  # noqa: B008  frozen
    """pack_examples() of the rows of tokenized(), all ids bearing loss, with both in one process of a task."""
    encode, pack = _encoding(path, end, "id"), _packing(limits, cut, parcel_tokens)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lambda batches: pack(encode(batches)), _placed(docs.schema[doc_id]))


def _placed(example_id: T.StructField) -> str:
    return f"id {example_id.dataType.simpleString()}, start long, length long, loss long, tokens long, ids_crc32 long, sequence_id long, offset long, segment long"


def _packing(limits: Limits, cut: bool, parcel_tokens: int):
    """The work of a task on batches of examples."""
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("each limit must be 1 at least")

    def run(batches):
        bins_before = TaskContext.get().partitionId() << 33
        names, raws, seen, pieces, held = [], [], [], [], 0

        def flush():
            nonlocal bins_before, held
            out = []
            for b, own in enumerate(fill(seen, pieces, limits, cut)):
                offset = 0
                for k, (example, start, stop) in enumerate(own):
                    out.append((example, start, stop - start, int(seen[example][stop] - seen[example][start]), len(raws[example]) // 4, zlib.crc32(raws[example][4 * start : 4 * stop]), bins_before + b, offset, k))
                    offset += stop - start
            bins_before += len({x[6] for x in out})
            columns = list(zip(*out, strict=True)) or [[] for _ in range(9)]
            kind = names[0].type if names else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([names[e].as_py() for e in columns[0]], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "loss", "tokens", "ids_crc32", "sequence_id", "offset", "segment"])
            names.clear(), raws.clear(), seen.clear(), pieces.clear()
            held = 0

        for b in batches:
            for part in slices([b]):
                masks = part.column("mask").to_pylist() if "mask" in part.schema.names else repeat(None, part.num_rows)
                for name, raw, m in zip(part.column("id"), part.column("ids").to_pylist(), masks, strict=True):
                    if not raw:
                        continue
                    n = len(raw) // 4
                    before = np.arange(n + 1, dtype=np.int32)  # ids that bear loss before each
                    if m is not None:
                        given = np.frombuffer(m, np.uint8)[:n]
                        before[1:] -= np.cumsum(np.concatenate([given == 0, np.zeros(n - len(given), bool)]), dtype=np.int32)
                    names.append(name)
                    raws.append(raw)
                    seen.append(before)
                    pieces.extend((len(names) - 1, s, e) for s, e in first_pieces(seen[-1], limits))
                    held += n
                    if held > parcel_tokens or len(pieces) > PARCEL_PIECES:
                        yield from flush()
        if names:
            yield from flush()

    return run


class WordIds:
    """Ids of texts by a tokenizer of the tokenizers library that works word by word: blanks part words and take no ids, and the last id of a run of letters tells that it ends.

    Words are numbered as they come; the ids of new ones are learnt together. A word of Latin letters and marks behind them has the ids of both parts.
    """

    _LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    #: Of lines with one word each: letters and marks of a plain word, or any other word.
    _PLAIN = re.compile(f"(?m)^([{_LATIN}]+)([!-&(-/:-@[-`{{-~]*)$|^(.+)$")
    _NO_BLANKS = re.compile("[\x1c-\x1f]")  # str.split() takes them for blanks
    _WORDS = re.compile(r"[^ \t\n\r]+")

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.of, self.memo = Tokenizer.from_file(path), memo
        self.of.encode_special_tokens = True  # their strings in a text are ordinary text
        entries = self.of.get_vocab()
        self.ends = np.zeros(max(entries.values(), default=0) + 1, bool)
        self.ends[[k for t, k in entries.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.parts: dict[str, bytes] = {}
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn_parts(self, letters: list[str], others: list[str]) -> None:
        """Ids of runs of letters, learnt together, and of other parts."""
        if letters:
            ids = np.array(self.of.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), (4 * ends).tolist()
                self.parts |= zip(letters, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True)
            else:
                others = letters + others
        if others:
            self.parts |= ((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, self.of.encode_batch_fast(others, add_special_tokens=False), strict=True))

    def _learn(self, new: list[str]) -> None:
        letters, marks, odd = zip(*self._PLAIN.findall("\n".join(new)), strict=True)
        letters = "\n".join(letters).lower().split("\n")
        known = self.parts
        self._learn_parts(list({x for x in letters if x and x not in known}), list({x for x in (*marks, *odd) if x and x not in known}))
        known[""] = b""
        found = [known[a] + known[b] + known[c] for a, b, c in zip(letters, marks, odd, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.memo:
            self._forget()
        words = [self._WORDS.findall(t) if self._NO_BLANKS.search(t) else t.split() for t in texts]
        known = len(self.codes)
        codes = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(self.codes.__getitem__, w), np.int64, len(w)) for w in words)])
        if len(self.codes) > known:
            self._learn(list(islice(self.codes, known, None)))
        size = self.size[codes]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.append(0, ends)[np.cumsum([len(w) for w in words])[:-1]])


@cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def tokenized(docs: DataFrame, path: str, end: int | None = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (packed little-endian uint32) of each whole text by the tokenizer file at path, without special tokens, then the id end if it is given.

    Null and empty texts have no other ids; strings of special tokens in a text are ordinary text; null ids and repeated
    rows pass through; other columns are ignored; an empty table gives none. The tokenizer must part words at blanks and
    give these no ids.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_encoding(path, end, "doc_id"), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary")


def _encoding(path: str, end: int | None, key: str):
    """The work of a task on batches of texts."""
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        ids_of = word_ids(path)
        for b in batches:
            for part in slices([b], 200):
                ids = [x.tobytes() + last for x in ids_of(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    return run
