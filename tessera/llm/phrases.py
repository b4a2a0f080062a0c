"""Phrase collocations by counting in slots of minimal perfect hashes.

Texts become rows of word codes once, with a dictionary for each row. A phrase of n words is named by the slot of its first
n - 1 words and the slot of its last word, an exact 64-bit key. Level by level, only phrases whose first and last n - 1 words
are both frequent can be frequent (Apriori). Mappers count two hashes of those keys in arrays that are summed in a tree; a key is
a candidate if both sums reach the least count, and what mappers hold of it as well, so no frequent phrase is lost. A minimal perfect hash gives each candidate a slot; the key stored
there must be equal. Mappers bincount the slots of their share of the corpus, the arrays are summed in a tree, and the
frequencies of a phrase's parts are read from the slots that its key names.

Candidates beyond PART_KEYS take several hash tables, each one pass over the codes, so a table that travels is bounded.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, drop_stash, slices, stash, text_or_empty

#: Candidates of one hash table, about; positions of a row of codes, about; slots that are summed together; arrays that one task sums.
PART_KEYS, ROW_WORDS, SLICE, FAN = 1 << 22, 1 << 16, 1 << 16, 8
#: Different words, and keys, of which a task holds counts, about.
MOST_WORDS, MOST_KEYS = 1 << 18, 1 << 20
#: Counters of one of the two hashes: an eighth of the positions or more, within these bounds. With fewer more keys are sent to be summed, but never fewer.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 24
#: Rows of codes that Parquet's reader takes at once, and MB of a row group of them: a task holds these, however many rows its files have.
READ_ROWS, GROUP_MB = 64, 16
#: Bytes of a text that are split at once.
STRETCH = 4 << 20
#: Stands for the end of a piece; no byte of UTF-8.
_BREAK = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_M64 = (1 << 64) - 1


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & _M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """n different 64-bit keys to the slots 0 to n - 1: on each floor, keys that have a place of twice as many alone stay, the others go up; a slot is the rank of the place."""

    def __init__(self, keys: np.ndarray):
        self.n, self.floors, below = len(keys), [], 0
        rest = keys
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            place = (_mixed(rest, len(self.floors)) % np.uint64(size)).astype(np.int64)
            times = np.bincount(place, minlength=size)
            bits = np.packbits(times == 1, bitorder="little").view("<u8")
            ranks = below + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.floors.append((size, bits, ranks))
            below = int(ranks[-1])
            rest = rest[times[place] > 1]
        self.stored = np.zeros(self.n, np.uint64)
        self.stored[self.slots(keys)] = keys

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The only slot that each key can have, -1 where no floor has a place for it."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (size, bits, ranks) in enumerate(self.floors):
            place = (_mixed(keys[todo], k) % np.uint64(size)).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            there = (bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[there], bit[there]
            out[todo[there]] = ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            todo = todo[~there]
            if not len(todo):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that is stored, -1 for others."""
        slot = self.slots(keys)
        if not self.n:
            return slot
        return np.where((slot >= 0) & (self.stored[slot] == keys), slot, -1)


class _Codes(defaultdict):
    """Numbers for words in the order of their first use; 0 ends a piece."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        self[_BREAK]  # noqa: B018  takes the number 0


def _stretches(text: bytes):
    """The text in stretches that end where a word does."""
    at = 0
    while len(text) - at > STRETCH:
        end = max(text.rfind(c, at, at + STRETCH) for c in (b" ", b"\t", _BREAK))
        end = at + STRETCH if end <= at else end
        if end == at + STRETCH:  # one word of that length
            ends = [e for c in (b" ", b"\t", _BREAK) if (e := text.find(c, end)) >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def encoded(docs: DataFrame, text: str, lang: str, row_words: int) -> DataFrame:
    """Rows (lang, words, codes): the words of whole texts as numbers of the row's own words; 0 ends a piece, and a text."""

    def run(batches):
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        total = 0

        def flush():
            for name, (codes, parts) in held.items():
                words = [w.decode() for w in list(codes)[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words], pa.list_(pa.string())), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["lang", "words", "codes"])
            held.clear()

        for b in batches:
            for part in slices([b]):
                for name, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not t:
                        continue
                    codes, parts = held.setdefault(name, (_Codes(), []))
                    for stretch in _stretches(t.encode().lower().translate(_ENDS)):
                        words = stretch.replace(_BREAK, b" \xff ").split()
                        parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                        total += len(words)
                    parts.append(np.zeros(1, np.int32))
                    if total > row_words:
                        yield from flush()
                        total = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "lang string, words array<string>, codes binary")


def _ints(b: pa.RecordBatch, column: str, kind: str = "<i4"):
    """The arrays of a binary column, one at a time and not copied."""
    return (np.frombuffer(x.as_buffer(), kind) for x in b.column(column))


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word and f of all words. A task adds up what its rows have in common before it sends it."""

    def run(batches):
        held, n = [], 0

        def summed():
            t = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("f", "sum")]).rename_columns(["lang", "word", "f"])
            held.clear()
            return t

        for b in batches:
            for name, words, codes in zip(b.column("lang").to_pylist(), b.column("words"), _ints(b, "codes"), strict=True):
                f = np.bincount(codes, minlength=len(words.values) + 1)[1:]
                held.append(pa.table({"lang": pa.array([name] * len(f), pa.string()), "word": words.values, "f": f}))
                n += len(f)
                if n > MOST_WORDS:
                    t = summed()
                    if (n := len(t)) > MOST_WORDS // 2:
                        yield from t.to_batches()
                        n = 0
                    else:
                        held.append(t)
        if held:
            yield from summed().to_batches()

    return rows.select("lang", "words", "codes").mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class _Words:
    """Slots of a table of words. Goes to the tasks as a broadcast of PART_KEYS words at most, about."""

    def __init__(self, langs: list[str], words: list[str], first: int):
        self.first, self.seed = first, 0
        keys = [(a.encode(), w.encode()) for a, w in zip(langs, words, strict=True)]
        while True:
            h = np.fromiter((xxhash.xxh64_intdigest(a + b"\0" + w, self.seed) for a, w in keys), np.uint64, len(keys))
            if len(np.unique(h)) == len(h):
                break
            self.seed += 1  # two words share a hash
        self.hash = PerfectHash(h)
        self.slot = self.hash.slots(h)
        self.stored = [b""] * len(keys)
        for s, (a, w) in zip(self.slot.tolist(), keys, strict=True):
            self.stored[s] = a + b"\0" + w

    def find(self, lang: str, words: list[str]) -> np.ndarray:
        own = [lang.encode() + b"\0" + w.encode() for w in words]
        h = np.fromiter((xxhash.xxh64_intdigest(x, self.seed) for x in own), np.uint64, len(own))
        slot = self.hash.find(h)
        return np.array([self.first + s if s >= 0 and self.stored[s] == x else -1 for s, x in zip(slot.tolist(), own, strict=True)], np.int64)


def _parts(rows: DataFrame, by: list[str], part_keys: int) -> list[DataFrame]:
    """The rows in parts of about part_keys, by hash."""
    parts = max(1, -(-rows.count() // part_keys))
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) for k in range(parts)]


def _with_words(rows: DataFrame, shared, last: bool) -> DataFrame:
    """Adds to known, for each code of a row, the slots of the words that a table holds; with the last table w, the slots of a row's words, -1 (once) for all that stands between frequent ones."""

    def run(batches):
        for b in batches:
            for k, (name, words, codes, known) in enumerate(zip(b.column("lang").to_pylist(), b.column("words"), _ints(b, "codes"), _ints(b, "known"), strict=True)):
                new = np.concatenate([[-1], shared.value.find(name, words.as_py())]).astype(np.int32)
                new = np.maximum(new, known) if len(known) else new
                if last:
                    w = new[codes]
                    yield pa.RecordBatch.from_arrays([pa.array([w[(w >= 0) | np.append(True, w[:-1] >= 0)].tobytes()], pa.binary())], ["w"])
                else:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in ("lang", "words", "codes")), pa.array([new.tobytes()], pa.binary())], ["lang", "words", "codes", "known"])

    return rows.mapInArrow(run, "w binary" if last else "lang string, words array<string>, codes binary, known binary")


def _pairs(b: pa.RecordBatch):
    """Of each row the slots of phrases by where they start, and the word behind each. Rows of words have no second column."""
    for k, at in enumerate(_ints(b, "at")):
        yield at, np.frombuffer(b.column("next")[k].as_buffer(), "<i4") if "next" in b.schema.names else np.append(at[1:], np.int32(-1))


def _keys(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of one word more stand, of which the first and the last words have slots, and their keys."""
    where = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (after[:-1] >= 0))
    return where, at[where].astype(np.uint64) << np.uint64(32) | after[where].astype(np.uint64)


def _buckets(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [(_mixed(keys, 101 + row) % np.uint64(size)).astype(np.int64) + row * size for row in (0, 1)]


def _sliced(counts: np.ndarray):
    """One row for each slice of a mapper's array that counted anything."""
    part = TaskContext.get().partitionId()
    for at in range(0, len(counts), SLICE):
        x = counts[at : at + SLICE]
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // SLICE], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "part", "counts"])


_SLICED = "slice int, part int, counts binary"


def _tree_sum(rows: DataFrame, parts: int, kind: str, read, schema: str) -> DataFrame:
    """read(slice, total), rows of the schema, of the sums of the mappers' arrays, slice by slice, in steps of FAN arrays. Sums of a byte stop at the largest number. The last step reads its sums itself, in the same process."""
    most = np.iinfo(kind).max

    def total(t: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(t["counts"].iloc[0]) // np.dtype(kind).itemsize, np.int64)
        for x in t["counts"]:
            out += np.frombuffer(x, kind)
        return np.minimum(out, most)

    def add(t: pd.DataFrame) -> pd.DataFrame:
        return t.iloc[:1].assign(counts=[total(t).astype(kind).tobytes()])

    def finish(t: pd.DataFrame) -> pd.DataFrame:
        return read(int(t["slice"].iloc[0]), total(t))

    while parts > FAN:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("slice", "part").applyInPandas(add, _SLICED)
    return rows.groupBy("slice").applyInPandas(finish, schema)


def _likely(rows: DataFrame, size: int, least: int, mappers: int):
    """A broadcast of one bit for each counter of the two hashes: whether it reaches the least count."""

    def run(batches):
        counts = np.zeros(2 * size, np.uint8)  # no more than whether the least count is reached is asked
        for b in batches:
            for at, after in _pairs(b):
                for bucket in _buckets(_keys(at, after)[1], size):
                    own, n = np.unique(bucket, return_counts=True)
                    counts[own] = np.minimum(counts[own] + n, 255)
        yield from _sliced(counts)

    def bits(k: int, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"slice": [k], "full": [np.packbits(counts >= min(least, 255)).tobytes()]})

    summed = _tree_sum(rows.coalesce(mappers).mapInArrow(run, _SLICED), mappers, "u1", bits, "slice int, full binary")
    out = np.zeros(2 * size, bool)
    for r in summed.toArrow().to_pylist():  # 2 * size bits
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.unpackbits(np.frombuffer(r["full"], np.uint8)).astype(bool)
    return rows.sparkSession.sparkContext.broadcast(out)


def _candidates(rows: DataFrame, size: int, likely, least: int, mappers: int) -> DataFrame:
    """The different keys whose counters both reach the least count, as far as the tasks' own counts of them do so together: of a key that is frequent none is left out, of others that share its counters none stays."""

    def told(held):
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        own, at = np.unique(keys, return_inverse=True)
        return own, np.bincount(at, n, len(own)).astype(np.int64)

    def run(batches):
        held, total = [], 0
        for b in batches:
            for at, after in _pairs(b):
                keys, n = np.unique(_keys(at, after)[1], return_counts=True)
                one, two = _buckets(keys, size)
                fits = likely.value[one] & likely.value[two]
                held.append((keys[fits], n[fits]))
                total += len(held[-1][0])
                if total > MOST_KEYS:
                    own, n = told(held)
                    held, total = [(own, n)], len(own)
                    if total > MOST_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["key", "n"])
                        held, total = [], 0
        if total:
            own, n = told(held)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.coalesce(mappers).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _frequent(rows: DataFrame, shared, least: int, mappers: int) -> DataFrame:
    """(key, f) of the keys of a table that reach the least count: slots counted by mappers, summed in a tree."""

    def count(batches):
        n = shared.value.n
        counts = np.zeros(n, np.int64)
        for b in batches:
            for at, after in _pairs(b):
                slot, times = np.unique(shared.value.find(_keys(at, after)[1]), return_counts=True)  # a row's share of the slots, not all of them
                counts[slot[slot >= 0]] += times[slot >= 0]
        yield from _sliced(counts)

    def read(k: int, f: np.ndarray) -> pd.DataFrame:
        own = np.flatnonzero(f >= least)
        return pd.DataFrame({"key": shared.value.stored[k * SLICE + own].view(np.int64), "f": f[own]})

    return _tree_sum(rows.coalesce(mappers).mapInArrow(count, _SLICED), mappers, "<i8", read, "key long, f long")


def _annotated(rows: DataFrame, shared, first: int, last: bool) -> DataFrame:
    """Rows(at, next, now) with the slots of phrases of one word more in now; with the last table (at, next) of these, where they stand next to each other, -1 (once) for all between."""

    def run(batches):
        for b in batches:
            for k, (at, after) in enumerate(_pairs(b)):
                now = np.frombuffer(b.column("now")[k].as_buffer(), "<i4")
                now = now.copy() if len(now) else np.full(len(at), -1, np.int32)
                where, keys = _keys(at, after)
                slot = shared.value.find(keys)
                now[where[slot >= 0]] = first + slot[slot >= 0]
                if last:
                    kept = (now >= 0) | np.append(False, now[:-1] >= 0) if len(now) else np.zeros(0, bool)
                    columns = [now[kept], np.append(after[1:], np.int32(-1))[kept] if len(after) else after]
                else:
                    columns = [at, after, now]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["at", "next", "now"][: len(columns)])

    return rows.mapInArrow(run, "at binary, next binary" + ("" if last else ", now binary"))


def _with_slots(rows: DataFrame, shared, first: int) -> DataFrame:
    """(idx, key, f) of the keys of a table."""

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first + shared.value.find(key.view(np.uint64))), b.column("key"), b.column("f")], ["idx", "key", "f"])

    return rows.mapInArrow(run, "idx long, key long, f long")


def _numbered(words: DataFrame, shared) -> DataFrame:
    """(idx, key, f, lang, word) of the words of a table."""

    def run(batches):
        for b in batches:
            langs, own = np.array(b.column("lang").to_pylist(), object), b.column("word").to_pylist()
            idx = np.zeros(len(own), np.int64)
            for name in set(langs):
                at = np.flatnonzero(langs == name)
                idx[at] = shared.value.find(name, [own[k] for k in at])
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(idx), b.column("f"), b.column("lang"), b.column("word")], ["idx", "key", "f", "lang", "word"])

    return words.mapInArrow(run, "idx long, key long, f long, lang string, word string")


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang", part_keys: int = PART_KEYS, row_words: int = ROW_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """One table for each number of words, (idx, key, f, and for words lang and word), and (lang, n) with the count of all words."""
    spark = docs.sparkSession
    mappers = 2 * max(2, spark.sparkContext.defaultParallelism)
    rows = stash(encoded(docs, text, lang, row_words), "phrase-codes", GROUP_MB)
    words = stash(_word_counts(rows), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))

    first, known, level, spent = 0, rows.withColumn("known", F.lit(b"")), [], [rows]
    parts = _parts(words.where(F.col("f") >= least), ["lang", "word"], part_keys)
    for k, part in enumerate(parts):
        held = part.select("lang", "word").toArrow()
        table = _Words(held.column("lang").to_pylist(), held.column("word").to_pylist(), first)
        shared = spark.sparkContext.broadcast(table)
        level.append(_numbered(part, shared))
        last = k == len(parts) - 1
        known = stash(_with_words(known, shared, last), "phrase-at-1" if last else "phrase-known", GROUP_MB)
        spent.append(known)
        first += len(table.stored)
    levels = [stash(reduce(DataFrame.union, level), "phrase-level-1")]
    drop_stash(*spent[:-1])
    spent, now = spent[-1:], known.withColumnRenamed("w", "at")

    positions = int(now.agg(F.sum(F.length("at"))).first()[0] or 0) // 4
    size = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, positions // 8 - 1).bit_length()))
    for n in range(2, longest + 1):
        likely = _likely(now, size, least, mappers)
        candidates = stash(_candidates(now, size, likely, least, mappers), f"phrase-candidates-{n}")
        likely.unpersist()
        counted = []
        for part in _parts(candidates, ["key"], part_keys):
            shared = spark.sparkContext.broadcast(PerfectHash(part.toArrow().column("key").to_numpy().view(np.uint64)))
            counted.append(stash(_frequent(now, shared, least, mappers), f"phrase-frequent-{n}"))
            shared.unpersist()
        often = reduce(DataFrame.union, counted)
        first, level, marked = 0, [], now.withColumn("now", F.lit(b""))
        parts = _parts(often, ["key"], part_keys)
        for k, part in enumerate(parts):
            table = PerfectHash(part.select("key").toArrow().column("key").to_numpy().view(np.uint64))
            shared = spark.sparkContext.broadcast(table)
            level.append(_with_slots(part, shared, first))
            if n < longest:
                last = k == len(parts) - 1
                marked = stash(_annotated(marked, shared, first, last), f"phrase-at-{n}" if last else f"phrase-marked-{n}", GROUP_MB)
                spent.append(marked)
            first += table.n
        levels.append(stash(reduce(DataFrame.union, level), f"phrase-level-{n}"))
        drop_stash(candidates, *counted)
        if n < longest:
            drop_stash(*spent[:-1])
            spent, now = spent[-1:], marked
    drop_stash(*spent)
    return levels, totals


def _whole(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level with its phrases' texts, the slots of the first and the last n - 1 words, and the frequencies of all first (pf) and last parts (sf) by their length."""
    words = levels[0].select("lang", "idx", "key", "f", F.col("word").alias("phrase"), "word", F.col("idx").alias("prefix"), F.col("idx").alias("suffix"), F.expr("cast(array() as array<bigint>)").alias("pf"), F.expr("cast(array() as array<bigint>)").alias("sf"))
    out = [words]
    for n, level in enumerate(levels[1:], 2):
        before = out[-1]
        p = before.select(F.col("idx").alias("prefix"), F.col("phrase").alias("p_phrase"), F.col("suffix").alias("p_suffix"), F.array_append("pf", F.col("f")).alias("pf"), "lang")
        s = before.select(F.col("key").alias("s_key"), F.col("idx").alias("suffix"), "word", F.array_append("sf", F.col("f")).alias("sf"))
        named = level.select("idx", "key", "f", F.expr("shiftrightunsigned(key, 32)").alias("prefix"), F.expr("key & 4294967295L").alias("last")).join(p, "prefix")
        named = named.withColumn("s_key", F.col("last") if n == 2 else F.expr("shiftleft(p_suffix, 32) | last")).join(s, "s_key")
        out.append(stash(named.select("lang", "idx", "key", "f", F.concat_ws(" ", "p_phrase", "word").alias("phrase"), "word", "prefix", "suffix", "pf", "sf"), f"phrase-whole-{n}"))
    return out


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, within: int = 80, top: int = 2000, scale: int = 2_000_000, text: str = "text", lang: str = "lang", part_keys: int = PART_KEYS, row_words: int = ROW_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of 2 to longest words.

    A-Z count as a-z. Texts are cut at . , ; : ! ? and line ends into pieces, these at blanks and tabs into words. A
    phrase that occurs least times or more is a candidate; its cut is the one with the lowest floor(scale * a / (l + r)),
    a, l and r the frequencies of the whole and both parts, ties to the shorter first part. Candidates that lie in a
    longer candidate with within percent of their frequency or more are left out. n counts all words of the language.
    The first top phrases by score, then a, both descending, then phrase in the order of its bytes, are returned.

    A null text has no words, a null lang is und (one with texts of that name); repeated rows count as often as they come;
    other columns are ignored; an empty table gives none. A language without candidates has no row.
    """
    with arrow_batches(docs.sparkSession, read=READ_ROWS):
        levels, totals = frequent_phrases(docs, longest, least, text, lang, part_keys, row_words)
    whole = _whole(levels)
    ranked = None
    for n, own in enumerate(whole[1:], 2):
        own = own.select("lang", "idx", "phrase", F.col("f").alias("a"), "pf", "sf")
        if n < longest:
            longer = whole[n].select(F.explode(F.array("prefix", "suffix")).alias("idx"), "f").groupBy("idx").agg(F.max("f").alias("longer"))
            own = own.join(longer, "idx", "left").where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {within}")
        cuts = f"transform(sequence(1, {n - 1}), k -> struct(cast(a as decimal(19,0)) * {scale} div (cast(pf[k - 1] as decimal(19,0)) + sf[{n - 1} - k]) as score, k as k, pf[k - 1] as l, sf[{n - 1} - k] as r))"
        own = own.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        ranked = own if ranked is None else ranked.union(own)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
