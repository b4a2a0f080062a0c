"""SimHash near-duplicates by the similarity of their word shingles, with deletion-variant signatures.

A similarity of 0.8 leaves about 15 of 100 bits of a fingerprint different, more than the few segments of 64 bits allow.
So the fingerprint is longer, its segments are many, and one agreement suffices: a segment that differs by at most one bit.
Each bit comes with a margin, and bits that differ between similar texts are those of small margin in both; so only the
STRUCK bits of the least margin are struck out in turn, and each such variant is a key. Texts that meet under a key and
whose 64 further bits are close are candidates, and the shingles themselves decide.

By the bits' chances a pair of similarity 0.8 meets under a segment with about 0.14 and under any of them with above 0.98.
Measured on 600 texts of one template, 248 of 249 pairs at 0.8 or more met.
Candidates are verified in two rounds. In the first each text of a key meets one other, the
closest leader before it, where a text within ABSORB_BITS of a leader leads no further, and of those that many keys name the
FIRST ones; so a group of near copies takes pairs in proportion to its texts. The second takes what else the keys hold of texts that the verified links of the first have not
joined, so the groups are those that all candidates give, whatever the first leaves out. There the texts of a large loose
cluster stand in blocks of bounded size; a text asks each block that holds a candidate of it once and is compared with the
whole block in one task, so no pairs travel. A key that many texts of a sample share is dealt in parts by hash: texts of one
part meet in the first round, those of different parts in the second.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LAST_ID, drop_stash, slices, stash, text_or_empty
from .components import components
from .substring import _rolling, _WordHash

#: Buckets of the shingles' sketch, segments of the fingerprint, bits of each, bits struck out of each, further bits.
SKETCH, SEGMENTS, WIDTH, STRUCK, CHECK = 2048, 28, 20, 6, 64
#: Differing further bits that a candidate may have (similarity 0.8: 9.7 on average, deviation 2.9), those of a text that doesn't lead in the first round, and leaders of a text that the first round looks at where the second sees the rest.
LINK_BITS, ABSORB_BITS, FIRST = 20, 4, 8
#: Documents whose repeats are left out together before their keys travel.
TOGETHER = 2000
#: Texts, about, whose keys are counted, and texts there that make a key heavy and are one part of it; so no part has many more than HEAVY / SAMPLE of all texts, and no more than SEGMENTS * STRUCK * SAMPLE / HEAVY keys are heavy.
SAMPLE, HEAVY = 4096, 16
#: Steps over links that the second round looks ahead, similarity of the links that make loose clusters, texts from which on a cluster stands in blocks, and texts, bytes of shingles and askers of a block, about.
SPREAD, LOOSE, CLUSTER, BLOCK_TEXTS, BLOCK_BYTES, ASKERS = 3, 0.5, 50, 1000, 16 << 20, 500
#: Columns of a block's texts and of those who ask it.
ASKED = ("place", "part", "th", "root", "s")
#: Leaders of a part of a heavy key. The texts of heavy keys meet in blocks anyway, so a few suffice to tell which belong together.
LEADERS = 8
#: Above the bits of a key: the part of a heavy one, from 1 on. Keys with the bit CLASS list classes, negative ones a text's class.
PART, CLASS = 32, 60


def shingles(text: str, n: int, words_of: _WordHash) -> np.ndarray:
    """Hashes of the distinct n-word shingles, ascending; A-Z count as a-z; of fewer words the whole sequence is one."""
    words = text.encode().lower().split()
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    return np.unique(_rolling(h, n, 11) if len(h) >= n else _rolling(h, len(h), 13)[:1])


@cache
def _planes() -> np.ndarray:
    return np.random.default_rng(29).standard_normal((SKETCH, SEGMENTS * WIDTH + CHECK), np.float32)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a row for each set, SEGMENTS * STRUCK long) and further bits of sets of shingles."""
    x = np.zeros((len(sets), SKETCH), np.float32)
    for i, s in enumerate(sets):
        x[i] = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), 1.0 - 2.0 * (s >> np.uint64(63)), SKETCH)
    y = x @ _planes()
    check = np.packbits(y[:, SEGMENTS * WIDTH :] > 0, axis=1).view(np.int64).ravel()
    y = y[:, : SEGMENTS * WIDTH].reshape(len(sets), SEGMENTS, WIDTH)
    value = ((y > 0) * (1 << np.arange(WIDTH))).sum(2)
    place = np.argpartition(np.abs(y), STRUCK, axis=2)[:, :, :STRUCK]
    keys = ((np.arange(SEGMENTS)[:, None] * WIDTH + place) << WIDTH) | (value[:, :, None] & ~(1 << place))
    return keys.reshape(len(sets), SEGMENTS * STRUCK), check


def runs(batches, columns: tuple[str, ...], same: str, alone: int | None = PART):
    """The runs of rows of one key, whole, as arrays, from batches in order of key; of rows of a run that agree in the column
    `same` one stays. Runs of one row come only where the key has bits from the place `alone` on."""
    held = [np.zeros(0, np.int64) for _ in columns]
    at = columns.index(same)

    def distinct(run):
        first = np.unique(run[at], return_index=True)[1]
        return run if len(first) == len(run[at]) else [c[np.sort(first)] for c in run]

    for x in batches:
        rows = [np.r_[h, x.column(c).to_numpy(zero_copy_only=False)] for h, c in zip(held, columns, strict=True)]
        cut = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        start, end = np.r_[0, cut], np.r_[cut, len(rows[0])]
        wanted = (end - start) > 1
        if alone is not None and len(rows[0]):
            wanted |= rows[0][start] >> alone > 0
        for k in np.flatnonzero(wanted[:-1]).tolist():
            run = distinct([c[start[k] : end[k]] for c in rows])
            if len(run[0]) > 1 or (alone is not None and run[0][0] >> alone):
                yield run
        held = distinct([c[start[-1] :] for c in rows])
    if len(held[0]) > 1 or (alone is not None and len(held[0]) and held[0][0] >> alone):
        yield held


def _nearest(ids: np.ndarray, check: np.ndarray, leaders: int | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """For a key's texts, each with the leader before it that is closest, and whether other pairs of the key may be candidates too. leaders: no more than so many lead."""
    best, whose, more = np.full(len(ids), LINK_BITS + 1), np.zeros(len(ids), np.int64), False
    rest = np.arange(len(ids))
    while len(rest) and leaders != 0:
        leaders = leaders and leaders - 1
        head, rest = rest[0], rest[1:]
        far = np.bitwise_count((check[rest] ^ check[head]).view(np.uint64))
        more |= bool(((far <= LINK_BITS) & (best[rest] <= LINK_BITS)).any())
        closer = far < best[rest]
        whose[rest[closer]], best[rest[closer]] = head, far[closer]
        more |= bool((far <= ABSORB_BITS).any())
        rest = rest[far > ABSORB_BITS]
    own = np.flatnonzero(best <= LINK_BITS)
    return ids[own], ids[whose[own]], more and len(ids) > 2


def _across(ids: np.ndarray, check: np.ndarray, root: np.ndarray, place: np.ndarray, block: np.ndarray):
    """Of a key's texts each with the places of its candidates in other groups, in pieces: a block, or the text itself."""
    _, group, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((root, size[group]))  # the largest, which looks for nothing after it, comes last
    ids, check, root, place, block = (x[order] for x in (ids, check, root, place, block))
    end = np.r_[np.flatnonzero(root[1:] != root[:-1]) + 1, len(root)]
    later = np.repeat(end, np.diff(np.r_[0, end]))
    for k in range(int(end[-2]) if len(end) > 1 else 0):
        near = later[k] + np.flatnonzero(np.bitwise_count((check[later[k] :] ^ check[k]).view(np.uint64)) <= LINK_BITS)
        if len(near):
            near = near[np.unique(place[near], return_index=True)[1]]
            yield np.full(len(near), ids[k]), place[near], block[near]


def pieces(pairs, rows: int = 100_000):
    """Tuples of arrays, put together to about so many rows, each row once."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield np.unique(np.concatenate([np.stack(h) for h in held], axis=1), axis=1)
            held, n = [], 0
    if held:
        yield np.unique(np.concatenate([np.stack(h) for h in held], axis=1), axis=1)


def _batch(columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _variants(shingle: int, heavy: tuple[np.ndarray, np.ndarray] | None = None):
    """Rows (key, a, check) of texts. heavy: the heavy keys, ascending, and how many parts each has; then a heavy key names the
    text's part too, and comes once more with the class of each text that has it. A text's class is its heaviest key (ties: the
    smaller one), said in a row of its own: all texts of a hot group have few classes, whatever number of keys they share."""

    def run(batches):
        words_of = _WordHash()
        for part in slices(batches, TOGETHER):
            first = np.sort(np.unique(part.column("th").to_numpy(), return_index=True)[1])
            for few in slices([part.take(pa.array(first))], 250):
                keys, checks = signatures([shingles(t, shingle, words_of) for t in few.column("text").to_pylist()])
                th, n = few.column("th").to_numpy(), SEGMENTS * STRUCK
                rows = [(keys.ravel(), np.repeat(th, n), np.repeat(checks, n))]
                if heavy is not None and len(heavy[0]):
                    at = np.minimum(np.searchsorted(heavy[0], keys), len(heavy[0]) - 1)
                    known = heavy[0][at] == keys
                    rank = np.lexsort((heavy[0], -heavy[1])).argsort()  # 0: the heaviest
                    best = np.where(known, rank[at], len(rank)).min(axis=1)
                    some = np.flatnonzero(best < len(rank))
                    kind = np.append(heavy[0][rank.argsort()], -1)[best]  # of each text
                    mixed = (th.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    split = np.where(known, (mixed[:, None] % heavy[1][at].astype(np.uint64)).astype(np.int64) + 1, 0)
                    rows[0] = ((keys + (split << PART)).ravel(), *rows[0][1:])
                    row, col = np.nonzero(known)
                    met = np.unique(np.stack([keys[row, col], kind[row]]), axis=1)
                    rows.append((met[0] | 1 << CLASS, met[1], met[1]))
                    rows.append((-1 - mixed[some].astype(np.int64), th[some], kind[some]))
                for x in rows:
                    yield _batch(x, ["key", "a", "check"])

    return run


def _met(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (key, a, b) for the hashes of texts(th, text). Of keys -1 and -4: a pair that meets under some key, for each text of
    a key, or of a part of it, that with its closest leader; -1 where these are all candidates of the key. Of key -2: classes a and b that meet under a heavy key. Of key -3: a
    text a and its class b. Others: the texts a, with check bits b, of the keys that aren't heavy and hold further candidates."""

    def meet(batches):
        said = []

        def ranked():
            for x in batches:
                own = x.column("key").to_numpy() < 0
                if own.any():
                    own = x.filter(pa.array(own))
                    said.append((np.full(own.num_rows, -3), own.column("a").to_numpy(), own.column("check").to_numpy()))
                yield x.filter(pa.array(x.column("key").to_numpy() >= 0))

        def found():
            for key, ids, check in runs(ranked(), ("key", "a", "check"), "a"):
                while said:
                    yield said.pop()
                if key[0] >> CLASS:
                    yield np.full(len(ids) ** 2, -2), np.repeat(ids, len(ids)), np.tile(ids, len(ids))
                    continue
                a, b, more = _nearest(ids, check, LEADERS if key[0] >> PART else None)
                if len(a):
                    yield np.full(len(a), -4 if more or key[0] >> PART else -1), a, b
                if more and not key[0] >> PART:
                    yield key, ids, check
            while said:
                yield said.pop()

        for x in pieces(found()):
            yield _batch(x, ["key", "a", "b"])

    each = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod("th", F.lit(each)) == 0).mapInArrow(_variants(shingle), "key long, a long, check long")
    counts = sample.groupBy("key").agg(F.count_distinct("a").alias("n")).where(F.col("n") >= HEAVY).orderBy("key").toArrow()  # SEGMENTS * STRUCK * SAMPLE / HEAVY at most
    parts = 1 << np.ceil(np.log2(counts["n"].to_numpy() / HEAVY)).astype(np.int64)  # powers of two: parts of different keys hold the same texts, and lead to the same pairs
    heavy = counts["key"].to_numpy(), parts
    rows = texts.mapInArrow(_variants(shingle, heavy), "key long, a long, check long")
    # leaders of a key come in one order everywhere
    return rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, "key long, a long, b long")


def _places(near: DataFrame) -> DataFrame:
    """(node, root, place, block) of the texts of near(a, b, near, a_bytes, b_bytes): a text that its links lead to, and where it stands: in a block of its loose cluster, or on its own.

    Both are the least hashes within SPREAD steps, not whole components: roots only save comparisons, as equal ones are of
    one group for sure, and blocks only say what is compared together.
    """
    turned = near.select(F.col("b").alias("a"), F.col("a").alias("b"), "near", F.col("b_bytes").alias("bytes"))
    both = stash(near.select("a", "b", "near", F.col("a_bytes").alias("bytes")).union(turned), "similar-both")
    label = None
    for k in range(SPREAD):
        step = both.withColumns({"loose": F.col("b"), "strict": F.col("b")}) if label is None else both.join(label.withColumnRenamed("a", "b"), "b")
        label = step.groupBy("a").agg(F.min("loose").alias("loose"), F.min(F.when(F.col("near"), F.col("strict"))).alias("strict"), F.max("bytes").alias("bytes"))
        label = label.select("a", F.least("a", "loose").alias("loose"), F.least("a", "strict").alias("strict"), *(["bytes"] if k == SPREAD - 1 else []))
    label = stash(label, "similar-label")
    counts = label.groupBy("loose").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).where(F.col("n") >= CLUSTER)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("all") / BLOCK_BYTES))
    own = F.when(F.col("n").isNotNull(), F.xxhash64("loose", F.pmod(F.xxhash64("a"), blocks))).otherwise(F.col("a"))
    out = stash(label.join(counts, "loose", "left").select(F.col("a").alias("node"), F.col("strict").alias("root"), own.alias("place"), F.col("n").isNotNull().cast("long").alias("block")), "similar-places")
    drop_stash(both, label)
    return out


def _left_over(met: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, block): each text a with the places b that hold a candidate of it which the groups do not join with it yet."""

    def meet(batches):
        each = runs(batches, ("key", "a", "check", "root", "place", "block"), "a")
        for x in pieces(p for _, *rest in each for p in _across(*rest)):
            yield _batch(x, ["a", "b", "block"])

    stand = places.select(F.col("node").alias("a"), "root", "place", "block")
    placed = lambda rows: rows.join(stand, "a", "left").withColumns({"root": F.coalesce("root", "a"), "place": F.coalesce("place", "a"), "block": F.coalesce("block", F.lit(0).cast("long"))})
    # a text's place is looked up once, not under each of its keys, which are SEGMENTS * STRUCK at most
    texts = met.where("key >= 0").groupBy("a").agg(F.collect_set("key").alias("keys"), F.min("b").alias("check"))
    rows = placed(texts).select(F.explode("keys").alias("key"), "a", "check", "root", "place", "block")
    within = rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, block long")
    # under heavy keys classes meet, not texts: who is not of the largest group of two such classes asks all places of the other
    members = stash(placed(met.where("key = -3").select("a", F.col("b").alias("kind"))).distinct(), "similar-members")
    largest = members.groupBy("kind", "root").agg(F.count("*").alias("n")).groupBy("kind").agg(F.max(F.struct("n", "root")).alias("top"))
    side = lambda c: largest.select(F.col("kind").alias(c), F.col("top").alias(f"top_{c}"))
    pairs = met.where("key = -2").select(F.col("a").alias("p"), F.col("b").alias("q")).distinct().join(side("p"), "p").join(side("q"), "q")
    pairs = pairs.select(F.col("p").alias("kind"), "q", F.greatest("top_p", "top_q")["root"].alias("largest"))
    held = members.select(F.col("kind").alias("q"), "place", "block").distinct().withColumnRenamed("place", "b")
    asks = members.select("a", "kind", "root").join(pairs, "kind").where("root <> largest").select("a", "q").distinct()
    return within.union(asks.join(held, "q").select("a", "b", "block")).distinct()


def _ask(similarity: float):
    """For a block's texts and the askers of one part: a link for each group of the block that holds a near copy of an asker."""

    def run(texts: pa.Table, askers: pa.Table) -> pa.Table:
        a, b = [], []
        if texts.num_rows:
            sets = [np.frombuffer(x, np.uint32) for x in texts["s"].to_pylist()]
            th, root, size = texts["th"].to_numpy(), texts["root"].to_numpy(), np.array([len(x) for x in sets])
            known, at = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.cumsum(size) - size
            for q, own, s in zip(askers["th"].to_pylist(), askers["root"].to_pylist(), askers["s"].to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint32)
                has = np.isin(known, s, assume_unique=True)
                both = np.add.reduceat(has[at].astype(np.int32), start)
                hit = np.flatnonzero((both >= similarity * (size + len(s) - both) - 1e-9) & (root != own))
                hit = hit[np.unique(root[hit], return_index=True)[1]]
                a += [q] * len(hit)
                b += th[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar(docs: DataFrame, text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(node, root) for the hash (xxhash64) of every text that has a near copy among other texts; root is the same for all of a group.

    Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `similarity`; groups are joined
    over links. Null texts are empty; texts without words are alike. Repeated rows change nothing; an empty table gives none.
    """
    body = text_or_empty(text)
    texts = docs.select(F.xxhash64(body).alias("th"), body.alias("text"))
    met = stash(_met(texts, shingle), "similar-met")

    def sets(batches):
        words_of = _WordHash()
        for x in slices(batches):
            s = [np.unique(shingles(t, shingle, words_of).astype(np.uint32)).tobytes() for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("th"), pa.array(s, pa.binary())], ["th", "s"])

    def sets_of(needed: DataFrame, tag: str) -> DataFrame:
        return stash(texts.join(needed, "th", "left_semi").mapInArrow(sets, "th long, s binary").dropDuplicates(["th"]), tag)

    least = min(similarity, LOOSE)

    def verify(batches):
        for x in slices(batches):
            like, sizes = [], ([], [])
            for p, q in zip(x.column("p").to_pylist(), x.column("q").to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                for own, n in zip(sizes, (len(p), len(q)), strict=True):
                    own.append(4 * n)
                like.append(both / (len(p) + len(q) - both) + 1e-9)
            like = np.array(like, np.float64)
            out = pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(like >= similarity), *(pa.array(n, pa.int64()) for n in sizes)], ["a", "b", "near", "a_bytes", "b_bytes"])
            yield out.filter(pa.array(like >= least))

    def compared(pairs: DataFrame, held: DataFrame, tag: str) -> DataFrame:
        with_a = pairs.join(held.select(F.col("th").alias("a"), F.col("s").alias("p")), "a")
        with_both = with_a.join(held.select(F.col("th").alias("b"), F.col("s").alias("q")), "b")
        return stash(with_both.select("a", "b", "p", "q").mapInArrow(verify, "a long, b long, near boolean, a_bytes long, b_bytes long"), tag)

    def unordered(pairs: DataFrame, tag: str) -> DataFrame:
        return stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)

    nth = F.row_number().over(W.partitionBy("a").orderBy(F.desc("count"), "b"))
    some = met.where("key = -4").groupBy("a", "b").count().withColumn("nth", nth).where(F.col("nth") <= FIRST)  # those that most keys tell
    pairs = unordered(met.where("key = -1").select("a", "b").union(some.select("a", "b")), "similar-pairs")
    held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), "similar-sets")
    near = compared(pairs, held, "similar-near")
    places = _places(near)
    asks = stash(_left_over(met, places), "similar-asks")
    drop_stash(pairs, met)

    rest = unordered(asks.where("block = 0").select("a", "b"), "similar-rest")
    asked = asks.where("block = 1").select("a", F.col("b").alias("place"))
    parts = asked.groupBy("place").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts"))
    blocks = places.where("block = 1").join(parts, "place").select("place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("th"), "root")
    asked = asked.join(parts, "place").select("place", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("th"))
    asked = asked.join(places.select(F.col("node").alias("th"), "root"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    needed = rest.select(F.explode(F.array("a", "b")).alias("th")).union(asked.select("th")).union(blocks.select("th"))
    more = sets_of(needed.distinct(), "similar-more")
    pairwise = compared(rest, more, "similar-single").where("near").select("a", "b")
    grouped = blocks.join(more, "th").select(*ASKED).groupBy("place", "part").cogroup(asked.join(more, "th").select(*ASKED).toDF(*ASKED).groupBy("place", "part"))
    blockwise = stash(grouped.applyInArrow(_ask(similarity), "a long, b long"), "similar-blocks")
    joined = near.where("near").select("a", "b").union(pairwise).union(blockwise)
    found = components(joined, "a", "b", "similar-links")
    drop_stash(near, held, places, asks, rest, more, blockwise)
    return found


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs, as they are, less all but one of each group of near copies: the one of the smallest doc_id stays, of
    rows with that id the one with the least hash. A null id ranks behind all others."""
    n, ids = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
    roots = similar(docs, text, similarity, shingle)
    rid, th = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), F.xxhash64(text_or_empty(text))
    keyed = docs.select(F.struct("*").alias("row"), rid.alias("_rid"), th.alias("_th"))
    least = keyed.groupBy("_th").agg(F.min("_rid").alias("_rid")).join(roots, F.col("_th") == F.col("node"), "left")
    first = least.groupBy(F.coalesce("root", "_th").alias("root")).agg(F.min(F.struct("_rid", "_th")).alias("f")).select("f._rid", "f._th")
    kept = keyed.join(first.hint("shuffle_hash"), ["_rid", "_th"], "left_semi")
    if n > ids:
        kept = kept.dropDuplicates(["_rid", "_th"])
    return kept.select("row.*")
