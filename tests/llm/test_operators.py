"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, components, embed_dedup, packing, pii, quality, sharding, similar, simhash, substring, topk, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("bar", "den", "fog", "hil", "jot", "kin", "lus", "mer")]


def texts(n=60, seed=1):
    """Random texts, exact copies, near copies, shared passages, null, empty, blank and long ones, and one id twice."""
    r = random.Random(seed)
    words = lambda k: [r.choice(WORDS) for _ in range(k)]
    out = [" ".join(words(r.randrange(1, 120))) for _ in range(n)]
    passage = " ".join(words(40))
    for k in range(5, n, 6):
        out[k] = " ".join(words(10)) + "\n" + passage + " " + " ".join(words(7))
    for k in range(7, n, 9):
        out[k] = out[3]
    long = words(3000)
    out += [None, "", " \t\n", " ".join(long), " ".join([*long[:1500], "changed", *long[1501:]]), "Ärger mit Ümlaut " * 20, "a" * 5000]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(out)]
    return [*rows, (4, "another text under an id that is there already", "en", "s", 1), (None, out[0], None, None, None), rows[2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """More columns, with the names that the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("rid", "th", "key", "fp", "size", "shard", "score", "spans", "ids", "h", "e")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(3, None), (8, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for x in list(root) if any(x in (a, b) and a != b and b is not None for a, b in pairs)}
    got = {tuple(x) for x in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert {g for g in got if g[0] != g[1]} == {w for w in want if w[0] != w[1]}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, odd, none):
    given = docs.collect()
    fp = [brute_fingerprint(r.text) for r in given]
    group = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {g: min((given[k].doc_id for k in range(len(fp)) if group[k] == g and given[k].doc_id is not None), default=None) for g in group}
    want = sorted(((given[k].doc_id, fp[k] - (1 << 64 if fp[k] >> 63 else 0), least[group[k]]) for k in range(len(fp))), key=repr)
    for d in (docs, odd):
        assert rows(simhash.near_duplicates(d).select("doc_id", "fp", "component_id")) == want
    assert simhash.near_duplicates(none).count() == 0


def brute_groups(given, similarity=0.8, n=5):
    """A number for each text, the same for texts that links of that similarity join."""
    words = [(t or "").encode().lower().split() for t in given]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in words]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


def near_texts():
    """Families of copies with few and with many changed words, from clearly near to clearly other, and a large family."""
    r = random.Random(8)
    out = []
    for changes in (1, 2, 3, 5, 8, 12, 20, 40) * 3:
        base = [r.choice(WORDS) for _ in range(300)]
        other = list(base)
        for k in r.sample(range(300), changes):
            other[k] = "changed"
        out += [" ".join(base), " ".join(other).upper()]
    base = [r.choice(WORDS) for _ in range(200)]
    return out + [" ".join([*base[:k], f"note{k}", *base[k + 1 :]]) for k in range(150)]


def test_similar(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(similar, "TOGETHER", 40)
    given = docs.collect() + [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(near_texts())]
    group = brute_groups([r[1] for r in given])
    ids = [2**63 if r[0] is None else r[0] for r in given]
    want = sorted(min(i for i, h in zip(ids, group, strict=True) if h == g) for g in set(group))
    for d in (spark.createDataFrame(given, SCHEMA).repartition(3), spark.createDataFrame(given, SCHEMA).coalesce(1)):
        kept = similar.keep_first(d).collect()
        assert sorted(2**63 if r.doc_id is None else r.doc_id for r in kept) == want
    clash = odd.withColumns({c: F.lit("x") for c in ("_rid", "_th", "row", "root", "node", "a", "b", "s", "check")})
    kept = similar.keep_first(clash).collect()
    assert len(kept) == len(set(brute_groups([r.text for r in docs.collect()]))) and kept[0].asDict().keys() == set(clash.columns)
    assert similar.keep_first(none).count() == 0


def test_similar_follower_meets_others():
    """1 leads 2 (3 bits), 3 is too far from 1 but not from 2: the pair (2, 3) comes in the second round, unless the first has joined them."""
    ids, check = np.array([1, 2, 3]), np.array([0, 0b111, 0b111 | (2**18 - 1) << 3])
    a, b, more = similar._nearest(ids, check)
    assert (a.tolist(), b.tolist(), more) == ([2], [1], True)
    alone = np.zeros(3, np.int64)
    left = lambda *root: {tuple(sorted(p)) for x, y, _ in similar._across(ids, check, np.array(root), ids, alone) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert left(1, 2, 3) == {(1, 2), (2, 3)} and left(1, 1, 3) == {(2, 3)} and left(1, 1, 1) == set()


def test_similar_looks_up_a_text_once(spark):
    """The join with places takes a row for each text, whatever number of keys it has; pairs that the groups join are left out."""
    met = spark.createDataFrame([(key, a, 0) for key in range(40) for a in (1, 2, 3)], "key long, a long, b long")
    places = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 2, 0)], "node long, root long, place long, block long")
    rest = similar._left_over(met, places)
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(keys") < plan.index("LeftOuter")
    assert {tuple(x) for x in rest.collect()} == {(3, 1, 0), (3, 2, 0)}


def test_similar_of_one_template(spark, monkeypatch):
    """400 texts at about 0.73 of each other and 200 at about 0.85 of one of them: the groups hold those of all pairs that meet under a key, and lie in those of brute force. The template's keys are heavy, its texts stand in blocks."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 100)
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 5000, 300)]

    def vary(words):
        out = list(words)
        for at in r.choice(300, 5, replace=False):
            out[at] = f"v{r.integers(10**6)}"
        return out

    made = [vary(base) for _ in range(400)]
    made += [vary(made[i]) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    words_of = similar._WordHash()
    sets = [similar.shingles(" ".join(w), 5, words_of) for w in made]
    keys, check = similar.signatures(sets)
    group, whole, linked, brute = list(range(600)), list(range(600)), 0, 0
    for i in range(600):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both < 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                continue
            brute += 1
            if whole[i] != whole[j]:
                whole = [whole[j] if x == whole[i] else x for x in whole]
            if len(np.intersect1d(keys[i], keys[j])) and int(np.bitwise_count((check[i] ^ check[j]).view(np.uint64))) <= similar.LINK_BITS:
                linked += 1
                if group[i] != group[j]:
                    group = [group[j] if x == group[i] else x for x in group]
    assert linked >= 0.98 * brute
    th = {x.th: x.doc_id for x in df.select("doc_id", F.xxhash64("text").alias("th")).collect()}
    got = list(range(600))
    for x in similar.similar(df).collect():
        got[th[x.node]] = got[th[x.root]] = 1000 + th[x.root]
    same = lambda g: {frozenset(np.flatnonzero(np.array(g) == x).tolist()) for x in set(g)}
    within = lambda g, h: all(any(x <= y for y in same(h)) for x in same(g))
    assert within(group, got) and within(got, whole)


def linked_groups(fps, pairs):
    """The smallest fingerprint that each reaches over the pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def near_pairs(signed, distance):
    x = np.array(signed, np.int64).view(np.uint64)
    for k in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= distance).tolist():
            yield signed[k], signed[k + 1 + j]


@pytest.mark.parametrize("distance, together", [(0, 2048), (1, 2048), (2, 2048), (3, 2048), (3, 2), (2, 5)])
def test_simhash_links(spark, distance, together):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4)} | {0, 1, 2**64 - 1}
    signed = sorted(f - (1 << 64 if f >> 63 else 0) for f in fps)
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, together).collect()]
    assert linked_groups(signed, got) == linked_groups(signed, near_pairs(signed, distance))
    assert together < 2048 or len(got) <= 66 * len(signed)


@pytest.mark.parametrize("shared, together", [("low byte", 2048), ("low byte", 100), ("all but 11 bits", 300)])
def test_simhash_crowded_keys(spark, shared, together):
    """Thousands of fingerprints under one key: those with one upper segment and one last byte, and those that differ in eleven bits only."""
    r = np.random.default_rng(3)
    if shared == "low byte":
        x = (np.uint64(0xABCDEF01) << np.uint64(32)) | (r.integers(0, 2**24, 3002, dtype=np.uint64) << np.uint64(8)) | np.uint64(0x5A)
        near = x[:400] ^ (np.uint64(1) << r.integers(8, 32, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(8, 32, 400).astype(np.uint64)) ^ (np.uint64(1) << np.uint64(40))
        x = np.unique(np.concatenate([x, near]))
    else:
        x = np.unique(sum((r.integers(0, 2, 1200, dtype=np.uint64) << np.uint64(b) for b in (0, 1, 3, 9, 17, 22, 33, 35, 47, 58, 63)), np.zeros(1200, np.uint64)))
    signed = sorted(x.view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    got = [tuple(x) for x in simhash.links(df, 3, together).collect()]
    want = linked_groups(signed, near_pairs(signed, 3))
    assert linked_groups(signed, got) == want
    roots = {r.node: r.root for r in components.components(simhash.links(df, 3, together), "a", "b").collect()}
    assert {f: roots.get(f, f) for f in signed} == want


def brute_cut(given):
    first = {}
    for r in given:
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            i = 2**63 - 1 if r.doc_id is None else r.doc_id
            first[x] = min(first.get(x, i), i)
    out = []
    for r in given:
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        i = 2**63 - 1 if r.doc_id is None else r.doc_id
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((r.doc_id, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, crowded", [(1 << 20, 16), (50, 16), (50, 1)])
def test_substring(docs, odd, none, monkeypatch, block, crowded):
    monkeypatch.setattr(substring, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring, "CROWDED", crowded)
    want = brute_cut(docs.collect())
    assert sum(w[2] for w in want) > 500
    for d in (docs, odd):
        assert rows(substring.remove_repeats(d).select("doc_id", "n_words", "n_removed", "kept")) == want
    assert substring.remove_repeats(none).count() == 0
    cut = substring.cut(odd).collect()
    assert Counter(len((r.text or "").split()) for r in cut) == Counter(len(w[3].split()) for w in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)


def test_bpe(docs, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    strange = "".join(map(chr, [*range(0x300), *range(0x2000, 0x2070), *range(0x1F600, 0x1F640)]))
    more = docs.union(docs.sparkSession.createDataFrame([(900, strange, None, None, 1), (901, "  \n\n x  y's 123  <|endoftext|>", None, None, 1)], SCHEMA))
    for d in (more, odd):
        got = bpe.decode(bpe.encode(d, path, public_tokenizers.PATTERN), path)
        want = sorted(((r.doc_id, np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in d.collect()), key=repr)
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=repr) == want
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    h = bpe.PerfectHash(list(ranks))
    assert sorted(h.key_at.tolist()) == list(range(len(ranks))) and h(list(ranks)).tolist() == list(range(len(ranks)))


def test_sharding(docs, odd, none):
    import zlib

    given = docs.collect()
    for d in (docs, odd):
        got = sharding.shard(d, 4).collect()
        assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
        by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
        assert all(v == list(range(len(v))) for v in by.values())
        at = {}
        for r in got:
            at.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert all(len(v) == 1 for v in at.values())
        loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
        assert max(loads) - min(loads) <= max(Counter({k: v * k[1] for k, v in Counter((r.text_crc32, r.size) for r in got).items()}.values()))
    assert sharding.shard(none).count() == 0
    assert sharding.longest_first([(0, 5), (1, 9), (2, 5), (3, 1)], 2) == [(1, 0), (0, 1), (2, 1), (3, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_sharding_is_longest_first(docs, seed):
    """Classes of equal jobs give the loads of the heap over all jobs, and the operator's shards have them."""
    r = random.Random(seed)
    sizes = [r.choice((1, 2, 3, 50, r.randrange(1, 2000))) for _ in range(r.randrange(1, 900))] + [5000] * r.randrange(3)
    n = r.choice((1, 2, 5, 8))
    by = Counter()
    for job, s in sharding.longest_first(list(enumerate(sizes)), n):
        by[sizes[job], s] += 1
    classes = list(Counter(sizes).items())
    r.shuffle(classes)
    got = sharding.classes_first(classes, n)
    assert all(got[k][s] == by[size, s] for k, (size, _) in enumerate(classes) for s in range(n))
    if seed == 0:
        groups = Counter()
        for x in docs.collect():
            groups[x.text or ""] += len((x.text or "").encode()) + 1
        loads = [0] * 4
        for job, s in sharding.longest_first(list(enumerate(groups.values())), 4):
            loads[s] += list(groups.values())[job]
        placed = Counter()
        for x in sharding.shard(docs, 4).collect():
            placed[x.shard] += x.size
        assert [placed[s] for s in range(4)] == loads


def test_packing(docs, odd, none):
    for d in (docs, odd):
        got = packing.pack_documents(d, (16, 64, 256), 4).collect()
        want = Counter((repr(r.doc_id), len((r.text or "").split())) for r in d.collect() if (r.text or "").split())
        bins = {}
        for r in got:
            bins.setdefault((r.bin, r.bin_length), []).append((r.offset, r.length))
        for (_, length), own in bins.items():
            end = 0
            for offset, size in sorted(own):
                assert offset == end
                end += size
            assert end <= length and all(end > x for x in (16, 64, 256) if x < length)
        assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
        assert all(r.start == r.piece * 256 and r.length <= 256 for r in got)
    assert packing.pack_documents(none).count() == 0
    assert packing.pack([256, 255, 1, 64], (16, 64, 256))[1].sum() == 256 + 256 + 64
    r = np.random.default_rng(1)
    sizes = r.integers(1, 256, 400).tolist()
    _, final = packing.pack(sizes, (16, 64, 256), 4)
    assert sum(sizes) <= final.sum() <= 1.1 * sum(sizes)


def least_cost(sizes, lengths, overhead):
    """The least cost of any packing, by trying all partitions."""

    def rest(k, bins):
        if k == len(sizes):
            return sum(min(x for x in lengths if x >= b) + overhead for b in bins)
        best = rest(k + 1, [*bins, sizes[k]])
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= lengths[-1]:
                best = min(best, rest(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]]))
        return best

    return rest(0, [])


def test_packing_against_optimum():
    r, lengths, exact, costs = random.Random(3), (16, 40, 64), 0, [0, 0, 0]
    for _ in range(60):
        sizes = [r.randrange(1, 65) for _ in range(r.randrange(1, 8))]
        best = least_cost(sizes, lengths, 4)
        at, final = packing.pack(sizes, lengths, 4)
        cost = int(final.sum()) + 4 * len(final)
        assert all(sum(s for s, b in zip(sizes, at, strict=True) if b == k) <= n for k, n in enumerate(final))
        assert best <= cost <= 1.4 * best
        exact += cost == best
        costs = [costs[0] + best, costs[1] + cost, costs[2] + 1]
    assert exact >= 40 and costs[1] <= 1.05 * costs[0]
    # lengths mix: 40 for the middle pieces, 64 for the large ones, and the joint packing alone finds it
    at, used = packing.best_fit([64, 64, 20, 20, 20, 20], (40, 64), None, 4)
    assert sorted(used) == [40, 40, 64, 64]


def vectors(spark, n=300, seed=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 12))
    for k in range(0, n, 5):
        x[k] = x[k - 3] + 0.08 * r.standard_normal(12)
    out = [(k, [float(v) for v in x[k].astype(np.float32)], int(k % 3) if k % 11 else 0) for k in range(n)]
    out += [(n + k, out[9][1], out[9][2]) for k in range(6)]
    out += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 12, 1), (1003, [float("nan")] * 12, 1), (1004, [1.0, None] + [0.0] * 10, 1), (1005, [float("inf")] * 12, 1), (1006, out[1][1], None), (None, out[1][1], 1), (1007, out[1][1][:6], 1), (1008, [2 * v for v in out[1][1][:6]], 1)]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    given = vectors(spark)
    r = given.collect()
    fit = lambda v: v.embedding and v.label is not None and v.vec_id is not None and all(x is not None and math.isfinite(x) for x in v.embedding) and any(v.embedding)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))  # noqa: E731, B905
    links = {v.vec_id: {w.vec_id for w in r if fit(v) and fit(w) and v.vec_id != w.vec_id and v.label == w.label and len(v.embedding) == len(w.embedding) and cos(v.embedding, w.embedding) >= 0.98} for v in r}
    want = []
    for v in r:
        seen, todo = {v.vec_id}, [v.vec_id]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        least = min(seen) if v.vec_id is not None else None
        want.append((v.vec_id, len(links[v.vec_id]), least, v.vec_id == least and v.vec_id is not None))
    assert sum(w[1] for w in want) > 60
    got = embed_dedup.near_duplicates(given.withColumns({"cid": F.lit(1), "e": F.lit("x"), "root": F.lit(0)}))
    assert rows(got) == sorted(want, key=repr)
    assert embed_dedup.near_duplicates(given.limit(0)).count() == 0


@pytest.mark.parametrize("page, tree", [(256, 16384), (4, 40)])
def test_topk(spark, monkeypatch, page, tree):
    for name, v in (("PAGE", page), ("FAN", 3), ("TREE", tree), ("TOGETHER", 7), ("MOST_WIDTHS", 1)):
        monkeypatch.setattr(topk, name, v)
    given = vectors(spark).withColumns({"v": F.lit("x"), "shard": F.lit(1)})
    fit = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in given.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for i, q in fit:
        if i % 9 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fit if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert rows(topk.top_k(given, given.where("vec_id % 9 = 0"))) == sorted(want, key=repr)
    assert topk.top_k(given.limit(0), given).count() == 0 and topk.top_k(given, given.limit(0)).count() == 0


def test_pii_patterns():
    e, i, c, p = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: re.sub("[^0-9]", "", s)

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in e.finditer(t)] + [(m.start(), 1, m.end()) for m in i.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in c.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return sorted(out + [(m.start(), 3, m.end()) for m in p.finditer(t) if 10 <= len(digits(m[0])) <= 15])

    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..-+ 1239()é") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("Card 4111 1111 1111 1111, a@b.co.") == [(5, 2, 24), (26, 0, 32)]
    assert not pii.luhn("4111111111111112")


def test_pii_windows_cover_every_span():
    for n in (1, 95, 96, 97, 144, 145, 500):
        for k in range(0, n, 7):
            t = "a" * k + "7" + "b" * (n - k - 1)
            own = list(pii.windows(t))
            assert any(s <= k < s + len(w) for s, w in own) and all(t[s : s + len(w)] == w and (len(w) == pii.WINDOW or s + len(w) == n) for s, w in own)


class Marks:
    """In place of the network: marks all but line ends as an email."""

    def decode(self, windows):
        out = []
        for w in windows:
            on = np.array([c != "\n" for c in w])
            out.append(np.where(on, np.where(np.append(False, on[:-1]) | (np.arange(len(w)) == 0), 2, 1), 0).astype(np.int8))
        return out


@pytest.mark.parametrize("address", ["jane.doe (at) corp (dot) org", "jo[at]corp[dot]org", "jane.alexandra.doe-smith (at) research-department.corp (dot) org"])
def test_pii_spelled_out_addresses(address):
    for k in range(200):
        t = "\n" * k + address + "\n" * 150
        assert pii.find([t], Marks())[0][1] == [(k, 0, k + len(address))], k


def test_pii(docs, odd, none, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 6)
    spark = docs.sparkSession
    t = "Write to jo.doe@mail.example.com or +1 (564) 555-4526 soon; host 10.0.0.7, card 4111111111111111."
    more = docs.union(spark.createDataFrame([(700, t, "en", "s", 1), (701, "é" * 300 + t, "en", "s", 1)], SCHEMA))
    got = {r.doc_id: r for r in pii.detect(more).collect()}
    assert [(s.kind, t[s.start : s.end]) for s in got[700].base] == [("email", "jo.doe@mail.example.com"), ("phone", "+1 (564) 555-4526"), ("ip", "10.0.0.7"), ("card", "4111111111111111")]
    assert [(s.kind, s.start - 300, s.end - 300) for s in got[701].base] == [(s.kind, s.start, s.end) for s in got[700].base]
    for r in got.values():
        assert set(r.base) <= set(r.spans) and list(r.spans) == sorted(r.spans, key=lambda s: (s.start, pii.KINDS.index(s.kind)))
    done = {r.doc_id: r for r in pii.redact(more.withColumn("spans", F.lit(1))).collect()}
    assert done[700].text == "Write to [EMAIL] or [PHONE] soon; host [IP], card [CARD]."
    assert done[60].text is None and done[61].text == "" and done[63].spans == 1
    assert pii.detect(none).count() == 0 and pii.redact(none).count() == 0


@pytest.mark.parametrize("unit, step", [("4", 48), ("4-", 48), ("4 ", 48), ("411-", 3), ("a@b.", 7)])
def test_pii_long_runs(unit, step):
    """A megabyte in one chain of touching pieces of all kinds: no longer than a few seconds, and only spans that can be."""
    text = (unit * (1_000_000 // len(unit) + 1))[:1_000_000]
    found = [(k % 3, (s, k % 4, s + step + k % 2)) for k, s in enumerate(range(0, len(text) - step - 1, step))]
    found += [(pii.WINDOW, (s, k % 4, s + 12)) for k, s in enumerate(range(5, len(text) - 12, 977))]
    began = time.process_time()
    spans = pii.reconcile(text, pii.base_spans(text), found)
    assert time.process_time() - began < 30 and all(e - s <= pii.LONGEST[k] for s, k, e in spans)
    ordered = sorted((s, e) for s, _, e in spans)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False)) or pii.base_spans(text)


def test_pii_reconcile_like_before():
    """On ordinary texts the joined and accepted spans are those of comparing all pieces with all."""

    def plain(text, base, found):
        out, every = list(base), set(found)
        for kind in range(4):
            own = sorted((s, e) for _, (s, k, e) in every if k == kind)
            for i, (s, e) in enumerate(own):
                for a, b in own[i + 1 :]:
                    if a > e:
                        break
                    if b > e:
                        e = b
                        every.add((pii.WINDOW, (s, kind, e)))
        for _, (s, kind, e) in sorted(every, key=lambda f: (-f[0], f[1][0] - f[1][2], f[1])):
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
            if whole and pii.plausible(kind, text[s:e]) and all(e <= a or b <= s for a, _, b in out):
                out.append((s, kind, e))
        return sorted(out)

    r = random.Random(5)
    for _ in range(400):
        text = " ".join(r.choice(["call", "+1 564 555-4526", "jo (at) corp (dot) org", "4111 1111 1111 1111", "10.0.0.7", "at", "x@y.de", "007"]) for _ in range(12))
        found = [(r.randrange(97), (s, r.randrange(4), min(len(text), s + r.randrange(1, 30)))) for s in (r.randrange(len(text)) for _ in range(25))]
        assert pii.reconcile(text, pii.base_spans(text), found) == plain(text, pii.base_spans(text), found)


def test_pii_tagger_learns():
    r = np.random.default_rng(0)
    base = [" ".join(r.choice(WORDS, 14)) for _ in range(pii.FIT_WINDOWS)]
    tagger = pii.Tagger()
    tagger.train(*pii.training_windows(base))
    texts_, tags = pii.training_windows(base[:120], seed=123)
    assert np.mean([(a == b).all() for a, b in zip(tagger.decode(texts_), tags, strict=True)]) >= 0.85


def test_pii_added_spans():
    """Spans in spellings that no base pattern takes, invented with another seed than those of the training: how many are found exactly, and how many of the found are right."""
    r = np.random.default_rng(1)
    tagger = pii.Tagger()
    tagger.train(*pii.training_windows([" ".join(r.choice(WORDS, 14)) for _ in range(pii.FIT_WINDOWS)]))
    rng, right, wanted, found = np.random.default_rng(77), 0, 0, 0
    for _ in range(400):
        s, kind = pii._invented(rng)
        before = " ".join(r.choice(WORDS, 20)) + " "
        base, spans = pii.find([before + s + " " + " ".join(r.choice(WORDS, 20))], tagger)[0]
        own = (len(before), kind, len(before) + len(s))
        added = [x for x in spans if x not in base]
        wanted += kind >= 0 and own not in base
        right += own in added
        found += len(added)
    assert wanted > 100 and right >= 0.8 * wanted and right >= 0.8 * found


def test_isotonic():
    x, y, w = np.arange(6.0), np.array([0, 1, 0, 0.5, 1, 0.8]), np.ones(6)
    knots, values = quality.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    assert np.allclose(values, [0, 0.5, 0.9]) and np.allclose(knots, [0, 2, 4.5])


def test_quality(spark, docs, odd, none):
    big, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(big, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() >= 0.95 and got.score.between(0, 1).all()
    known = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, known).count() == docs.count()
    assert quality.score(none, known).count() == 0
    assert {r.score for r in quality.score(docs, known.limit(0)).collect()} == {0.5}
    assert quality.keep(odd, known.limit(0)).count() == docs.count()


def test_toxicity(spark, docs, odd, none):
    big, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(big, labels).join(labels, "doc_id").toPandas()
    assert got.predicted[got.toxic == 1].mean() >= 0.75 and got.predicted[got.toxic == 0].mean() <= 0.05
    known = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, known).count() == docs.count()
    assert toxicity.score(none, known).count() == 0
    assert {r.predicted for r in toxicity.score(docs, known.limit(0)).collect()} == {0}


def test_toxicity_held_out(spark):
    """Documents that the fit never saw, where there are enough labels to learn from (at sf0.01, with 37 toxic ones, 8 of 14 others are found)."""
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    outside = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    own = big.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(own, labels.where(~outside)).join(labels, "doc_id").where(outside).toPandas()
    assert got.toxic.sum() > 60 and got.predicted[got.toxic == 1].mean() >= 0.75 and got.predicted[got.toxic == 0].mean() <= 0.02
