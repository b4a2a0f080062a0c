"""Phrase mining, vector codes and vector bin packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import binpack, codebooks, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# phrases


def phrase_texts():
    """A small vocabulary, so that phrases repeat; phrases inside longer ones; odd blanks, ends, cases and letters; a language that is null, one named und."""
    r = random.Random(4)
    words = ["the", "The", "old", "grey", "mill", "stood", "É", "é", "x" * 300, "a.b", "\x00", " ", "5"]
    out = []
    for k in range(400):
        w = [r.choice(words[:6] if r.random() < 0.9 else words) for _ in range(r.randrange(0, 40))]
        if k % 3 == 0:
            w[5:5] = ["quite", "by", "the", "way"]
        out.append((k, "".join(x + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "; "]) for x in w), ["en", "de", None, "und"][k % 4], "s", 1))
    return [*out, (1000, None, "en", None, None), (1001, "", "fr", None, None), (1002, " \t.,\n", "fr", None, None), (None, "the old mill " * 50, "en", None, None), out[3], (1003, "lonely " * 3, "it", "s", 1), (1004, "word " * 5000, "nl", "s", 1)]


def brute_collocations(given, longest=4, least=30, within=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in given:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for k in range(len(w) - size + 1):
                    f[lang][tuple(w[k : k + size])] += 1
    out = []
    for lang, own in f.items():
        candidates = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        hidden = set()
        for g, a in candidates.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g) and 100 * a >= within * candidates.get(g[i:j], math.inf):
                        hidden.add(g[i:j])
        best = []
        for g, a in candidates.items():
            if g not in hidden:
                score, _, left, right = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, g.decode(), -a, left, right, n[lang], -score) for k, (score, a, g, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"part_keys": 7, "row_words": 50, "top": 5}])
def test_collocations(spark, options):
    given = phrase_texts()
    want = brute_collocations(given, top=options.get("top", 2000))
    assert len(want) > 15 and {w[0] for w in want} >= {"en", "de", "und", "nl"}
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    if not options:
        assert any(phrase_in(w[2], v[2]) for w in want for v in want if v[0] == w[0] and v != w)
    assert rows(phrases.collocations(docs.withColumns({c: F.lit("x") for c in ("words", "codes", "f", "idx", "key", "phrase")}), **options)) == want


def phrase_in(a, b):
    return f" {a} " in f" {b} "


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en", "s", 1), (2, None, None, None, None)], SCHEMA)).count() == 0


def test_collocations_across_stretches(monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 16)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("ab \t\n.") for _ in range(r.randrange(200))) + "c" * r.randrange(60)
        raw = t.encode().translate(phrases._ENDS)
        whole = raw.replace(b"\xff", b" \xff ").split()
        assert [w for s in phrases._stretches(raw) for w in s.replace(b"\xff", b" \xff ").split()] == whole


def test_rows_of_codes_are_read_and_written_few_at_a_time(spark, monkeypatch):
    """Parquet's reader takes rows by number, its writer holds a row group: both stay small for rows that are large themselves."""
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before = spark.conf.get(key)

    def stash(df, tag, group_mb=None):
        seen.append((tag, int(spark.conf.get(key)), group_mb))
        return phrases_stash(df, tag, group_mb)

    phrases_stash = phrases.stash
    monkeypatch.setattr(phrases, "stash", stash)
    phrases.collocations(spark.createDataFrame(phrase_texts(), SCHEMA), part_keys=7).count()
    large = [x for x in seen if x[0].startswith(("phrase-codes", "phrase-known", "phrase-at", "phrase-marked"))]
    assert {x[0].rstrip("-123") for x in large} == {"phrase-codes", "phrase-known", "phrase-at", "phrase-marked"}
    assert all(reads <= 64 and group is not None and group <= 16 for _, reads, group in large) and spark.conf.get(key) == before
    kept = phrases_stash(spark.range(0, 600, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 1000), k -> sha2(concat(id, '.', k), 256)), '') as binary)").alias("codes")), "rows", 1)
    groups = [g for f in kept.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) > 4 and kept.count() == 600


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
    h = phrases.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys))) and (h.find(keys) == h.slots(keys)).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.int64).view(np.uint64), keys)
    assert (h.find(others) == -1).all()


# codes


def brute_codes(given, parts=16, entries=64, rounds=2):
    fit = [(i, v, label) for i, v, label in given if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in fit}:
        own = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in fit if len(v) == width]
        cut = [width * p // parts for p in range(parts + 1)]
        part = lambda v, p: tuple(v[cut[p] : cut[p + 1]])  # noqa: E731, B023
        first = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
        books = [[part(v, p) for _, v, _ in first] for p in range(parts)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            new = []
            for p in range(parts):
                members = defaultdict(list)
                for _, v, _ in own:
                    members[near(part(v, p), books[p])[1]].append(part(v, p))
                new.append([tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])])
            books = new
        said = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in own:
            found = [near(part(v, p), books[p]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label, said))
    total = Counter()
    for _, _, error, label, _ in out:
        total[label] += error
    return sorted(((i, code, error, total[label], said) for i, code, error, label, said in out), key=repr)


def code_vectors(n=220, width=32):
    """Clusters, ties (a coarse grid), repeated vectors and ids, null ids and labels, and vectors that are left out or of another length."""
    r = np.random.default_rng(3)
    x = r.standard_normal((n, width)) + 4 * r.integers(0, 3, (n, 1))
    x[::3] = np.round(x[::3] / 2) / 2
    out = [(k, [float(v) for v in x[k].astype(np.float32)], int(k % 3) if k % 7 else None) for k in range(n)]
    out += [(n + k, out[9][1], 1) for k in range(4)] + [out[5], (None, out[8][1], 0), (None, [0.25] * width, None)]
    out += [(1000, None, 1), (1001, [float("nan")] * width, 1), (1002, [1.0, None] * (width // 2), 1), (1003, [float("inf")] * width, 1)]
    return out + [(1004, [], 2), (1005, [0.5] * 5, 2), (1006, [0.7] * 5, 2), (1007, [-3.0] * 33, 0)]


@pytest.mark.parametrize("entries, rounds, together", [(64, 2, 1024), (5, 6, 7), (256, 1, 64)])
def test_codes(spark, entries, rounds, together):
    given = code_vectors()
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({c: F.lit("x") for c in ("id", "v", "code", "width", "of")})
    got = codebooks.coded(df, entries=entries, rounds=rounds, together=together).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert rows(got) == brute_codes(given, 16, entries, rounds)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codebooks.coded(none).count() == 0
    assert codebooks.coded(spark.createDataFrame([(1, None, None)], none.schema)).count() == 0
    with pytest.raises(Exception, match="absolute value"):
        codebooks.coded(spark.createDataFrame([(1, [1e30] * 16, 0)], none.schema)).count()


def test_bounds_prune_and_stay_bounds():
    """Over rounds of movement: bounds hold, codes are those of full search, and most distances are left out."""
    r = np.random.default_rng(8)
    centres = r.integers(-2000, 2000, (16, 4))
    x = centres[r.integers(0, 16, 3000)] + r.integers(-40, 40, (3000, 4))
    entries = x[:64].copy()
    b, took = codebooks.Bounds.full(x, entries), 0
    for _ in range(8):
        now = entries.copy()
        for k in range(64):
            if (b.code == k).any():
                now[k] = x[b.code == k].sum(axis=0) // (b.code == k).sum()
        moves = np.sqrt(((now - entries).astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
        entries = now
        low, step = codebooks.stored_bounds(b.lower)
        assert (low * step[:, None] <= b.lower).all()
        b.lower = low * step[:, None] * (1 - 1e-12)
        b.moved(moves)
        took += b.settle(x, entries)
        d2 = codebooks.squared(x, entries)
        assert (b.code == d2.argmin(axis=1)).all()
        assert (b.upper >= np.sqrt(d2[np.arange(3000), b.code])).all() and (b.lower <= np.sqrt(d2)).all()
    assert took < 0.2 * 8 * 3000 * 64


# packing


def brute_ids(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_ids():
    r = random.Random(1)
    odd = list(map(chr, (32, 32, 32, 9, 10, 11, 12, 13, 0x1C, 0x1F, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x301, 0x308, 0x345, 0x130, 0x3A3, 0x3C3, 0xDF, 0x178, 0x1100, 0x1161, 0xAC00))) + ["a", "A", "É", "'s", "'", ".", ",", "...", '"', "_", "1", "23", "<|endoftext|>", "word", "It's"]
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["", "The mill, stood. \"Quite,\" they said: it's 3.5%!", "x" * 3000, " ".join(map(chr, range(1, 3000)))]
    of = binpack.WordIds(VOCABULARY, memo=500)
    got = [x.tolist() for k in range(0, len(texts), 50) for x in of(texts[k : k + 50])]
    assert got == brute_ids(texts)


def packed(df, limits, cut, **options):
    got = binpack.pack_examples(df, limits, cut, **options).collect()
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append(x)
    for own in by.values():
        own.sort(key=lambda x: x.offset)
        assert len(own) <= limits.segments and sum(x.loss for x in own) <= limits.loss and sum(x.length for x in own) <= limits.tokens
        assert [x.offset for x in own] == np.cumsum([0, *(x.length for x in own)])[:-1].tolist() and [x.segment for x in own] == list(range(len(own)))
        assert all(x.length > 0 for x in own)
    return got, [sum(x.length for x in own) for own in by.values()]


def covered(got, ids):
    """Every id of every example lies in exactly one piece. ids: of each example id, which may stand for several rows."""
    of = defaultdict(list)
    for x in got:
        of[x.id, x.tokens].append(x)
    want = Counter((k, len(v) // 4) for k, v in ids if v)
    assert set(of) == set(want)
    raw = {(k, len(v) // 4): v for k, v in ids if v}
    for key, times in want.items():
        ends = Counter()
        for x in of[key]:
            assert x.ids_crc32 == zlib.crc32(raw[key][4 * x.start : 4 * (x.start + x.length)])
            ends[x.start] += 1
            ends[x.start + x.length] -= 1
        depth = 0
        for at in sorted(ends):
            depth += ends[at]
            assert depth == (times if at < key[1] else 0)


@pytest.mark.parametrize("limits, parcel", [(binpack.Limits(64, 6, 64), 5000), (binpack.Limits(64, 512, 30), 1 << 20), (binpack.Limits(64, 3, 20), 300)])
@pytest.mark.parametrize("cut", [True, False])
def test_pack_examples(spark, limits, parcel, cut):
    r = random.Random(6)
    given = []
    for k in range(500):
        n = r.choice([0, 1, 2, 3, 20, 40, 64, 65, r.randrange(1, 400)])
        mask = None if k % 4 == 0 else bytes(int(r.random() < r.choice([0.1, 0.5])) for _ in range(n if k % 4 == 1 else n // 2))
        given.append((k % 490 if k % 50 else None, np.array([r.randrange(50000) for _ in range(n)], "<u4").tobytes() if k % 41 else None, mask))
    df = spark.createDataFrame(given, "id long, ids binary, mask binary").repartition(2)
    got, used = packed(df.withColumns({c: F.lit("x") for c in ("start", "loss", "offset")}), limits, cut, mask="mask", parcel_tokens=parcel)
    assert sum(used) == sum(len(i or b"") // 4 for _, i, _ in given)
    if cut and limits.loss == limits.tokens and limits.segments > 4:
        covered([x for x in got if x.id is not None], [(k, i) for k, i, _ in given if k is not None])
        assert sum(limits.tokens - u for u in used if u & (u - 1)) <= 0.01 * sum(used)
    if not cut:
        pieces = Counter((x.id, x.tokens, x.start) for x in got)
        assert max(pieces.values()) <= sum(1 for x in given if x[0] is None)
        whole = [x for x in got if x.tokens <= min(limits.tokens, limits.loss)]
        assert whole and all(x.length == x.tokens for x in whole)
    assert packed(df.limit(0), limits, cut)[0] == []


def test_dot_product_mixes_demands():
    """Examples with much loss and such with little share bins: the limits together allow 2 of each, and neither kind alone fills one."""
    tokens, heavy, light = 10, np.arange(11), np.zeros(11, int)
    bins = binpack.fill([heavy, light] * 20, [(k, 0, tokens) for k in range(40)], binpack.Limits(40, 8, 20), False)
    assert len(bins) == 10 and all(len(b) == 4 for b in bins)


def test_instruction_turns(spark):
    """Loss-bearing tokens of conversations: those of the assistant's turns."""
    t = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("id", F.monotonically_increasing_id())
    ids = binpack.tokenized(t, VOCABULARY, end=1, doc_id="id")
    turns = ids.join(t.select("id", "role"), ids.doc_id == t.id).withColumn("mask", F.when(F.col("role") == "assistant", F.lit(None)).otherwise(F.expr("cast(repeat('\\0', 10000) as binary)"))).select("id", "ids", "mask", "role")
    got, used = packed(turns, binpack.Limits(512, 8, 256), False, mask="mask")
    roles = {r.id: r.role for r in t.select("id", "role").collect()}
    assert sum(used) > 0 and all(x.loss == (x.length if roles[x.id] == "assistant" else 0) for x in got)


def test_pack_documents_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + k, x) for k, x in enumerate([None, "", "tiny"] + ["so so"] * 3000)], "doc_id long, text string"))
    ids = binpack.tokenized(docs, VOCABULARY)
    got, used = packed(ids, binpack.Limits(), True, example_id="doc_id")
    covered(got, [(r.doc_id, bytes(r.ids)) for r in ids.collect()])
    assert sum(2048 - u for u in used if u & (u - 1)) <= 0.005 * sum(used)
    given = docs.collect()
    want = {r.doc_id: [*i, 1] for r, i in zip(given, brute_ids([r.text or "" for r in given]), strict=True)}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in ids.collect()} == want
    pieces = lambda df: sorted((x.id, x.start, x.length, x.ids_crc32, x.offset) for x in df.collect())
    assert pieces(binpack.pack_texts(docs, VOCABULARY, binpack.Limits(), True)) == pieces(binpack.pack_examples(ids, binpack.Limits(), True, "doc_id"))
    assert binpack.pack_texts(docs.limit(0), VOCABULARY).count() == 0
