"""One query for each corpus operator: production parameters, whole tables, whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bpe, codebooks, embed_dedup, packing, phrases, pii, quality, sharding, simhash, substring, topk, toxicity
from .common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)") for kind in pii.KINDS}
    joined = {c: F.expr(f"concat_ws(',', transform({c}, s -> concat_ws(':', s.kind, s.start, s.end)))") for c in ("base", "spans")}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3, shingle=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(ids, RANKS).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, within=80, top=2000)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.coded(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)


def op13_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = binpack.pack_texts(table(spark, sf_dir, "documents"), WORD_TOKENIZER, binpack.Limits(tokens=2048, segments=512, loss=2048), cut=True, end=1)
    return placed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_shard": op5_shard,
    "op6_pack": op6_pack,
    "op7_embed_dedup": op7_embed_dedup,
    "op8_substring": op8_substring,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
    "op11_phrases": op11_phrases,
    "op12_codes": op12_codes,
    "op13_binpack": op13_binpack,
}

#: Those that SQL can express; tests/llm holds the others against brute force, the library's own encoder or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op7_embed_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] e from embeddings where vec_id is not null and label is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
        reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
        c as (select vec_id, (select count(*) from links where a = vec_id) n_links, least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) component_id from embeddings)
        select vec_id, n_links, component_id, vec_id = component_id as kept from c
    """,
    "op8_substring": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
        firsts as (select k, min(doc_id) f from windows group by k),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) p from windows join firsts using (k) where f < doc_id),
        g as (select doc_id, list(p) ps, count(*) n from gone group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(array_to_string(list_filter(w, lambda x, j: ps is null or not list_contains(ps, j)), ' '), '')) as kept_sha256
        from d left join g using (doc_id)
    """,
    "op10_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 5
    """,
    "op11_phrases": r"""
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
        w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
        g as (select lang, n, w[i:i + n - 1] g from (select lang, w, n, unnest(range(1, len(w) - n + 2)) i from w, (select unnest(range(1, 5)) n) where len(w) >= n)),
        f as (select lang, n, g, count(*) f from g group by all),
        total as (select lang, sum(f)::bigint n from f where n = 1 group by lang),
        c as (select lang, n, g, f a from f where n >= 2 and f >= 30),
        longer as (select lang, g[i:i + m - 1] g, max(a) longer from (select lang, n, g, a, m, unnest(range(1, n - m + 2)) i from c, (select unnest(range(2, 4)) m) where m < n) group by all),
        kept as (select c.* from c left join longer using (lang, g) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
        cuts as (select kept.lang, kept.n, kept.g, a, k, l.f l, r.f r, (2000000 * a::hugeint // (l.f + r.f))::bigint score from kept, (select unnest(range(1, 4)) k), f l, f r
            where k < kept.n and l.lang = kept.lang and l.g = kept.g[1:k] and r.lang = kept.lang and r.g = kept.g[k + 1:]),
        best as (select *, row_number() over (partition by lang, g order by score, k) nth from cuts),
        ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) "rank", array_to_string(g, ' ') phrase, a, l, r, score from best where nth = 1)
        select lang, "rank", phrase, a, l, r, n, score from ranked join total using (lang) where "rank" <= 2000
    """,
    "op12_codes": """
        with v as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v, row_number() over (order by vec_id) - 1 nth from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        x as (select vec_id, label, nth, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] x from v, (select unnest(range(16)) p)),
        b0 as (select p, nth e, x c from x where nth < 64),
        d0 as (select vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from x join b0 using (p)),
        a0 as (select vec_id, p, arg_min(e, d * 1000 + e) e from d0 group by all),
        m0 as (select a0.p, e, i, floor(sum(x[i]) / count(*))::bigint m from x join a0 using (vec_id, p), (select unnest(range(1, 65)) i) where i <= len(x) group by all),
        b1 as (select p, e, coalesce(m, c) c from b0 left join (select p, e, list(m order by i) m from m0 group by all) using (p, e)),
        d1 as (select vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from x join b1 using (p)),
        a1 as (select vec_id, p, arg_min(e, d * 1000 + e) e from d1 group by all),
        m1 as (select a1.p, e, i, floor(sum(x[i]) / count(*))::bigint m from x join a1 using (vec_id, p), (select unnest(range(1, 65)) i) where i <= len(x) group by all),
        b2 as (select p, e, coalesce(m, c) c from b1 left join (select p, e, list(m order by i) m from m1 group by all) using (p, e)),
        d2 as (select vec_id, label, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from x join b2 using (p)),
        a2 as (select vec_id, label, p, arg_min(e, d * 1000 + e) e, min(d) d from d2 group by all),
        coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) code, sum(d)::bigint error from a2 group by all),
        said as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) codebooks_sha256 from b2)
        select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from coded, said
    """,
}
