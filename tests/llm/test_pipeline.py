"""The pipeline's stages, each against a plain version of what it has to do with its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from tessera.llm import packing, pii
from test_operators import SCHEMA, brute_cut, brute_groups, texts

SF = "/root/testdata/sf0.01"


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 4)
    assert [n for n, _ in P.STAGES] == ["quality", "near copies", "repeats", "personal data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = P.keep_good(spark, docs, SF)
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns
    assert sum(labels[i] == (i in ids) for i in labels) >= 0.97 * len(labels)
    given = spark.createDataFrame(texts(), SCHEMA)
    first = P.drop_near_copies(spark, given, SF).collect()
    assert len(first) == len(set(brute_groups([r.text for r in given.collect()]))) == len(set(brute_groups([r.text for r in first])))
    cut = P.cut_repeats(spark, given, SF).collect()
    assert sorted(len((r.text or "").split()) for r in cut) == sorted(len(w[3].split()) for w in brute_cut(given.collect()))
    clean = P.redact(spark, given, SF)
    assert clean.columns == given.columns and clean.count() == given.count()
    placed = P.pack(spark, given, SF).collect()
    assert sum(r.length for r in placed) == sum(len((r.text or "").split()) for r in given.collect())
    assert all(r.bin_length in packing.LENGTHS for r in placed)


def test_run(spark, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 2)
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and {"doc_id", "bin", "offset", "length"} <= set(got.columns)


def test_run_of_nothing_and_of_nulls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for name, rows in (("none", docs.limit(0)), ("nulls", spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0)], SCHEMA))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.where("doc_id < 0").write.parquet(f"{folder}/labels.parquet")
        assert P.run(spark, folder).count() == 0
        for _, stage in P.STAGES:
            assert stage(spark, rows, folder).count() <= rows.count()


def test_stages_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    given = spark.createDataFrame(texts(), SCHEMA)
    names = ["_rid", "_th", "_spans", "row", "spans", "rid", "th", "key", "score", "predicted", "place", "block", "part", "root", "node", "n", "h", "parcel"]
    odd = given.withColumns({c: F.lit("x") for c in names})
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        assert all(r[c] == "x" for r in got.collect() for c in names), name
    assert P.pack(spark, odd, SF).count() == P.pack(spark, given, SF).count()
