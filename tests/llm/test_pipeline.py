"""The registered queries and the pipeline over the small tables."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from sqlcheck import compare, connect

import corpus_pipeline
from fathomline.llm import decontamination as dc, line_dedup as ld, minhash_dedup as mh, packing, quality as ql, queries


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SMALL), queries.registered()[name], queries.statements()[name], SMALL) is None


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_span_dedup", "op3_language_id", "op6_quality"])
def test_query_returns_a_row_per_document(spark, name):
    got = queries.registered()[name](spark, SMALL)
    assert got.count() == got.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "minhash_dedup", "decontamination", "packing"]

    good = stages["quality"](spark, docs, SMALL).cache()
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    right = [(k in ids) == (q == 1) for k, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    lines = stages["line_dedup"](spark, good, SMALL).cache()
    assert lines.columns == docs.columns and lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    clean = ld.deduplicate(good, keep_first=True).where("__n_removed = 0").select("doc_id", "text")
    assert clean.join(lines, ["doc_id", "text"], "left_anti").count() == 0

    single = stages["minhash_dedup"](spark, lines, SMALL).cache()
    found = mh.groups(lines).where("kept").select("doc_id")
    assert single.columns == docs.columns and sorted(single.select("doc_id").collect()) == sorted(found.distinct().collect())

    rest = stages["decontamination"](spark, single, SMALL).cache()
    bad = dc.contamination(single, bench).where("contaminated").select("doc_id")
    assert rest.columns == docs.columns and rest.count() == single.count() - bad.count() and rest.join(bad, "doc_id").count() == 0

    packed = stages["packing"](spark, rest, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0
    assert packed.select("doc_id").distinct().count() == rest.select("doc_id").distinct().count()


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count() > 0


def test_unlabelled_corpora_are_kept(spark, monkeypatch):
    monkeypatch.setattr(ql, "train", lambda *a: None)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert corpus_pipeline.keep_quality(spark, docs, SMALL).count() == docs.count()


def test_stages_on_odd_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "s", 0), (-6, None, "de", None, None)], docs.schema)
    names = ["__id", "__hash", "__doc", "__score", "__n_removed", "key", "digest", "text_hash"]
    given = docs.union(odd).union(docs.limit(5)).withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, given, SMALL).cache()
        assert got.columns == given.columns, name
        assert got.where(" or ".join(f"{c} <> 'own {c}'" for c in names)).count() == 0, name
        assert stage(spark, given.limit(0), SMALL).count() == 0, name
    packed = corpus_pipeline.pack_sequences(spark, given, SMALL)
    assert packed.select("doc_id").distinct().count() == given.select("doc_id").distinct().count()
    assert corpus_pipeline.pack_sequences(spark, given.limit(0), SMALL).count() == 0
