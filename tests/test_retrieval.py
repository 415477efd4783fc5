import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from fathomline.functions import vectors as vx
from fathomline.operators import embedding, retrieval as rt
from fathomline.plans.ask import ask


def test_vector_measures(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [-1.0, -2.0, -3.0], [0.0] * 3)], "a array<float>, b array<float>, c array<float>, z array<float>")
    a, b, c, z = map(F.col, "abcz")
    row = df.select(vx.dot(a, a), vx.dot(a, b), vx.dot(a, c), vx.cosine(a, a), vx.cosine(a, b), vx.cosine(a, c), vx.cosine(a, z)).first()
    assert list(row[:3]) == [14.0, 32.0, -14.0]
    assert row[3] == pytest.approx(1) and row[4] == pytest.approx(32 / math.sqrt(1078)) and row[5] == pytest.approx(-1) and row[6] is None


def test_vector_text_round_trip(spark):
    assert one(spark, "[1.5  -2\n 3]", vx.text_to_vector(F.col("x"))) == [1.5, -2.0, 3.0]
    assert one(spark, [1.5, -2.0], vx.text_to_vector(vx.vector_to_text(F.col("x"))), "array<float>") == [1.5, -2.0]


def brute(q, c, k):
    """Best k by rounded cosine, ties by id."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(unit(q) @ unit(c).T, 9)
    return {(i, j): r + 1 for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k])}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(900, 16)).astype(np.float32)
    c[200:500] = c[7]  # a third of the rows are copies
    q = np.vstack([rng.normal(size=(5, 16)), c[7] + 0.01]).astype(np.float32)
    frame = lambda m, n: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{n} long, embedding array<float>"
    )
    return q, c, frame(q, "query_id"), frame(c, "chunk_id").repartition(6)


def as_ranks(df):
    return {(r["query_id"], r["chunk_id"]): r["rank"] for r in df.collect()}


def test_exact_topk_with_copies(spark, vectors):
    q, c, qdf, cdf = vectors
    assert as_ranks(rt.exact_topk(qdf, cdf, 7)) == brute(q, c, 7)


def test_exact_topk_in_query_blocks(spark, vectors, monkeypatch):
    q, c, qdf, cdf = vectors
    monkeypatch.setattr(rt, "BLOCK_BYTES", 16 * 8 * 2)
    assert as_ranks(rt.exact_topk(qdf, cdf, 4)) == brute(q, c, 4)


def test_topk_plan_shuffles_no_pairs(spark, vectors):
    _, _, qdf, cdf = vectors
    plan = rt.exact_topk(qdf, cdf, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_unusable_vectors_are_left_out(spark):
    cands = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert as_ranks(rt.exact_topk(asked, cands, 5)) == {(0, 1): 1, (0, 4): 2}
    assert rt.exact_topk(asked.limit(0), cands, 5).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="different lengths"):
        rt.exact_topk(mixed, cands, 5)


def test_single_vector(spark, vectors):
    _, c, _, cdf = vectors
    top = [r["chunk_id"] for r in rt.nearest(cdf, [float(x) for x in c[3]], 1).collect()]
    assert top == [int(np.argmax(c.astype(float) @ c[3].astype(float)))]


def test_many_questions_read_candidates_once(spark, vectors, monkeypatch):
    q, c, qdf, cdf = vectors
    monkeypatch.setattr(rt, "BLOCK_BYTES", 16 * 8 * 2)
    encoded = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def encode(v):
        encoded.add(1)
        return v

    spark.conf.set("spark.sql.adaptive.enabled", "true")
    once = cdf.withColumn("embedding", encode("embedding")).withColumn("tag", F.when(F.col("chunk_id") % 2 == 0, "even").otherwise("odd"))
    asked = qdf.withColumn("tags", F.when(F.col("query_id") > 2, F.array(F.lit("even"))))
    found = rt.exact_topk(asked, once, 4, filters=[("tags", "tag")]).collect()
    assert encoded.value == len(c)
    want = brute(q, c, 4)
    assert {(r["query_id"], r["chunk_id"]): r["rank"] for r in found if r["query_id"] <= 2} == {k: v for k, v in want.items() if k[0] <= 2}
    assert all(r["chunk_id"] % 2 == 0 for r in found if r["query_id"] > 2)


def test_rejected_vectors_are_named(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "chunk_id long, embedding array<float>")
    assert {tuple(r) for r in rt.rejected_vectors(rows, 2).collect()} == {(2, "no vector"), (3, "length 1")}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    base = centres[rng.integers(30, size=1500)] + 0.6 * rng.normal(size=(1500, 32))
    base[500:1000] = base[3]  # a third of the rows are copies
    q = base[::30] + 0.1 * rng.normal(size=(50, 32))
    frame = lambda m, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{n} long, embedding array<float>")
    odd = spark.createDataFrame([(9001, None), (9002, [1.0])], "chunk_id long, embedding array<float>")
    return q, base, frame(q, "query_id"), frame(base, "chunk_id").union(odd).repartition(5)


def test_index_finds_neighbours(spark, clustered, tmp_path):
    q, base, qdf, cdf = clustered
    centroids = rt.fit_cells(cdf)
    index = rt.write_cells(rt.with_cells(cdf, centroids), str(tmp_path / "index"))
    assert index.count() == cdf.count() and len(list((tmp_path / "index").glob("cell=*"))) > 10
    exact = rt.exact_topk(qdf, cdf, 6)
    probes = rt.tuned_probes(cdf, index, centroids)
    r = rt.recall(rt.cells_topk(qdf, index, centroids, 6, probes), exact).first()
    assert r["wanted"] == 300 and r["recall"] >= 0.9 and probes < len(centroids) / 2
    plan = rt.cells_topk(qdf.limit(1), index, centroids, 6, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:60]
    assert rt.cells_topk(qdf.limit(0), index, centroids).count() == 0


def test_all_cells_probed_are_exact_search(spark, clustered, monkeypatch):
    q, base, qdf, cdf = clustered
    monkeypatch.setattr(rt, "CELL_ROWS", 64)  # the cell of the copies is split
    monkeypatch.setattr(rt, "BLOCK_BYTES", 32 * 8 * 7)
    centroids = rt.fit_cells(cdf, cells=8)
    found = rt.cells_topk(qdf, rt.with_cells(cdf, centroids), centroids, 6, probes=8)
    assert as_ranks(found) == as_ranks(rt.exact_topk(qdf, cdf, 6))


QUESTIONS = "query_id long, question string, tickers array<string>, sections array<string>, form_types array<string>, date_start string, date_end string"


@pytest.fixture(scope="module")
def store(spark):
    words = ["revenue grew", "risk of loss", "interest rates rose", "new product launch"]
    rows = [
        (f"c{i:02d}", f"{words[i % 4]} in year {i}", f"T{i % 3}", f"Co {i % 3}", f"20{10 + i}-05-01" if i != 5 else None, "10-K" if i % 2 else "10-Q", "mda" if i < 10 else "risk", f"a{i}")
        for i in range(20)
    ]
    df = spark.createDataFrame(rows, "chunk_id string, document string, ticker string, company_name string, filing_date string, form_type string, section string, accession_number string")
    return embedding.hashed_embedding(df, "document", 64)


def question(spark, **fields):
    names = ["query_id", "question", "tickers", "sections", "form_types", "date_start", "date_end"]
    row = {"query_id": 1, "question": "revenue grew", **fields}
    return spark.createDataFrame([tuple(row.get(n) for n in names)], QUESTIONS)


def search(spark, store, k=6, mode="post", **fields):
    q = embedding.hashed_embedding(question(spark, **fields), "question", 64)
    return rt.search(q, store, k, date_mode=mode).orderBy("rank").collect()


def test_filters_apply_before_the_search(spark, store):
    rows = search(spark, store, tickers=["t1"], form_types=["10-K"])
    assert rows and all(r["ticker"] == "T1" and r["form_type"] == "10-K" for r in rows)
    assert {r["section"] for r in search(spark, store, sections=["risk"], k=20)} == {"risk"}
    assert len(search(spark, store, k=20, tickers=[])) == 20


def test_date_modes(spark, store):
    post = search(spark, store, date_start="2012-01-01", date_end="2016-12-31")
    pre = search(spark, store, mode="pre", date_start="2012-01-01", date_end="2016-12-31")
    assert len(post) < 6 == len(pre) or len(pre) == 4
    inside = lambda rows: all("2012-01-01" <= r["filing_date"] <= "2016-12-31" for r in rows)
    assert inside(post) and inside(pre)


def test_missing_date_bounds(spark):
    df = spark.createDataFrame([("a", None), ("b", "2020-01-01")], "id string, filing_date string")
    ids = lambda **b: {r["id"] for r in rt.date_filter(df, **b).collect()}
    assert ids(start="2019-01-01") == {"b"} and ids(end="2021-01-01") == {"a", "b"} and ids() == {"a", "b"}


def test_predicate_builder(spark, store):
    assert rt.metadata_filter() is None
    assert store.filter(rt.metadata_filter(["t0"], ["mda"])).select("ticker").distinct().count() == 1
    assert store.filter(rt.metadata_filter(["t0", "t2"])).count() == 13


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "a" * 2400), (1, 2, "b" * 2800), (1, 3, "c" * 400), (2, 1, "d" * 9000)], "query_id long, rank int, document string")
    marked = rt.within_budget(df)
    assert [r["in_context"] for r in marked.orderBy("query_id", "rank").collect()] == [True, False, False, False]
    got = {r["query_id"]: r["context"] for r in rt.contexts(marked).collect()}
    assert got == {1: "a" * 2400, 2: ""}


def test_ask(spark, store):
    asked = question(spark).unionByName(question(spark, query_id=2, tickers=["none"]))
    encode = lambda df, text: embedding.hashed_embedding(df, text, 64)
    rows = {r["query_id"]: r for r in ask(asked, store, k=3, encode=encode).collect()}
    assert "revenue grew" in rows[1]["context"] and rows[1]["prompt"].endswith("Question: revenue grew\n\nAnswer:")
    assert len(rows[1]["sources"]) == 3 and rows[1]["sources"][0]["ticker"].startswith("T")
    assert rows[2]["context"] == "" and rows[2]["sources"] is None


def test_model_hook(spark):
    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("abc",)], "t string")
    rows = embedding.model_embedding(df, "t", make, batch_size=1).collect()
    assert {r["t"]: r["embedding"] for r in rows} == {"ab": [2.0, 1.0], "abc": [3.0, 1.0]}


def test_idf_weights_and_random_vectors(spark):
    df = spark.createDataFrame([("a b",), ("a c",)], "t string")
    v = embedding.hashed_embedding(df, "t", 128, idf=True).first()["embedding"]
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert embedding.random_vectors(spark, 5, 8).select(F.size("embedding").alias("n")).first()["n"] == 8
