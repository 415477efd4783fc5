import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import filings as fl, series, stores, topics
from fathomline.plans import ingest, macro
from fathomline.sources import sinks, tables
from fathomline.streaming import incremental

CHUNK = "chunk_id string, accession_number string, document string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def read(df):
    return {r["chunk_id"]: r["document"] for r in df.collect()}


def test_upsert_batch_wins_and_is_repeatable(spark):
    old = chunks(spark, [("a", "f", "old"), ("b", "f", "old")])
    batch = chunks(spark, [("b", "f", "new"), ("c", "f", "new")])
    once = stores.upsert(old, batch, ["chunk_id"])
    assert read(once) == {"a": "old", "b": "new", "c": "new"}
    assert read(stores.upsert(once, batch, ["chunk_id"])) == read(once)


def test_fewer_chunks_on_a_second_ingest(spark):
    old = chunks(spark, [(str(i), "f", "old") for i in range(5)] + [("x", "g", "old")])
    batch = chunks(spark, [(str(i), "f", "new") for i in range(3)])
    assert stores.upsert_chunks(old, batch).count() == 6
    assert stores.upsert_chunks(old, batch, replace_filing=True).count() == 4


def test_upsert_without_order_refuses_repeated_keys(spark, tmp_path):
    twice = chunks(spark, [("a", "f", "1"), ("a", "f", "2")])
    with pytest.raises(Exception, match="a key repeats"):
        stores.upsert(chunks(spark, []), twice, ["chunk_id"]).collect()
    t = sinks.UpsertTable(spark, str(tmp_path / "t"), ["chunk_id"])
    with pytest.raises(ValueError, match="a key of t repeats"):
        t.upsert(twice)
    assert t.read() is None
    t.upsert(twice, order=["document"])
    assert read(t.read()) == {"a": "2"}


def test_upsert_table_adds_files_only(spark, tmp_path):
    t = sinks.UpsertTable(spark, str(tmp_path / "t"), ["chunk_id"])
    assert t.read() is None
    t.upsert(chunks(spark, [(f"{f}{i}", f, "old") for f in "fgh" for i in range(4)] + [(None, "f", "old")]))
    before = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in (tmp_path / "t").rglob("*.parquet")}
    t.upsert(chunks(spark, [("f0", "f", "new"), ("f0", "f", "newer"), ("f9", "f", "new"), (None, "f", "new")]), order=["document"], run="second")
    got = read(t.read())
    assert len(got) == 14 and got["f0"] == "newer" and got["g0"] == "old" and got[None] == "new"
    t.upsert(chunks(spark, [("f0", "f", "replayed")]), run="second")  # a run counts once
    assert read(t.read()) == got
    t.upsert(chunks(spark, [("f0", "f", "last")]), replace="accession_number")
    assert sorted(k for k in read(t.read()) if k and k.startswith("f")) == ["f0"] and read(t.read())["g1"] == "old"
    assert all((p.stat().st_mtime_ns, p.read_bytes()) == was for p, was in before.items())
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    whole = read(t.read())
    t.compact()
    assert read(t.read()) == whole and t._visible().count() == 1
    t.upsert(chunks(spark, [("g0", "g", "after")]))
    assert read(t.read()) == whole | {"g0": "after"}


def test_uncommitted_runs_are_not_seen(spark, tmp_path):
    t = sinks.UpsertTable(spark, str(tmp_path / "t"), ["chunk_id"])
    t.upsert(chunks(spark, [("a", "f", "seen")]))
    t.append(chunks(spark, [("a", "f", "unseen"), ("b", "f", "unseen")]), "open", replace="accession_number")
    assert read(t.read()) == {"a": "seen"}
    t.log.commit("open", ["t"])
    assert read(t.read()) == {"a": "unseen", "b": "unseen"}


def test_out_of_date_rows_are_found_by_key_alone(spark, tmp_path):
    t = sinks.UpsertTable(spark, str(tmp_path / "t"), ["chunk_id"])
    t.upsert(chunks(spark, [("a", "f", "x")]))
    t.upsert(chunks(spark, [("a", "f", "y")]))
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "document" not in "".join(line for line in plan.split("\n") if "Aggregate" in line)


def test_summary_and_reader(spark):
    df = spark.createDataFrame(
        [("B", "a2", "2021-01-01", "mda", 0, "x"), ("A", "a1", "2020-01-01", "risk", 1, "r1"), ("A", "a1", "2020-01-01", "risk", 0, "r0"), ("A", "a1", "2020-01-01", "mda", 0, "m0"), ("", "a3", "", "", 0, "")],
        "ticker string, accession_number string, filing_date string, section string, chunk_index int, document string",
    ).withColumns({"company_name": F.lit("Co"), "form_type": F.lit("10-K")})
    rows = stores.filing_summary(df).collect()
    assert [(r["ticker"], r["sections"], r["chunk_count"]) for r in rows][:2] == [("B", ["mda"], 1), ("A", ["mda", "risk"], 3)]
    assert [r["sections"] for r in stores.summary_display(stores.filing_summary(df), "A").collect()] == ["mda, risk"]
    assert [r["ticker"] for r in stores.distinct_values(df, "ticker").collect()] == ["A", "B"]
    assert stores.section_text(df, "a1", "risk").first()["text"] == "r0\n\nr1"
    assert stores.section_text(df, "a1", "risk", max_chunks=1).first()["text"] == "r0"
    assert stores.total_chunks(df).first()[0] == 5


def test_vector_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', [0.5, -2.0])], "page_number int, text string, embedding array<float>")
    sinks.write_vectors_csv(df, str(tmp_path / "v"))
    back = tables.vectors_csv(spark, str(tmp_path / "v"), "page_number int, text string, embedding string").first()
    assert tuple(back) == (1, 'a "b"\nc', [0.5, -2.0])


def test_panel_job_and_partial_series_overwrite(spark, tmp_path):
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2021-12-01', interval 1 month)) obs_date")
    obs = days.select(F.lit("GS10").alias("series_id"), "obs_date", F.lit(3.0).alias("value")).unionByName(
        days.select(F.lit("GS2").alias("series_id"), "obs_date", F.lit(1.0).alias("value"))
    )
    obs.write.parquet(str(tmp_path / "obs"))
    panel = macro.build_panel(spark, str(tmp_path / "obs"), str(tmp_path / "out"), ids=["GS10", "GS2"])
    row = panel.orderBy(F.desc("date")).first()
    assert (row["yield_curve"], row["GS2_yoy"], panel.count()) == (2.0, 0.0, 36)
    again = spark.createDataFrame([("GS2", "2022-01-31", 9.0)], "series_id string, month string, value double")
    sinks.write_series(again.withColumn("month", F.col("month").cast("date")), str(tmp_path / "out/series"))
    assert {r["series_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out/series")).groupBy("series_id").count().collect()} == {"GS10": 36, "GS2": 1}
    assert tables.read_if_exists(spark, str(tmp_path / "none")) is None


PARAGRAPH = "The firm sells goods in many places and its revenue went up again. " * 8
HTML = f"<html><body><h2>Item 1. Business</h2><p>{PARAGRAPH}</p><h2>Item 7. Talk</h2><p>{PARAGRAPH} There was fraud.</p></body></html>"


@pytest.fixture()
def landed(spark, tmp_path):
    tickers = {"0": {"cik_str": 320, "ticker": "AAA", "title": "A Inc"}, "1": {"cik_str": 77, "ticker": "bbb", "title": "B Inc"}, "10": {"cik_str": 999, "ticker": "AAA", "title": "Other"}}
    (tmp_path / "tickers.json").write_text(json.dumps(tickers))
    def company(cik, name, forms):
        n = len(forms)
        return {"cik": cik, "name": name, "tickers": [name] if name == "A Inc" else [], "sic": "1", "sicDescription": "d", "stateOfIncorporation": "DE",
                "filings": {"recent": {"form": forms, "accessionNumber": [f"{cik}-20-{i:06d}" for i in range(n)], "filingDate": [f"202{i}-01-01" for i in range(n)], "primaryDocument": [f"d{i}.htm" for i in range(n)]}}}
    (tmp_path / "subs").mkdir()
    (tmp_path / "subs/a.json").write_text(json.dumps(company("0000000320", "A Inc", ["10-K", "8-K", "10-K", "10-K"])))
    (tmp_path / "subs/b.json").write_text(json.dumps(company("0000000077", "B Inc", ["10-Q", "10-K"])))
    return tables.ticker_map(spark, str(tmp_path / "tickers.json")), tables.submissions(spark, str(tmp_path / "subs"))


def requested(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_filing_tables(spark, landed):
    tick, subs = landed
    found, rejected = fl.resolve_tickers(requested(spark, "aaa", "BBB", "zzz"), tick, "pos")
    assert {r["ticker"]: r["cik"] for r in found.collect()} == {"AAA": "0000000320", "BBB": "0000000077"}
    assert [r["ticker"] for r in rejected.collect()] == ["ZZZ"]
    matches = fl.ticker_matches(requested(spark, "aaa", "BBB", "zzz"), tick, "pos")
    assert {r["ticker"]: r["reason"] for r in matches.collect()} == {"AAA": None, "BBB": None, "ZZZ": "unknown ticker"}
    assert matches._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rows = fl.filing_index(subs, "10-K", 2).orderBy("cik", "accession_number").collect()
    assert [r["accession_number"][-6:] for r in rows] == ["000001", "000000", "000002"]
    assert rows[1]["document_url"] == "https://www.sec.gov/Archives/edgar/data/320/000000032020000000/d0.htm"
    info = {r["name"]: r["ticker"] for r in fl.company_info(subs).collect()}
    assert info == {"A Inc": "A Inc", "B Inc": None}


@pytest.mark.parametrize(
    "links, best",
    [
        (["x-index.htm", "a.txt", "g.htm", "123456789012345678.htm", "/d/000032023000077.htm"], "https://www.sec.gov/d/000032023000077.htm"),
        (["g.htm", "123456789012345678.htm"], "https://www.sec.govg.htm".replace("g.htm", "123456789012345678.htm")),
        (["http://h/x.HTML", "y.htm"], "http://h/x.HTML"),
        (["a.pdf"], "fallback"),
    ],
)
def test_link_priority(spark, links, best):
    html = "".join(f"<a class=k href='{h}'>l</a>" for h in links)
    filings = spark.createDataFrame([("0000-320-23000077", "fallback")], "accession_number string, document_url string")
    pages = spark.createDataFrame([("0000-320-23000077", html)], "accession_number string, html string")
    assert fl.primary_documents(filings.withColumn("accession_number", F.lit("00003-2023-000077")), pages.withColumn("accession_number", F.lit("00003-2023-000077"))).first()["resolved_url"] == best


def run_ingest(spark, landed, tmp_path, html, *tickers, **options):
    tick, subs = landed
    return ingest.ingest_filings(spark, requested(spark, *tickers), tick, subs, html, str(tmp_path / "store"), **options)


def test_ingest_job(spark, landed, tmp_path):
    docs = spark.createDataFrame(
        [("0000000320-20-000000", HTML), ("0000000320-20-000002", ""), ("0000000077-20-000001", HTML)], "accession_number string, html string"
    )
    result = run_ingest(spark, landed, tmp_path, docs, "aaa", "zzz")
    assert {r["reason"] for r in result.rejected.collect()} == {"unknown ticker", "no text for 0000000320-20-000002", "no text for 0000000320-20-000003"}
    assert [tuple(r)[:2] for r in result.counts.collect()] == [("0000000320-20-000000", 2)]
    stored = ingest.stored_chunks(spark, str(tmp_path / "store"))
    first = {r["chunk_id"] for r in stored.collect()}
    assert {r["ticker"] for r in stored.collect()} == {"AAA"} and stored.first()["company_name"] == "A Inc"
    scores = {r["section"]: r["compound"] for r in ingest.stored_sentiment(spark, str(tmp_path / "store")).collect()}
    assert scores["mda"] < 0 == scores["business"]
    # A known ticker is skipped, a forced one changes nothing.
    assert run_ingest(spark, landed, tmp_path, docs, "AAA").counts.count() == 0
    run_ingest(spark, landed, tmp_path, docs, "AAA", "bbb", force=True)
    again = ingest.stored_chunks(spark, str(tmp_path / "store"))
    assert first < {r["chunk_id"] for r in again.collect()} and again.count() == 2 * len(first)
    assert ingest.store_overview(again).count() == 2
    # What the first run returned is still readable and the same; sections of all runs are kept.
    assert [r["accession_number"] for r in result.filings.orderBy("accession_number").collect()][0] == "0000000320-20-000000"
    assert result.rejected.count() == 3 and [tuple(r)[:2] for r in result.counts.collect()] == [("0000000320-20-000000", 2)]
    sections = ingest.stored_sections(spark, str(tmp_path / "store"))
    assert {r["accession_number"] for r in sections.collect()} == {"0000000320-20-000000", "0000000077-20-000001"}


def test_ingest_is_repeated_after_a_fault(spark, landed, tmp_path, monkeypatch):
    html = spark.createDataFrame([("0000000320-20-000000", HTML)], "accession_number string, html string")
    store = str(tmp_path / "store")
    score = ingest.sent.score_sections
    monkeypatch.setattr(ingest.sent, "score_sections", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # between chunks and scores
        run_ingest(spark, landed, tmp_path, html, "aaa")
    assert ingest.stored_chunks(spark, store) is ingest.stored_sections(spark, store) is ingest.stored_sentiment(spark, store) is None
    monkeypatch.setattr(ingest.sent, "score_sections", score)
    result = run_ingest(spark, landed, tmp_path, html, "aaa")
    keys = lambda df: sorted(tuple(r) for r in df.select("accession_number", "section").distinct().collect())
    stored = [f(spark, store) for f in (ingest.stored_chunks, ingest.stored_sections, ingest.stored_sentiment)]
    assert keys(stored[0]) == keys(stored[1]) == keys(stored[2]) != []
    assert result.totals == {"filings": 3, "sections": stored[1].count(), "chunks": stored[0].count()}
    assert result.counts.agg(F.sum("n_sections"), F.sum("n_chunks")).first()[:] == (result.totals["sections"], result.totals["chunks"])


def test_ingest_of_many_then_more(spark, tmp_path):
    def landing(first, last):
        (tmp_path / f"subs{first}").mkdir()
        for k in range(first, last):
            recent = {"form": ["10-K"], "accessionNumber": [f"{k:010d}-20-000001"], "filingDate": ["2020-01-01"], "primaryDocument": ["d.htm"]}
            (tmp_path / f"subs{first}/{k}.json").write_text(json.dumps({"cik": f"{k:010d}", "name": f"Co {k}", "tickers": [f"T{k}"], "filings": {"recent": recent}}))
        names = {str(k): {"cik_str": k, "ticker": f"T{k}", "title": f"Co {k}"} for k in range(first, last)}
        (tmp_path / f"names{first}.json").write_text(json.dumps(names))
        html = spark.createDataFrame([(f"{k:010d}-20-000001", HTML) for k in range(first, last)], "accession_number string, html string")
        return tables.ticker_map(spark, str(tmp_path / f"names{first}.json")), tables.submissions(spark, str(tmp_path / f"subs{first}")), html

    store = str(tmp_path / "many")
    results = []
    for first, last in ((1, 101), (101, 151)):
        asked = requested(spark, *(f"T{k}" for k in range(first, last)), "none")
        results.append(ingest.ingest_filings(spark, asked, *landing(first, last), store))
    for result, n in zip(results, (100, 50)):
        assert result.filings.count() == n and result.counts.count() == n
        assert [r["reason"] for r in result.rejected.collect()] == ["unknown ticker"]
    assert ingest.stored_sections(spark, store).select("accession_number").distinct().count() == 150
    assert ingest.stored_chunks(spark, store).select("accession_number").distinct().count() == 150


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("aaa", "A Inc", "1", "10-K", "2020-01-01", "x-1", HTML)], incremental.LANDED)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.landed_filings(spark, str(tmp_path / "in"))
        incremental.chunk_stream(stream, str(tmp_path / "s"), str(tmp_path / "c1")).awaitTermination(120)
        incremental.sentiment_stream(stream, str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination(120)
        rows.withColumn("html", F.lit(HTML.replace("fraud", "growth"))).write.mode("append").parquet(str(tmp_path / "in"))
    chunks_ = ingest.stored_chunks(spark, str(tmp_path / "s"))
    assert chunks_.count() == chunks_.select("chunk_id").distinct().count() > 1
    assert {r["section"]: r["compound"] > 0 for r in ingest.stored_sentiment(spark, str(tmp_path / "s")).collect()}["mda"]


def test_month_stream_equals_the_batch(spark, tmp_path):
    schema = "series_id string, obs_date date, value double"
    batches = [
        [("A", "2020-01-10", 1.0), ("A", "2020-03-05", 3.0), ("B", "2020-02-29", None), ("B", "2020-02-01", float("nan"))],
        [("A", "2020-01-31", 2.0), ("A", "2020-03-01", 9.0), ("B", "2020-04-02", 4.0), (None, "2020-04-02", 7.0)],  # late and early
        [("A", "2020-01-10", 1.0), ("A", "2020-01-31", 2.0), ("B", "2020-02-11", 5.0), ("B", None, 6.0)],  # repeated and late
    ]
    path, store = str(tmp_path / "in"), str(tmp_path / "s")
    assert incremental.stored_months(spark, store) is None
    for batch in batches:
        rows = spark.createDataFrame(batch, "series_id string, obs_date string, value double")
        rows.withColumn("obs_date", F.col("obs_date").cast("date")).coalesce(1).write.mode("append").parquet(path)
        landed = spark.readStream.schema(schema).parquet(path)
        incremental.month_stream(landed, store, str(tmp_path / "c")).awaitTermination(180)
        so_far = spark.read.schema(schema).parquet(path).where("obs_date is not null")
        wanted = series.monthly_last(so_far)
        got = incremental.stored_months(spark, store)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    filled = series.fill_months(got.where("series_id = 'A'"), 3)
    assert [r["value"] for r in filled.orderBy("month").collect()] == [2.0, 2.0, 3.0]


@pytest.fixture(scope="module")
def corpus(spark):
    themes = ["bank loan credit rate deposit", "drug trial patient therapy dose", "oil drill well barrel gas"]
    rows = [(i, f"g{i % 3}", " ".join((themes[i % 3] + " company year ").split() * 6) + f" note{i % 4}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id int, ticker string, text string")


def test_topics(spark, corpus):
    model = topics.fit_topics(corpus, n_topics=3, max_iter=20, perplexity=True)
    found = model.topic_table(spark, 5)
    words = found.select(F.explode("words").alias("w")).filter("w is not null")
    assert found.count() == 3 and not {"company", "year"} & {w for r in words.collect() for w in r["w"].split()}
    assert model.topic_table(spark, 5, n_topics=2).count() == 2 and model.log_perplexity > 0
    mixed = model.transform(corpus)
    total = sum(F.col(f"topic_{i}") for i in range(3))
    assert mixed.filter(F.abs(total - 1) > 1e-6).count() == 0
    lead = model.dominant(corpus)
    per_group = lead.groupBy("ticker").agg(F.countDistinct("topic").alias("n")).collect()
    assert [r["n"] for r in per_group] == [1, 1, 1] and lead.select("topic").distinct().count() == 3
    assert topics.topic_mix(mixed, "ticker").columns == ["ticker", "topic_0", "topic_1", "topic_2"]
    empty = model.transform(spark.createDataFrame([(1, "g", None), (2, "g", "")], "doc_id int, ticker string, text string")).first()
    assert [round(empty[f"topic_{i}"], 6) for i in range(3)] == [0.333333] * 3


def reference_fit(docs, k, passes, seed):
    """Batch variational passes, one document and one round at a time."""
    names = sorted({t for d in docs for t in d})
    psi = lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5
    elog = lambda row: np.exp([psi(x) - psi(sum(row)) for x in row])
    table = np.random.default_rng(seed).gamma(1.0, 1.0, (k, len(names)))
    for _ in range(passes):
        topics_, stats = np.array([elog(row) for row in table]), np.zeros_like(table)
        for d in docs:
            at, w = [names.index(t) for t in d], np.array(list(d.values()))
            shares = np.ones(k)
            for _ in range(100):
                mix = elog(shares)
                new = 1 / k + mix * (topics_[:, at] * (w / (mix @ topics_[:, at]))).sum(axis=1)
                done, shares = np.abs(new - shares).mean() < 1e-3, new
                if done:
                    break
            mix = elog(shares)
            stats[:, at] += mix[:, None] * (w / (mix @ topics_[:, at]))
        table = 1 / k + topics_ * stats
    return names, table


def test_topics_match_a_reference_at_any_partitioning(spark, corpus):
    few = [topics.fit_topics(corpus.repartition(n), n_topics=3, max_iter=4) for n in (2, 7)]
    assert few[0].vocabulary == few[1].vocabulary and np.allclose(few[0].components, few[1].components, rtol=1e-9)
    weights = topics.tfidf_table(corpus, "doc_id").collect()
    docs = {}
    for r in weights:
        docs.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    model = few[0]
    order = {t: i for i, t in enumerate(model.vocabulary)}
    named = [{f"{order[t]:05d}": w for t, w in d.items()} for _, d in sorted(docs.items())]  # in the model's order of terms
    names, want = reference_fit(named, 3, 4, 42)
    assert [int(t) for t in names] == list(range(len(order)))
    assert np.allclose(model.components, want, rtol=1e-4)


def test_topics_need_documents(spark, corpus):
    with pytest.raises(ValueError):
        topics.fit_topics(corpus.limit(0))


def test_terms_skip_stop_words_before_pairing(spark):
    df = spark.createDataFrame([("Net of the company income a x",)], "text string")
    got = df.select(topics.terms(F.col("text"), ["of", "the", "company"]).alias("t")).first()["t"]
    assert got == ["net", "income", "net income"]


def plain_vocabulary(texts, stops, most, min_df=2, max_df=0.9):
    """The leading terms, counted in plain Python."""
    df, total = {}, {}
    for text in texts:
        ws = [w for w in (text or "").lower().split() if len(w) > 1 and w not in stops]
        found = [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]
        for t in found:
            total[t] = total.get(t, 0) + 1
        for t in set(found):
            df[t] = df.get(t, 0) + 1
    fit = [t for t in df if min_df <= df[t] <= max_df * len(texts)]
    return sorted(fit, key=lambda t: (-total[t], t))[:most]


@pytest.mark.parametrize("most", [1, 7, 20, 60, 5000])
def test_vocabulary_keeps_pairs_of_rare_and_of_too_frequent_words(spark, most, monkeypatch):
    rng = random.Random(most)
    pool = [f"w{i}" for i in range(30)] + ["the"] * 3
    texts = ["everywhere always " * 3 + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) + " rare pair" * (i % 3) for i in range(60)]
    texts += ["", None, "everywhere", "twin twin twin"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(topics, "CHUNK_WORDS", 100)
    got = topics.vocabulary(docs, "text", ["the"], max_features=most)[0]
    assert got == plain_vocabulary(texts, {"the"}, most)
    assert most < 5000 or "rare pair" in got and any(t.startswith("always w") for t in got)


def test_pairs_no_leading_term_can_hold_are_not_counted(spark):
    """The count of pairs grew with all pairs of the corpus; it now has those of leading words only."""
    rows = [("lead word " * 5 + " ".join(f"x{i % 50} y{j % 50}" for j in range(i, i + 20)),) for i in range(200)]
    listed = spark.createDataFrame(rows, "text string").select(topics.words(F.col("text"), []).alias("w"))
    found = {r["term"]: (r["df"], r["total"]) for r in topics._totals(listed, ["lead", "word"], ["lead", "word"]).collect()}
    assert found == {None: (200, 0), "lead word": (200, 1000), "word lead": (200, 800)}
    assert topics._totals(listed, ["word"]).filter("term like 'word %'").count() > 10  # any second word


def test_documents_mixed_in_batches_are_mixed_as_alone(spark):
    rng = np.random.default_rng(3)
    table = rng.gamma(1.0, 1.0, (40, 4))
    sizes = [0, 1, 5, 5, 6, 30, 2, 0, 17, 40, 9]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes, w = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in sizes]), rng.random(sum(sizes))
    whole = topics.mixes(starts, codes, w, table, 0.25, 50, 1e-3)
    places = [c.size for _, c, _ in topics._batches(starts, codes, w)]
    assert max(places) <= topics.BATCH_TERMS and sum(places) <= sum(sizes) * 1.25
    for d, n in enumerate(sizes):
        shares, at = np.ones(4) if n else np.full(4, 0.25), slice(starts[d], starts[d + 1])
        for _ in range(50 if n else 0):
            mix = topics.expected(shares[None])[0]
            new = 0.25 + mix * ((w[at] / (table[codes[at]] @ mix)) @ table[codes[at]])
            done, shares = np.abs(new - shares).mean() < 1e-3, new
            if done:
                break
        assert np.allclose(whole[d], shares, rtol=1e-9)


def test_terms_are_counted_by_columns_of_words(spark):
    vocab, idf = ["b", "a b", "a", "c a"], np.array([1.0, 2.0, 3.0, 4.0])
    import pyarrow as pa

    lists = pa.array([["a", "b", "a", "b"], None, ["c", "zz", "a"], ["c"], ["a"], ["b", "c", "a"]])
    ((rows, flat, owner),) = topics._chunks(lists)
    starts, codes, tf, w = topics._weigher(vocab, idf)(flat, owner, rows.stop)
    got = [dict(zip(codes[a:b].tolist(), tf[a:b].tolist())) for a, b in zip(starts, starts[1:])]
    assert got == [{0: 2, 1: 2, 2: 2}, {}, {2: 1}, {}, {2: 1}, {0: 1, 2: 1, 3: 1}]
    assert np.allclose([(w[a:b] ** 2).sum() for a, b in zip(starts, starts[1:])], [1, 0, 1, 0, 1, 1])
