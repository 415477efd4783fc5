"""One key holding a third of all rows: whole results, and plans that combine before they shuffle."""

from pyspark.sql import functions as F

from fathomline.operators import correlation, filings as fl, series as se, stores

N = 60_000


def skewed(spark):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(N, numPartitions=16).withColumn("key", key.cast("string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_series(spark):
    obs = skewed(spark).select(
        F.col("key").alias("series_id"),
        F.expr("date_add(date'2020-01-01', cast(id % 700 as int))").alias("obs_date"),
        F.col("id").cast("double").alias("value"),
        F.col("id").alias("tie"),
    )
    got = se.monthly_last(obs, ("tie",))
    pdf = obs.toPandas()
    pdf["month"] = pdf["obs_date"].astype("datetime64[ns]").dt.to_period("M").dt.end_time.dt.date
    want = pdf.sort_values(["obs_date", "tie"]).groupby(["series_id", "month"])["value"].last()
    rows = {(r["series_id"], r["month"]): r["value"] for r in got.collect()}
    assert rows == want.to_dict()
    assert "partial_max_by" in plan_of(got) and "SortAggregate" not in plan_of(got)


def test_hot_upsert_key(spark):
    batch = skewed(spark).select("key", "id")
    got = stores.keep_last(batch, ["key"], [F.col("id")])
    want = batch.groupBy("key").agg(F.max("id").alias("id"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert "partial_max_by" in plan_of(got)


def test_hot_section_and_hot_company_are_cut_before_the_shuffle(spark):
    rows = skewed(spark)
    chunks = rows.select(
        F.col("key").alias("accession_number"), F.lit("s").alias("section"),
        F.col("id").cast("int").alias("chunk_index"), F.col("id").cast("string").alias("document"),
    )
    text = stores.section_text(chunks, max_chunks=5)
    assert text.filter("accession_number = '0'").first()["text"].split("\n\n") == ["0", "3", "6", "9", "12"]
    filings = rows.select(
        F.lpad("key", 10, "0").alias("cik"), F.lit("10-K").alias("form_type"), F.lit("1-2-3").alias("accession_number"),
        F.lit("d.htm").alias("primary_document"), F.col("id").alias("pos"),
    )
    first = fl.first_filings(filings, limit=2)
    assert sorted(r["pos"] for r in first.filter("cik = '0000000000'").collect()) == [0, 3]
    for df in (text, first):
        plan = plan_of(df)
        assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_correlation_is_one_partial_aggregate(spark):
    df = skewed(spark).select(F.col("id").cast("double").alias("compound"), (-F.col("id")).cast("double").alias("x"))
    table = correlation.correlation_table(df)
    assert table.first()["correlation"] == -1.0 and plan_of(table).count("SinglePartition") == 1
