from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import asof, correlation, profile, series as se
from fathomline.functions import stats as st

OBS = "series_id string, obs_date date, value double"


def obs(spark, rows):
    return spark.createDataFrame([(s, date.fromisoformat(d), v) for s, d, v in rows], OBS)


def test_last_reading_of_a_month_and_gap_of_four(spark):
    df = obs(spark, [("A", "2020-01-05", 1.0), ("A", "2020-01-20", 2.0), ("A", "2020-06-10", 9.0)])
    got = [r["value"] for r in se.monthly_series(df).orderBy("month").collect()]
    assert got == [2.0, 2.0, 2.0, 2.0, None, 9.0]
    assert [r["value"] for r in se.monthly_series(df, limit=0).orderBy("month").collect()] == [2.0] + [None] * 4 + [9.0]


def test_null_and_nan_readings_are_missing(spark):
    df = obs(spark, [("A", "2020-01-05", 1.0), ("A", "2020-01-20", None), ("A", "2020-02-01", float("nan")), ("A", "2020-03-01", None)])
    rows = se.monthly_series(df, limit=1).orderBy("month").collect()
    assert [r["value"] for r in rows] == [1.0, 1.0, None]
    assert [r["month"] for r in rows][1] == date(2020, 2, 29)


def test_panel_against_pandas(spark):
    rng = np.random.default_rng(42)
    rows, frames = [], {}
    for sid in ("GS10", "GS2", "GDP"):
        days = sorted(rng.choice(pd.date_range("2015-01-01", "2020-12-31"), 60 if sid == "GDP" else 300, replace=False))
        if sid == "GS2":
            days = [d for d in days if pd.Timestamp(d) > pd.Timestamp("2016-05-01")]
        values = rng.uniform(1, 5, len(days))
        rows += [(sid, str(pd.Timestamp(d).date()), float(v)) for d, v in zip(days, values)]
        raw = pd.Series(values, index=pd.DatetimeIndex(days))
        frames[sid] = raw.resample("ME").last().ffill(limit=3)
    want = pd.DataFrame(frames)
    for sid in list(frames):
        padded = want[sid].ffill()
        want[f"{sid}_yoy"] = (padded / padded.shift(12) - 1) * 100
        want[f"{sid}_mom"] = (padded / padded.shift(1) - 1) * 100
    want["yield_curve"] = want["GS10"] - want["GS2"]
    got = se.macro_panel(obs(spark, rows), ["GS10", "GS2", "GDP"]).orderBy("date").toPandas()
    assert [str(d) for d in got["date"]] == [str(d.date()) for d in want.index]
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_padding_flag_and_zero_base(spark):
    df = obs(spark, [("A", "2020-01-01", 1.0), ("A", "2020-02-01", None), ("A", "2020-03-01", 2.0), ("A", "2020-04-01", None)])
    mom = lambda pad: [r["mom"] for r in se.macro_features(df, limit=0, pad=pad).orderBy("month").collect()]
    assert mom(True) == [None, 0.0, 100.0, 0.0] and mom(False) == [None] * 4
    zero = obs(spark, [("A", "2020-01-01", 0.0), ("A", "2020-02-01", 1.0)])
    assert [r["mom"] for r in se.macro_features(zero).orderBy("month").collect()] == [None, None]


def test_features_of_a_wide_panel(spark):
    wide = spark.createDataFrame(
        [(date(2020, 1, 31), 1.0, 3.0), (date(2020, 2, 29), 2.0, 3.0)], "date date, GS10 double, GS2 double"
    )
    once = se.add_panel_features(wide)
    row = once.orderBy("date").collect()[1]
    assert row["GS10_mom"] == 100.0 and row["GS2_mom"] == 0.0 and row["yield_curve"] == -1.0
    twice = se.add_panel_features(once)
    assert set(twice.columns) == set(once.columns) and "yield_curve" not in se.add_panel_features(wide.drop("GS10")).columns
    assert se.add_panel_features(wide.limit(0)).count() == 0


def test_panel_needs_series(spark):
    with pytest.raises(ValueError):
        se.pivot_panel(obs(spark, []), [])


def test_summary_table(spark):
    months = pd.date_range("2015-01-31", periods=60, freq="ME")
    df = spark.createDataFrame(
        [("GS10", d.date(), float(i)) for i, d in enumerate(months)] + [("GS2", months[0].date(), 1.0), ("DFF", months[0].date(), None)],
        "series_id string, month date, value double",
    )
    rows = {r["series"]: r for r in se.summary_table(se.summary_stats(df)).collect()}
    ten = rows["10Y Treasury Yield"]
    assert (ten["current"], ten["change_1m"], ten["change_1y"], ten["high"], ten["low"]) == ("59.000", "+1.000", "+12.000", "59.000", "8.000")
    assert rows["2Y Treasury Yield"]["change_1m"] == "—" and len(rows) == 2


def test_intervals(spark):
    days = spark.createDataFrame([(date(2008, 1, 31),), (date(2015, 1, 31),)], "date date")
    assert [r[0] for r in days.select(se.in_intervals(F.col("date"))).collect()] == [True, False]
    assert [str(r["start"]) for r in se.overlapping_intervals(days).collect()] == ["2007-12-01"]


def test_asof_before_exact_tie_and_bad_date(spark):
    left = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-31"), ("c", "2021-07-04"), ("d", "nope")], "id string, filing_date string")
    right = spark.createDataFrame(
        [(date(2020, 1, 31), 1, 10.0), (date(2020, 1, 31), 2, 11.0), (date(2020, 9, 30), 1, 12.0)], "macro_date date, seq int, v double"
    )
    got = {r["id"]: r["v"] for r in asof.asof_join(left, right, "filing_date", "macro_date", ["seq"]).collect()}
    assert got == {"a": None, "b": 11.0, "c": 12.0}


def test_asof_against_pandas_and_plan(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"i": range(400), "d": pd.to_datetime("2010-01-01") + pd.to_timedelta(rng.integers(0, 2000, 400), "D")})
    right = pd.DataFrame({"m": pd.to_datetime("2010-06-01") + pd.to_timedelta(rng.choice(1000, 60, replace=False), "D"), "v": rng.normal(size=60)})
    want = pd.merge_asof(left.sort_values("d"), right.sort_values("m"), left_on="d", right_on="m").sort_values("i")
    joined = asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "d", "m")
    got = joined.toPandas().sort_values("i")
    np.testing.assert_allclose(got["v"].astype(float), want["v"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_asof_empty_right(spark):
    left = spark.createDataFrame([("a", "2020-01-01")], "id string, filing_date string")
    right = spark.createDataFrame([], "macro_date date, v double")
    assert asof.asof_join(left, right, "filing_date", "macro_date").collect()[0]["v"] is None


def test_correlation_edges(spark):
    n = 12
    df = spark.createDataFrame(
        [(float(i), float(i * 2), 5.0, float(i) if i < 9 else None, float((i * 7) % 5), 1.0, i, "t") for i in range(n)],
        "compound double, exact double, constant double, few double, noise double, x_yoy double, chunk_index int, s string",
    )
    rows = {r["series_id"]: r for r in correlation.correlation_table(df).collect()}
    assert set(rows) == {"exact", "constant", "noise"}
    assert rows["exact"]["correlation"] == 1.0 and rows["exact"]["p_value"] == 0.0
    assert rows["constant"]["correlation"] is None and rows["constant"]["p_value"] is None
    with pytest.raises(ValueError):
        correlation.correlation_table(df, "missing")
    empty = correlation.correlation_table(df, min_observations=100)
    assert empty.count() == 0 and empty.columns[0] == "series_id"


@pytest.mark.parametrize(
    "r, n, p",
    # Two-sided p of t = r sqrt((n-2)/(1-r^2)), from standard tables.
    [(0.632, 10, 0.05), (0.765, 10, 0.01), (0.444, 20, 0.05), (0.197, 100, 0.0495), (0.0, 50, 1.0)],
)
def test_p_values(spark, r, n, p):
    got = spark.range(1).select(st.pearson_p_value(F.lit(r), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=6e-4)


def test_significance(spark):
    df = spark.createDataFrame([("a", -0.5, 0.0005), ("b", 0.4, 0.04), ("c", 0.1, 0.5)], "series_name string, correlation double, p_value double")
    rows = correlation.labelled(df).collect()
    assert [r["stars"] for r in rows] == ["***", "*", ""] and rows[0]["label"] == "a ***" and rows[0]["sign"] == "negative"


def test_profile_quartiles_are_exact(spark):
    rng = np.random.default_rng(7)
    heavy = np.concatenate([rng.lognormal(3, 2, 3000), np.full(1500, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"a": heavy, "b": rng.integers(0, 5, len(heavy)).astype(float)}))
    got = profile.describe(df, ["a", "b"]).toPandas().set_index("column_name")
    want = pd.DataFrame({"a": heavy, "b": df.toPandas()["b"]}).describe().round(2)
    for c in ("a", "b"):
        for ours, theirs in {"n_values": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}.items():
            assert got.loc[c, ours] == pytest.approx(want.loc[theirs, c], abs=0.011), (c, ours)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = [r["id"] for r in profile.sample_rows(df, 10, "id").collect()]
    assert a == [r["id"] for r in profile.sample_rows(df.repartition(7), 10, "id").collect()] and len(set(a)) == 10


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("inf"), None), (-float("inf"), float("nan")), (2.0, None), (5e-324, None)], "a double, b double")
    got = {r["column_name"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["n_values"], got["a"]["p50"], got["b"]["n_values"], got["b"]["p25"], got["b"]["std"]) == (5, 1.0, 1, 5.0, None)


def test_fractions_by_group(spark):
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    some = {r["id"] for r in profile.sample_fractions(df, "g", {"a": 0.5, "b": 0.1}, "id").collect()}
    assert some == {r["id"] for r in profile.sample_fractions(df.repartition(7), "g", {"b": 0.1, "a": 0.5}, "id").collect()}
    share = [sum(i % 3 == k for i in some) / 6667 for k in range(3)]
    assert abs(share[0] - 0.5) < 0.03 and abs(share[1] - 0.1) < 0.02 and share[2] == 0
    assert some < {r["id"] for r in profile.sample_fractions(df, "g", {"a": 0.7, "b": 1.0}, "id").collect()}
