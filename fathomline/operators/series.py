"""Economic series: monthly values, gap filling, change features, panel, summaries.

Series stay long (series, month, value) until the last step. The only step over raw rows
is one aggregate per (series, month) with a map-side combine, so a series that holds a
large share of the rows costs no more than any other; everything after it sees at most
one row per series and calendar month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import stats as st
from ..functions.lookup import lookup


def observations(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows inside the inclusive date bounds that are given; the filter reaches the scan."""
    keep = F.col("obs_date") >= F.lit(start).cast("date") if start else F.col("obs_date").isNotNull()
    if end:
        keep = keep & (F.col("obs_date") <= F.lit(end).cast("date"))
    return df.filter(keep)


def monthly_last(obs: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Last non-null value of each (series, month); months that hold only nulls stay as null.

    A series has one reading per date, or ``tie_break`` columns say which one is last. Ties
    are settled per date first: orders of plain types then keep both steps hash aggregates,
    where one order of (date, tie) pairs would sort all raw rows.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = obs.select("series_id", "obs_date", *tie_break, value.alias("value"))
    present = F.col("value").isNotNull()
    if tie_break:
        order = F.col(tie_break[0]) if len(tie_break) == 1 else F.struct(*tie_break)
        rows = rows.groupBy("series_id", "obs_date").agg(
            F.max_by("value", F.when(present, order)).alias("value")
        )
    return rows.groupBy("series_id", F.last_day("obs_date").alias("month")).agg(
        F.max_by("value", F.when(present, F.col("obs_date"))).alias("value")
    )


def _months_apart(later: Column, earlier: Column) -> Column:
    return (
        (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    ).cast("int")


def fill_months(monthly: DataFrame, limit: int = 3) -> DataFrame:
    """A row for every month of a series' own span, with gaps filled for up to ``limit`` months.

    Each month is stretched to the month before the next one, so the calendar needs no join.
    ``limit=0`` only makes the calendar dense.
    """
    w = Window.partitionBy("series_id").orderBy("month")
    has = F.col("value").isNotNull()
    spans = monthly.select(
        "series_id",
        "month",
        "value",
        F.last(F.when(has, F.col("value")), ignorenulls=True).over(w).alias("_seen"),
        F.last(F.when(has, F.col("month")), ignorenulls=True).over(w).alias("_seen_at"),
        F.coalesce(_months_apart(F.lead("month").over(w), F.col("month")), F.lit(1)).alias("_gap"),
    )
    steps = spans.select("*", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)).alias("_step"))
    month = F.last_day(F.add_months(F.trunc("month", "MM"), F.col("_step")))
    age = F.col("_step") + _months_apart(F.col("month"), F.col("_seen_at"))
    return steps.select(
        "series_id",
        month.alias("month"),
        F.when(age <= limit, F.col("_seen")).alias("value"),
    )


def monthly_series(obs: DataFrame, limit: int = 3, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Raw observations to dense, gap-filled months."""
    return fill_months(monthly_last(obs, tie_break), limit)


def month_calendar(obs: DataFrame) -> DataFrame:
    """Every month inside some series' span, ranked. Its size is bounded by the calendar."""
    spans = obs.groupBy("series_id").agg(
        F.min(F.trunc("obs_date", "MM")).alias("lo"), F.max(F.trunc("obs_date", "MM")).alias("hi")
    )
    months = spans.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")
    ).distinct()
    ranked = months.agg(F.array_sort(F.collect_set(F.last_day("m"))).alias("months"))
    return ranked.select(
        F.posexplode("months").alias("rank", "month"), F.size("months").alias("n_months")
    )


def change_features(filled: DataFrame, calendar: DataFrame, pad: bool = True) -> DataFrame:
    """Year-over-year and month-over-month percent change per series, over the joint calendar.

    ``pad`` carries the last value over nulls before the change is taken, up to the end of
    the calendar. A zero base gives null.
    """
    w = Window.partitionBy("series_id").orderBy("rank")
    cal = F.broadcast(calendar)
    ranked = filled.join(cal, "month").select(
        "series_id",
        "rank",
        "value",
        (F.coalesce(F.lead("rank").over(w), F.col("n_months")) - F.col("rank")).alias("_gap"),
    )
    dense = ranked.select(
        "series_id", "value", "rank", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)).alias("_step")
    ).select(
        "series_id",
        (F.col("rank") + F.col("_step")).alias("rank"),
        F.when(F.col("_step") == 0, F.col("value")).alias("value"),
    )
    base = dense.withColumn(
        "_f", F.last("value", ignorenulls=True).over(w) if pad else F.col("value")
    )

    def change(lag: int) -> Column:
        return (F.try_divide(F.col("_f"), F.lag("_f", lag).over(w)) - 1) * 100

    return (
        base.select("series_id", "rank", "value", change(12).alias("yoy"), change(1).alias("mom"))
        .join(F.broadcast(calendar.select("rank", "month")), "rank")
        .select("series_id", "month", "value", "yoy", "mom")
    )


def macro_features(
    obs: DataFrame, limit: int = 3, pad: bool = True, tie_break: tuple[str, ...] = ()
) -> DataFrame:
    """Long panel: (series, month, value, yoy, mom)."""
    return change_features(monthly_series(obs, limit, tie_break), month_calendar(obs), pad)


def pivot_panel(
    features: DataFrame, ids: list[str], spread: tuple[str, str, str] | None = ("yield_curve", "GS10", "GS2")
) -> DataFrame:
    """Wide panel, one row per month, in a single shuffle; ``spread`` is (name, minuend, subtrahend)."""
    if not ids:
        raise ValueError("a panel needs at least one series")

    def pick(sid: str, col: str) -> Column:
        return F.max(F.when(F.col("series_id") == sid, F.col(col)))

    raw = [pick(s, "value").alias(s) for s in ids]
    derived = [pick(s, c).alias(f"{s}_{c}") for s in ids for c in ("yoy", "mom")]
    wide = features.groupBy(F.col("month").alias("date")).agg(*raw, *derived)
    return with_spread(wide, *spread) if spread else wide


def with_spread(panel: DataFrame, name: str, minuend: str, subtrahend: str) -> DataFrame:
    """Adds ``name`` where both columns exist."""
    if minuend in panel.columns and subtrahend in panel.columns:
        return panel.withColumn(name, F.col(f"`{minuend}`") - F.col(f"`{subtrahend}`"))
    return panel


def macro_panel(
    obs: DataFrame,
    ids: list[str] | None = None,
    spread: tuple[str, str, str] | None = ("yield_curve", "GS10", "GS2"),
    limit: int = 3,
    pad: bool = True,
    tie_break: tuple[str, ...] = (),
) -> DataFrame:
    """Observations to the wide panel with change and spread columns."""
    ids = list(ids or fv.SERIES)
    chosen = obs.filter(F.col("series_id").isin(ids))
    return pivot_panel(macro_features(chosen, limit, pad, tie_break), ids, spread)


def add_panel_features(panel: DataFrame, pad: bool = True) -> DataFrame:
    """Change columns for an existing wide panel; columns that are features already are left alone."""
    ids = [
        c for c in panel.columns
        if c not in ("date", "yield_curve") and not c.endswith(("_yoy", "_mom", "_yield_curve"))
    ]
    pairs = F.array(*[F.struct(F.lit(c).alias("series_id"), F.col(f"`{c}`").cast("double").alias("value")) for c in ids])
    long = panel.select(F.col("date").cast("date").alias("month"), F.inline(pairs))
    # One row per month, so ranking the dates is bounded by the calendar.
    ranked = panel.agg(F.array_sort(F.collect_set(F.col("date").cast("date"))).alias("months")).select(
        F.posexplode("months").alias("rank", "month"), F.size("months").alias("n_months")
    )
    features = change_features(long, ranked, pad)
    wide = features.groupBy("month").agg(
        *[
            F.max(F.when(F.col("series_id") == s, F.col(c))).alias(f"{s}_{c}")
            for s in ids
            for c in ("yoy", "mom")
        ]
    )
    kept = panel.drop(*[f"{s}_{c}" for s in ids for c in ("yoy", "mom")])
    out = kept.join(wide, F.col("date").cast("date") == F.col("month"), "left").drop("month")
    return with_spread(out, "yield_curve", "GS10", "GS2")


def slice_panel(panel: DataFrame, ids: list[str], start: str, end: str) -> DataFrame:
    """Chosen columns inside inclusive dates, without rows that hold none of them."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return panel.filter(inside).select("date", *[f"`{i}`" for i in ids]).dropna(how="all", subset=ids)


def category_ids(panel: DataFrame, category: str, catalog: dict = fv.SERIES) -> list[str]:
    """Series of a category that the panel has."""
    return [s for s, (_, c) in catalog.items() if c == category and s in panel.columns]


def series_names(series_id: Column, catalog: dict = fv.SERIES) -> Column:
    """Display name, or the id itself where the catalog has none."""
    return F.coalesce(lookup(series_id, {s: n for s, (n, _) in catalog.items()}, "string"), series_id)


def series_categories(series_id: Column, catalog: dict = fv.SERIES) -> Column:
    return lookup(series_id, {s: c for s, (_, c) in catalog.items()}, "string")


def date_extent(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def summary_stats(monthly: DataFrame, window_rows: int = 52) -> DataFrame:
    """Latest value, one-month and one-year change, high and low of the last ``window_rows`` values."""
    w = Window.partitionBy("series_id").orderBy(F.col("month").desc())
    recent = (
        monthly.filter(F.col("value").isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= max(window_rows, 13))
    )

    def at(n: int) -> Column:
        return F.max(F.when(F.col("rn") == n, F.col("value")))

    inside = F.when(F.col("rn") <= window_rows, F.col("value"))
    return recent.groupBy("series_id").agg(
        at(1).alias("current"),
        (at(1) - at(2)).alias("change_1m"),
        (at(1) - at(13)).alias("change_1y"),
        F.max(inside).alias("high"),
        F.min(inside).alias("low"),
    )


def summary_table(stats: DataFrame, catalog: dict = fv.SERIES) -> DataFrame:
    """``summary_stats`` in display form."""
    return stats.select(
        series_names(F.col("series_id"), catalog).alias("series"),
        st.fixed3(F.col("current")).alias("current"),
        st.signed(F.col("change_1m")).alias("change_1m"),
        st.signed(F.col("change_1y")).alias("change_1y"),
        st.fixed3(F.col("high")).alias("high"),
        st.fixed3(F.col("low")).alias("low"),
    )


def in_intervals(day: Column, intervals=fv.RECESSIONS) -> Column:
    """Whether a date lies in one of a fixed list of inclusive intervals."""
    hits = [day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in intervals]
    return reduce(lambda x, y: x | y, hits, F.lit(False))


def overlapping_intervals(panel: DataFrame, intervals=fv.RECESSIONS) -> DataFrame:
    """The intervals that overlap the dates the panel covers."""
    shown = F.array(
        *[F.struct(F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end")) for a, b in intervals]
    )
    extent = date_extent(panel)
    return extent.select("date_min", "date_max", F.inline(shown)).filter(
        (F.col("start") <= F.col("date_max")) & (F.col("end") >= F.col("date_min"))
    ).select("start", "end")
