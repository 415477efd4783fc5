"""Landed observations to the stored macro panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..operators import series
from ..sources import sinks, tables


def build_panel(
    spark: SparkSession,
    observations_path: str,
    store: str,
    start: str | None = None,
    end: str | None = None,
    ids: list[str] | None = None,
) -> DataFrame:
    """Writes the monthly series and the panel; returns the panel as stored."""
    obs = tables.observations(spark, observations_path, start, end)
    ids = list(ids or fv.SERIES)
    obs = obs.filter(F.col("series_id").isin(ids))
    sinks.write_series(series.monthly_series(obs), f"{store}/series")
    # The stored months carry all the panel needs: they are dense within each series' span.
    stored = spark.read.parquet(f"{store}/series").filter(
        F.col("series_id").cast("string").isin(ids)
    )
    calendar = series.month_calendar(stored.withColumnRenamed("month", "obs_date"))
    features = series.change_features(stored.select("series_id", "month", "value"), calendar)
    sinks.write_panel(series.pivot_panel(features, ids).orderBy("date"), f"{store}/panel")
    panel = tables.read_if_exists(spark, f"{store}/panel")
    if panel is None or panel.isEmpty():
        raise ValueError("no series had observations")
    return panel
