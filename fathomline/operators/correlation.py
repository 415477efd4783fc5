"""Correlation of one column with every other numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as fv
from ..functions import stats as st
from .series import series_names

SKIPPED_SUFFIXES = ("_yoy", "_mom")


def numeric_columns(df: DataFrame, target: str) -> list[str]:
    """Numeric columns to correlate: not the target, not change columns, not a chunk's position."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in (target, "chunk_index")
        and not f.name.endswith(SKIPPED_SUFFIXES)
    ]


def correlation_table(
    df: DataFrame,
    target: str = "compound",
    min_observations: int = 10,
    catalog: dict = fv.SERIES,
) -> DataFrame:
    """(series_id, series_name, correlation, p_value, n_observations), strongest first.

    One pass: a single wide aggregate with partial sums, then one row per column.
    """
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to correlate")
    cols = numeric_columns(df, target)
    empty = "series_id string, series_name string, correlation double, p_value double, n_observations bigint"
    if not cols:
        return df.sparkSession.createDataFrame([], empty)

    def clean(name: str):
        c = F.col(f"`{name}`").cast("double")
        return F.nanvl(c, F.lit(None).cast("double"))

    y = clean(target)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("series_id"),
                st.pearson(y, clean(c)).alias("r"),
                st.pair_count(y, clean(c)).alias("n"),
            ).alias(f"_{i}")
            for i, c in enumerate(cols)
        ]
    )
    rows = wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))
    return (
        rows.filter(F.col("n") >= min_observations)
        .select(
            "series_id",
            series_names(F.col("series_id"), catalog).alias("series_name"),
            F.round("r", 4).alias("correlation"),
            F.round(st.pearson_p_value(F.col("r"), F.col("n")), 6).alias("p_value"),
            F.col("n").alias("n_observations"),
        )
        .orderBy(F.abs("correlation").desc_nulls_last(), "series_id")
    )


def strongest(table: DataFrame, max_series: int = 20) -> DataFrame:
    """The strongest correlations, in signed order."""
    return (
        table.orderBy(F.abs("correlation").desc_nulls_last(), "series_id")
        .limit(max_series)
        .orderBy("correlation", "series_id")
    )


def labelled(table: DataFrame) -> DataFrame:
    """Adds the star label and the sign class of each correlation."""
    return table.withColumn("stars", st.significance(F.col("p_value"))).select(
        "*",
        F.concat_ws(" ", "series_name", "stars").alias("label"),
        F.when(F.col("correlation") < 0, "negative").otherwise("positive").alias("sign"),
    )
