"""Backward as-of join on dates.

The right side becomes validity intervals [date, next date), spread over month buckets, so
the join is an equality on the bucket plus a range check and never a nested loop. Right
dates are made distinct first: a bucket holds at most 31 candidates, and the whole right
side at most one row per calendar day and month, whatever its row count was. That bound is
what allows the broadcast, so the left side, which may be huge or hold a third of its rows
on one date, is neither shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def day_of(df: DataFrame, name: str) -> Column:
    """A column as a date; unreadable text becomes null."""
    if df.schema[name].dataType.typeName() == "string":
        return F.try_to_timestamp(F.col(name)).cast("date")
    return F.col(name).cast("date")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    right_order: list[str] | None = None,
) -> DataFrame:
    """Each left row with the last right row dated on or before it, or nulls.

    Rows with an unreadable left date are dropped. Among right rows of one date the last by
    ``right_order`` counts, or by all columns if it is not given.
    """
    clash = set(right.columns) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    payload = [F.col(f"`{c}`") for c in right.columns]
    order = F.struct(*right_order) if right_order else F.struct(*payload)
    per_day = (
        right.select(day_of(right, right_on).alias("_from"), F.struct(*payload).alias("_row"), order.alias("_ord"))
        .filter(F.col("_from").isNotNull())
        .groupBy("_from")
        .agg(F.max_by("_row", "_ord").alias("_row"))
    )
    # One row per calendar day is left, so ordering all of them in one window stays small.
    spans = per_day.withColumn("_next", F.lead("_from").over(Window.orderBy("_from")))
    start = F.trunc("_from", "MM")
    # The open last interval needs no end: left dates past it look in its own month.
    stop = F.coalesce(F.trunc("_next", "MM"), start)
    buckets = spans.select(
        F.explode(F.sequence(start, stop, F.expr("interval 1 month"))).alias("_bucket"),
        "_from",
        "_next",
        "_row",
    )
    last = per_day.agg(F.max("_from")).scalar()
    dated = (
        left.withColumn("_day", day_of(left, left_on))
        .filter(F.col("_day").isNotNull())
        .withColumn("_left_bucket", F.trunc(F.least("_day", last), "MM"))
    )
    hit = (
        (F.col("_left_bucket") == F.col("_bucket"))
        & (F.col("_day") >= F.col("_from"))
        & (F.col("_next").isNull() | (F.col("_day") < F.col("_next")))
    )
    return dated.join(F.broadcast(buckets), hit, "left").select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.col(f"_row.`{c}`").alias(c) for c in right.columns],
    )
