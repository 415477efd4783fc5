"""Column profile with exact quartiles, and repeatable samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

PROBABILITIES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each value occurs. Equal values merge before the shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_ranks(values: DataFrame, wanted: dict[str, list[int]], ranges: int = 1024) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of each column, from counts alone.

    Each pass is one job for all columns: it counts the values inside the ranges that still hold a wanted rank,
    cut into ``ranges`` parts, and goes on in the part that has it. Nothing is ordered, and no task holds
    more than counts; at most ``ranges`` rows per rank come back.
    """
    spark = values.sparkSession
    extent = {r["column_name"]: (r["low"], r["high"]) for r in values.groupBy("column_name").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    state = {(c, k): (*extent[c], 0) for c, ranks in wanted.items() for k in ranks}
    while open_ := [(c, k, low, high) for (c, k), (low, high, _) in state.items() if low < high]:
        asked = spark.createDataFrame(open_, "column_name string, rank long, low double, high double")
        width = (F.col("high") - F.col("low")) / ranges
        # a range too narrow, or too wide, to be cut evenly: its least value against the rest
        even = (width > 0) & (width < float("inf"))
        part = F.when(even, F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(ranges - 1))).otherwise((F.col("value") > F.col("low")).cast("long"))
        inside = values.join(F.broadcast(asked), "column_name").filter("value between low and high")  # a row per open rank
        counts = inside.groupBy("column_name", "rank", part.alias("part")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        found = set()
        for r in sorted(counts.collect(), key=lambda r: (r["column_name"], r["rank"], r["part"])):
            key = r["column_name"], r["rank"]
            if key in found:
                continue
            low, high, below = state[key]
            if r["rank"] < below + r["n"]:
                state[key] = (r["low"], r["high"], below)
                found.add(key)
            else:
                state[key] = (low, high, below + r["n"])
    return {key: low for key, (low, _, _) in state.items()}


def exact_quantiles(values: DataFrame, sizes: dict[str, int]) -> dict[str, dict[str, float]]:
    """Exact linear-interpolated quartiles per column; ``sizes`` is the number of values of each."""
    at = {c: {name: p * (n - 1) for name, p in PROBABILITIES.items()} for c, n in sizes.items()}
    found = exact_ranks(values, {c: sorted({int(f(x)) for x in own.values() for f in (math.floor, math.ceil)}) for c, own in at.items()})
    out = {}
    for c, own in at.items():
        ends = {name: (found[c, math.floor(x)], found[c, math.ceil(x)]) for name, x in own.items()}
        out[c] = {name: low + (high - low) * (own[name] - math.floor(own[name])) if low != high else low for name, (low, high) in ends.items()}
    return out


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row per column; a NaN is no value.

    The table is read once, into counts per value; all figures come from these.
    """
    values = cut_lineage(column_values(df, columns))
    n, v = F.col("n"), F.col("value")
    # One row per profiled column comes back.
    basics = values.groupBy("column_name").agg(
        F.sum("n").alias("n_values"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    ).collect()
    means = df.sparkSession.createDataFrame([(r["column_name"], r["mean"]) for r in basics], "column_name string, mean double")
    # Second pass over the counts, around the mean, so that large values do not cancel.
    squares = values.join(F.broadcast(means), "column_name").groupBy("column_name").agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("s")).collect()
    around = {r["column_name"]: r["s"] for r in squares}
    quartiles = exact_quantiles(values, {r["column_name"]: r["n_values"] for r in basics})
    rows = [
        (r["column_name"], r["n_values"], r["mean"], math.sqrt(around[c] / (r["n_values"] - 1)) if r["n_values"] > 1 else None, r["min"], *(quartiles[c][q] for q in PROBABILITIES), r["max"])
        for r in basics for c in [r["column_name"]]
    ]
    names = ("mean", "std", "min", *PROBABILITIES, "max")
    table = df.sparkSession.createDataFrame(rows, f"column_name string, n_values long, {', '.join(f'{c} double' for c in names)}")
    return table.select("column_name", "n_values", *[F.round(c, digits).alias(c) for c in names])


def sample_rows(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """``k`` rows in pseudo-random order of a hash of the key: the same rows whatever the partitioning."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(k)


def sample_fractions(df: DataFrame, by: str, fractions: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """The share ``fractions[value]`` of the rows of each value of ``by``; values that are not named have none.

    A row is in the sample if a hash of its key is below its share, so the sample needs no shuffle, is the same
    whatever the partitioning, and a larger share holds the smaller one's rows.
    """
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    bounds = F.coalesce(*[F.when(F.col(by) == value, F.lit(round(share * 2**32))) for value, share in fractions.items()], F.lit(0))
    return df.filter(place < bounds)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)
