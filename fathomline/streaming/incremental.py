"""Filings and observations that keep arriving, upserted batch by batch."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fv
from ..operators import documents as docs, embedding, sentiment as sent
from ..sources import sinks

# Landed filings: metadata and HTML in one row.
LANDED = (
    "ticker string, company_name string, cik string, form_type string, filing_date string, "
    "accession_number string, html string"
)


def landed_filings(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).parquet(path)


def upsert_stream(rows: DataFrame, table: sinks.UpsertTable, checkpoint: str, mode: str = "append", **options) -> StreamingQuery:
    """Every micro-batch is a run of its own, named by stream and number, so a replayed batch changes nothing.

    Of rows of a batch that share a key the one with the greatest content stays, whatever their order.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"
    order = [c for c in rows.columns if c not in table.keys]

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order=order, run=f"stream-{stream}-{number}", **options)

    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def chunk_stream(
    landed: DataFrame,
    store: str,
    checkpoint: str,
    encode: Callable[[DataFrame, str], DataFrame] = embedding.hashed_embedding,
) -> StreamingQuery:
    """Parse, chunk and embed arriving filings into the chunk store."""
    chunks = docs.chunk_table(docs.parse_sections(docs.default_metadata(landed)))
    table = sinks.chunk_table(landed.sparkSession, f"{store}/chunks")
    return upsert_stream(encode(chunks, "document"), table, checkpoint)


def month_table(spark: SparkSession, store: str) -> sinks.UpsertTable:
    """Last reading of each series and month."""
    return sinks.UpsertTable(spark, f"{store}/months", ["series_id", "month"])


def month_stream(observations: DataFrame, store: str, checkpoint: str, late: str = "3660 days") -> StreamingQuery:
    """Arriving observations (series_id, obs_date, value) to the last non-null value of each (series, month).

    The state is one row per series and month, as its key is the month's end, which also carries the
    watermark: a month is let go ``late`` after the newest one, and what comes for it then is dropped. Months
    that change are upserted per micro-batch. Late rows, repeated files and any order of arrival give what
    the batch operator gives; of several readings of a day the greatest counts.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    readings = observations.where("obs_date is not null").select(
        "series_id", F.last_day("obs_date").cast("timestamp").alias("month"),
        F.when(value.isNotNull(), F.struct("obs_date", value.alias("value"))).alias("_reading"),
    )
    months = (
        readings.withWatermark("month", late)
        .groupBy("series_id", "month")
        .agg(F.max("_reading").alias("_last"))
        .select(
            "series_id", F.col("month").cast("date").alias("month"),
            F.col("_last.value").alias("value"), F.col("_last.obs_date").alias("obs_date"),
        )
    )
    table = month_table(observations.sparkSession, store)
    return upsert_stream(months, table, checkpoint, mode="update")


def stored_months(spark: SparkSession, store: str) -> DataFrame | None:
    """(series_id, month, value) as ``series.monthly_last`` gives it, ready for gap filling and changes."""
    rows = month_table(spark, store).read()
    return None if rows is None else rows.select("series_id", "month", "value")


def sentiment_stream(
    landed: DataFrame, store: str, checkpoint: str, lexicon: dict[str, float] = fv.FINANCE_LEXICON
) -> StreamingQuery:
    """Parse and score arriving filings into the sentiment store."""
    scores = sent.score_sections(docs.parse_sections(docs.default_metadata(landed)), lexicon)
    table = sinks.sentiment_table(landed.sparkSession, f"{store}/sentiment")
    return upsert_stream(scores, table, checkpoint)
