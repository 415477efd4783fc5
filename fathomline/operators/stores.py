"""Keyed upserts and the summaries of a chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key. The maximum is taken before the shuffle as well, so copies collapse early."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_row")
    )
    return last.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` as it is, where no key repeats; else the job fails, as nothing says which row is the last."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_row"))
    wrong = F.raise_error(F.lit("a key repeats in the batch; order says which row is the last")).cast("boolean")
    return found.filter(F.when(F.col("_n") > 1, wrong).otherwise(F.lit(True))).select(
        *keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]
    ).select(*df.columns)


def upsert(
    existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """``existing`` with ``batch`` laid over it: on equal keys the batch wins, and within it the last row.

    ``existing`` already has one row per key, so it is only filtered by the batch's keys,
    never regrouped. ``order`` says which batch row is last; without it no key may repeat.
    """
    fresh = keep_last(batch, keys, [F.col(c) for c in order]) if order else one_per_key(batch, keys)
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_chunks(existing: DataFrame, batch: DataFrame, replace_filing: bool = False) -> DataFrame:
    """Chunk upsert by id. ``replace_filing`` first drops all old chunks of the batch's filings."""
    if replace_filing:
        filings = batch.select("accession_number").distinct()
        existing = existing.join(filings, "accession_number", "left_anti").select(*existing.columns)
    return upsert(existing, batch, ["chunk_id"])


def total_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"))


def filing_summary(chunks: DataFrame) -> DataFrame:
    """One row per (ticker, filing): its metadata, sorted section names and chunk count, newest first."""

    def first(name: str) -> Column:
        return F.min_by(name, F.struct("section", "chunk_index")).alias(name)

    return (
        chunks.groupBy("ticker", "accession_number")
        .agg(
            first("company_name"),
            first("filing_date"),
            first("form_type"),
            F.array_sort(F.collect_set("section")).alias("sections"),
            F.count(F.lit(1)).alias("chunk_count"),
        )
        .orderBy(F.desc("ticker"), F.desc("filing_date"), "accession_number")
    )


def summary_display(summary: DataFrame, ticker: str = "All") -> DataFrame:
    """The summary as text, for all tickers or one."""
    rows = summary if ticker == "All" else summary.filter(F.col("ticker") == ticker)
    return rows.select(
        "ticker", "company_name", "filing_date", "form_type",
        F.array_join("sections", ", ").alias("sections"), "chunk_count", "accession_number",
    )


def distinct_values(chunks: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    return chunks.filter(F.col(column) != "").select(column).distinct().orderBy(column)


def all_sections(summary: DataFrame) -> DataFrame:
    """Every section name of a summary, once, sorted."""
    return summary.select(F.explode("sections").alias("section")).distinct().orderBy("section")


def section_text(
    chunks: DataFrame, accession: str | None = None, section: str | None = None, max_chunks: int | None = None
) -> DataFrame:
    """Text of each (filing, section): its chunks in document order, or the first ``max_chunks`` of them."""
    rows = chunks
    if accession is not None:
        rows = rows.filter(F.col("accession_number") == accession)
    if section is not None:
        rows = rows.filter(F.col("section") == section)
    w = Window.partitionBy("accession_number", "section").orderBy("chunk_index")
    head = rows.withColumn("_rn", F.row_number().over(w))
    if max_chunks is not None:
        head = head.filter(F.col("_rn") <= max_chunks)
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "document")))
    return head.groupBy("accession_number", "section").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(ordered, lambda c: c["document"]), "\n\n").alias("text"),
    )
