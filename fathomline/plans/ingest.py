"""Landed filings to stored chunks and sentiment, for all companies in one job."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import fixed_values as fv
from ..operators import documents as docs, embedding, filings as fl, sentiment as sent, stores
from ..sources import sinks, tables


@dataclass
class IngestResult:
    """What one run did, read from the tables of that run, which later runs leave alone."""

    filings: DataFrame
    rejected: DataFrame
    counts: DataFrame
    totals: dict[str, int]


def ingest_filings(
    spark: SparkSession,
    requested: DataFrame,
    ticker_map: DataFrame,
    submissions: DataFrame,
    raw_documents: DataFrame,
    store: str,
    form_type: str = "10-K",
    limit: int = 5,
    force: bool = False,
    chunk_size: int = 800,
    overlap: int = 2,
    encode: Callable[[DataFrame, str], DataFrame] = embedding.hashed_embedding,
    lexicon: dict[str, float] = fv.FINANCE_LEXICON,
) -> IngestResult:
    """Resolve, select, parse, chunk, embed and score; then commit sections, chunks and scores together.

    ``raw_documents`` holds the landed HTML by accession number. Filings, rejects and counts of a run are
    written under ``{store}/runs/{id}``, its rows beside those of earlier runs. Readers, and the choice of
    filings, see committed runs only, and the commit is the last step: a run that breaks off anywhere left
    nothing, and is simply repeated. ``totals`` are counted by the writing jobs as they write. Unknown tickers and
    filings without text come back as rejects.
    """
    section_store = sinks.section_table(spark, f"{store}/sections")
    chunk_store = sinks.chunk_table(spark, f"{store}/chunks")
    score_store = sinks.sentiment_table(spark, f"{store}/sentiment")
    known = chunk_store.read()
    wanted = requested if known is None else fl.skip_existing(requested, known, force)
    run = uuid.uuid4().hex
    folder = f"{store.rstrip('/')}/runs/{run}"
    seen = {name: Observation() for name in ("filings", "sections", "chunks")}

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.observe(seen[name], F.count(F.lit(1)).alias("n"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    filings, rejected = fl.filings_for_tickers(wanted, ticker_map, submissions, form_type, limit)
    filings = kept(counted(filings, "filings"), "filings")
    readable = fl.readable(raw_documents).select("accession_number", "html")
    unread = filings.join(readable, "accession_number", "left_anti").select(
        *[F.col(c) if c in filings.columns else F.lit(None).alias(c) for c in requested.columns],
        F.concat(F.lit("no text for "), "accession_number").alias("reason"),
    )

    rejected = kept(rejected.unionByName(unread), "rejected")
    parsed = docs.parse_sections(filings.join(readable, "accession_number"))
    section_store.append(counted(parsed, "sections"), run, replace="accession_number")
    sections = spark.read.schema(parsed.schema).parquet(f"{section_store.path}/run={run}")
    chunks = encode(docs.chunk_table(sections, chunk_size, overlap), "document")
    chunk_store.append(counted(chunks, "chunks"), run)
    written = spark.read.schema(chunks.schema).parquet(f"{chunk_store.path}/run={run}")
    counts = kept(docs.ingest_counts(sections, written), "counts")
    score_store.append(sent.sentiment_series(sent.score_sections(sections, lexicon)), run)
    section_store.log.commit(run, [section_store.name, chunk_store.name, score_store.name])
    return IngestResult(filings, rejected, counts, {name: o.get["n"] for name, o in seen.items()})


def stored_sections(spark: SparkSession, store: str) -> DataFrame | None:
    return sinks.section_table(spark, f"{store}/sections").read()


def stored_chunks(spark: SparkSession, store: str) -> DataFrame | None:
    return sinks.chunk_table(spark, f"{store}/chunks").read()


def stored_sentiment(spark: SparkSession, store: str) -> DataFrame | None:
    df = sinks.sentiment_table(spark, f"{store}/sentiment").read()
    return df if df is None else tables.with_lenient_dates(df)


def store_overview(chunks: DataFrame) -> DataFrame:
    return stores.summary_display(stores.filing_summary(chunks))
