"""Sentiment tables: section scores, the sentiment series, and its study against the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import sentiment as sn
from ..schemas import FILING_META, SENTIMENT
from ..sources.tables import with_lenient_dates
from .asof import asof_join
from .correlation import correlation_table
from .documents import default_metadata


def merged_lexicon(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(term, valence) with the terms of ``extra`` laid over those of ``base``; of a term's repeats the greatest counts."""
    both = base.select("term", F.col("valence").alias("b"), F.lit(None).cast("double").alias("e")).unionByName(
        extra.select("term", F.lit(None).cast("double").alias("b"), F.col("valence").alias("e"))
    )
    return both.groupBy("term").agg(F.coalesce(F.max("e"), F.max("b")).alias("valence"))


def lexicon_rows(spark: SparkSession, terms: dict[str, float] = fv.FINANCE_LEXICON) -> DataFrame:
    return spark.createDataFrame(list(terms.items()), "term string, valence double")


def score_by_table(df: DataFrame, key: str, lexicon: DataFrame, text: str = "text", digits: tuple[int, int] = (6, 6)) -> DataFrame:
    """(key, pos, neu, neg, compound) of each text by a (term, valence) table of any size.

    Tokens meet the lexicon in a join that drops all others, by broadcast where Spark finds the table small enough;
    occurrences are counted per key and term before they are summed. ``key`` is unique. Terms are single
    lower-case tokens, each of which counts as in the row-local scoring without rules.
    """
    words = sn.tokens(F.col(text))
    hits = (
        df.select(key, F.explode(words).alias("_w")).select(key, F.lower("_w").alias("term"))
        .join(lexicon.filter("valence <> 0"), "term")
        .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.max("valence").alias("v"))
    )
    n, v = F.col("n"), F.col("v")
    side = lambda test, value: F.coalesce(F.sum(F.when(test, n * value)), F.lit(0.0))
    sums = hits.groupBy(key).agg(
        F.sum(n * v).alias("_total"), side(v > 0, v + 1).alias("_pos"), side(v < 0, 1 - v).alias("_neg"), F.sum("n").alias("_hits")
    )
    found = df.select(key, F.coalesce(F.size(words), F.lit(0)).alias("_all")).join(sums, key, "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    neutral = F.greatest(F.col("_all"), F.lit(0)) - F.coalesce("_hits", F.lit(0))
    mass = value("_pos") + value("_neg") + neutral
    part = lambda x, none: F.round(F.coalesce(F.try_divide(x.cast("double"), mass), F.lit(none)), digits[0])
    return found.select(
        key, part(value("_pos"), 0.0).alias("pos"), part(neutral, 1.0).alias("neu"), part(value("_neg"), 0.0).alias("neg"),
        F.round(sn.compound(value("_total")), digits[1]).alias("compound"),
    )


def score_texts(
    df: DataFrame, text: str = "text", lexicon: dict[str, float] = fv.FINANCE_LEXICON, **options
) -> DataFrame:
    """Adds pos, neu, neg and compound; row-local."""
    scored = df.withColumn("_s", sn.score(F.col(text), lexicon, **options))
    return scored.select(*df.columns, "_s.pos", "_s.neu", "_s.neg", "_s.compound")


def score_sections(
    sections: DataFrame, lexicon: dict[str, float] = fv.FINANCE_LEXICON, **options
) -> DataFrame:
    """One score row per section, with the filing's metadata (empty where missing)."""
    meta = default_metadata(sections, unknown_ticker="").select(*FILING_META, "section", "text")
    return score_texts(meta, "text", lexicon, **options).drop("text")


def sentiment_series(records: DataFrame) -> DataFrame:
    """Typed scores, sorted by ticker, date and section; unreadable dates become null and sort last."""
    return with_lenient_dates(records).orderBy("ticker", F.asc_nulls_last("filing_date"), "section")


def empty_sentiment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SENTIMENT)


def sentiment_macro_study(
    sentiment: DataFrame,
    panel: DataFrame,
    date: str = "filing_date",
    target: str = "compound",
    min_observations: int = 10,
    catalog: dict = fv.SERIES,
) -> DataFrame:
    """Scores matched to the panel month before them, then the correlation table."""
    macro = panel.withColumnRenamed("date", "macro_date")
    merged = asof_join(sentiment, macro, date, "macro_date")
    return correlation_table(merged, target, min_observations, catalog)
