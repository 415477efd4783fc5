"""Documents to sections, chunks and page statistics. Everything here is row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import chunking as ch, sections as sx, text as tx
from ..schemas import FILING_META


def clean_documents(raw: DataFrame, html: str = "html") -> DataFrame:
    return raw.withColumn("text", tx.html_to_text(F.col(html)))


def parse_sections(
    raw: DataFrame,
    html: str = "html",
    form_type: str = "form_type",
    annual: list | None = None,
    quarterly: list | None = None,
    uppercase: list | None = None,
    boundary_tag: str = "hr",
    keep_tail: bool = True,
) -> DataFrame:
    """One row per section: every column of ``raw`` but the HTML, plus ``section`` and ``text``.

    Without ``keep_tail`` what follows the last rule tag is left out where a document is cut at rules.

    Each tier runs only on documents where the one before found under two sections, and
    then replaces it. The tiers are separate projections so that none is computed twice.
    """
    clean = raw.withColumn("_clean", tx.html_to_text(F.col(html)))
    tier1 = clean.withColumn(
        "_a", sx.form_sections(F.col("_clean"), F.col(form_type), annual, quarterly)
    )
    upper = uppercase or fv.UPPERCASE_SECTIONS
    fallback = sx.slice_sections(
        F.col("_clean"), sx.header_positions(F.col("_clean"), upper, case_sensitive=True)
    )
    if sx.has_repeated_keys(upper):
        fallback = sx.keep_last_per_key(fallback)
    tier2 = tier1.withColumn("_b", F.when(F.size("_a") >= 2, F.col("_a")).otherwise(fallback))
    split = sx.split_sections(F.col(html), F.col("_clean"), boundary_tag, keep_tail=keep_tail)
    tier3 = tier2.withColumn("_c", F.when(F.size("_b") >= 2, F.col("_b")).otherwise(split))
    final = F.when(F.size("_c") > 0, F.col("_c")).otherwise(sx.full_text(F.col("_clean")))
    return tier3.select(*[c for c in raw.columns if c != html], F.inline(final))


def catalog_sections(docs: DataFrame, catalog: list, text: str = "text") -> DataFrame:
    """Sections of already clean text by one catalog; documents without headers yield no row."""
    found = sx.slice_sections(F.col(text), sx.header_positions(F.col(text), catalog))
    if sx.has_repeated_keys(catalog):
        found = sx.keep_last_per_key(found)
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.inline(found))


def default_metadata(df: DataFrame, unknown_ticker: str = "UNKNOWN") -> DataFrame:
    """Upper-case tickers, with stand-ins for missing metadata."""
    have = [c for c in FILING_META if c in df.columns]
    missing = {c: F.lit("") for c in FILING_META if c not in have}
    filled = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(unknown_ticker if c == "ticker" else ""))
        for c in have
    }
    if "ticker" not in have:
        missing["ticker"] = F.lit(unknown_ticker)
    out = df.withColumns({**filled, **missing})
    return out.withColumn("ticker", F.upper("ticker"))


def chunk_table(sections: DataFrame, size: int = 800, overlap: int = 2) -> DataFrame:
    """Chunk records of sections: id, text, position and the filing's metadata."""
    meta = default_metadata(sections)
    rows = meta.select(
        *FILING_META, "section", F.posexplode(ch.overlap_chunks(F.col("text"), size, overlap)).alias("chunk_index", "document")
    )
    key = ch.chunk_id(F.col("ticker"), F.col("accession_number"), F.col("section"), F.col("chunk_index"))
    return rows.select(key.alias("chunk_id"), "document", *FILING_META, "section", "chunk_index")


def page_stats(pages: DataFrame, page_offset: int = 41) -> DataFrame:
    """Per page: clean one-line text and its five statistics; page numbers are shifted."""
    flat = pages.withColumn("text", tx.one_line(F.col("text")))
    t = F.col("text")
    return flat.withColumn("page_number", F.col("page_number") - page_offset).select(
        *[c for c in pages.columns if c != "text"],
        tx.char_count(t).alias("page_char_count"),
        tx.word_count(t).alias("page_word_count"),
        tx.rough_sentence_count(t).alias("page_sentence_count_raw"),
        tx.token_estimate(t).alias("page_token_count"),
        "text",
    )


def sentence_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(tx.sentences(F.col(text))).alias("sentence_index", "sentence"))


def page_sentence_counts(pages: DataFrame, group_size: int = 10, text: str = "text") -> DataFrame:
    """How many sentences a page has, and how many groups of them."""
    kept = [c for c in pages.columns if c != text]
    counted = pages.select(*kept, F.size(tx.sentences(F.col(text))).alias("page_sentence_count"))
    return counted.withColumn("num_chunks", F.ceil(F.col("page_sentence_count") / group_size))


def page_chunks(pages: DataFrame, group_size: int = 10, text: str = "text") -> DataFrame:
    """Groups of sentences as passages with their statistics."""
    kept = [c for c in pages.columns if c != text]
    groups = F.transform(ch.fixed_groups(tx.sentences(F.col(text)), group_size), ch.group_text)
    rows = pages.select(*kept, F.posexplode(groups).alias("chunk_index", "sentence_chunk"))
    c = F.col("sentence_chunk")
    return rows.select(
        "*",
        tx.char_count(c).alias("chunk_char_count"),
        tx.word_count(c).alias("chunk_word_count"),
        tx.token_estimate(c).alias("chunk_token_count"),
    )


def over_min_tokens(chunks: DataFrame, minimum: float = 30) -> DataFrame:
    return chunks.filter(F.col("chunk_token_count") > minimum)


def under_min_tokens(chunks: DataFrame, minimum: float = 30) -> DataFrame:
    return chunks.filter(F.col("chunk_token_count") <= minimum)


def ingest_counts(sections: DataFrame, chunks: DataFrame, key: str = "accession_number") -> DataFrame:
    """Sections and chunks per filing; both sides are aggregated before they meet."""
    s = sections.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"))
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    return s.join(c, key, "left").select(
        key, "n_sections", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks")
    )
