"""Company and filing tables: ticker resolution, filing index, primary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import text as tx


def ticker_map_rows(raw: DataFrame) -> DataFrame:
    """A landed ticker object (one map column ``entries``) as rows, in file order."""
    return raw.select(F.posexplode(F.map_values("entries")).alias("pos", "e")).select("pos", "e.*")


def pad_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def ticker_matches(requested: DataFrame, ticker_map: DataFrame, pos: str | None = None) -> DataFrame:
    """Every requested ticker with its padded CIK and title, and a reason where the map does not have it.

    One join does both: ``reason`` is null for tickers that were found. Of several entries with one ticker
    the first by ``pos`` wins: the column of that name in the map, or the CIK where there is none.
    """
    pos = pos or ("pos" if "pos" in ticker_map.columns else "cik_str")
    first = ticker_map.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.min_by(F.struct("cik_str", "title"), pos).alias("e")
    )
    return requested.withColumn("ticker", F.upper("ticker")).join(first, "ticker", "left").select(
        *requested.columns,
        pad_cik(F.col("e.cik_str")).alias("cik"),
        F.col("e.title").alias("title"),
        F.when(F.col("e").isNull(), "unknown ticker").alias("reason"),
    )


def resolve_tickers(
    requested: DataFrame, ticker_map: DataFrame, pos: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(found, rejected): the two sides of ``ticker_matches``."""
    matches = ticker_matches(requested, ticker_map, pos)
    found = matches.filter(F.col("reason").isNull()).drop("reason")
    rejected = matches.filter(F.col("reason").isNotNull()).select(*requested.columns, "reason")
    return found, rejected


def company_info(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        pad_cik(F.col("cik")).alias("cik"),
        "name",
        F.get("tickers", F.lit(0)).alias("ticker"),
        "sic",
        F.col("sicDescription").alias("sic_description"),
        F.col("stateOfIncorporation").alias("state"),
    )


def with_links(filings: DataFrame, archive_url: str = fv.ARCHIVE_URL) -> DataFrame:
    """Adds document and index links: no dashes in the accession, no leading zeros in the CIK."""
    folder = F.concat_ws(
        "/",
        F.lit(archive_url),
        F.regexp_replace("cik", "^0+", ""),
        F.replace(F.col("accession_number"), F.lit("-"), F.lit("")),
    )
    return filings.select(
        "*",
        F.concat_ws("/", folder, F.col("primary_document")).alias("document_url"),
        F.concat(folder, F.lit("/")).alias("index_url"),
    )


def filing_index(submissions: DataFrame, form_type: str = "10-K", limit: int = 5) -> DataFrame:
    """First ``limit`` filings of a form per company, from the parallel arrays of its index.

    Companies are one row each, so the choice is made inside the row, without a shuffle.
    """
    recent = F.col("filings.recent")
    zipped = F.transform(
        F.arrays_zip(
            recent["form"], recent["accessionNumber"], recent["filingDate"], recent["primaryDocument"]
        ),
        lambda f: F.struct(
            f["form"].alias("form_type"),
            f["accessionNumber"].alias("accession_number"),
            f["filingDate"].alias("filing_date"),
            f["primaryDocument"].alias("primary_document"),
        ),
    )
    chosen = F.slice(F.filter(zipped, lambda f: f["form_type"] == form_type), 1, limit)
    return with_links(submissions.select(pad_cik(F.col("cik")).alias("cik"), F.inline(chosen)))


def first_filings(
    index_rows: DataFrame, form_type: str = "10-K", limit: int = 5, pos: str = "pos"
) -> DataFrame:
    """``filing_index`` for an index landed as one row per filing.

    The rank filter is applied in each partition before the shuffle, so a company with a
    large share of the rows sends at most ``limit`` of them per partition.
    """
    w = Window.partitionBy("cik").orderBy(pos)
    return with_links(
        index_rows.filter(F.col("form_type") == form_type)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


def filings_for_tickers(
    requested: DataFrame,
    ticker_map: DataFrame,
    submissions: DataFrame,
    form_type: str = "10-K",
    limit_per_ticker: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(filings, rejected) for many tickers at once; a bad ticker only yields a reject row."""
    found, rejected = resolve_tickers(requested, ticker_map)
    index = filing_index(submissions, form_type, limit_per_ticker)
    names = company_info(submissions).select("cik", F.col("name").alias("_name"))
    filings = (
        index.join(found.select("ticker", "cik"), "cik")
        .join(names, "cik", "left")
        .withColumn("company_name", F.coalesce("_name", "ticker"))
        .drop("_name")
    )
    return filings, rejected


def best_link(
    html: Column,
    accession: Column,
    keep_suffixes: tuple[str, ...] = (".htm", ".html"),
) -> Column:
    """The link of an index page most likely to be the main document, or null.

    Links to index pages and text submissions are left out. A link with the accession
    number comes first, then one with an 18-digit run, then any; page order decides ties.
    """
    hrefs = F.regexp_extract_all(
        html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1)
    )
    bare = F.transform(hrefs, lambda h: tx.decode_entities(F.regexp_replace(h, r"""^["']|["']\z""", "")))
    dashless = F.replace(accession, F.lit("-"), F.lit(""))

    def wanted(h: Column) -> Column:
        low = F.lower(h)
        suffix = F.lit(False)
        for s in keep_suffixes:
            suffix = suffix | F.endswith(low, F.lit(s))
        return suffix & ~F.contains(low, F.lit("-index.htm")) & ~F.endswith(low, F.lit(".txt"))

    ranked = F.transform(
        bare,
        lambda h, i: F.struct(
            F.when(F.contains(h, dashless), 0).when(F.rlike(h, F.lit(r"[0-9]{18}")), 1).otherwise(2).alias("priority"),
            i.alias("pos"),
            h.alias("href"),
        ),
    )
    return F.array_min(F.filter(ranked, lambda r: wanted(r["href"])))["href"]


def primary_documents(
    filings: DataFrame,
    index_pages: DataFrame,
    site_url: str = fv.SITE_URL,
    keep_suffixes: tuple[str, ...] = (".htm", ".html"),
) -> DataFrame:
    """Adds ``resolved_url``: the best link of the index page, else the filing's own link."""
    best = index_pages.select(
        "accession_number",
        best_link(F.col("html"), F.col("accession_number"), keep_suffixes).alias("_href"),
    )
    absolute = F.when(F.startswith("_href", F.lit("http")), F.col("_href")).otherwise(
        F.concat(F.lit(site_url), F.col("_href"))
    )
    return (
        filings.join(best, "accession_number", "left")
        .withColumn("resolved_url", F.coalesce(absolute, F.col("document_url")))
        .drop("_href")
    )


def readable(documents: DataFrame) -> DataFrame:
    """Landed documents that have any text; the others are skipped."""
    return documents.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def skip_existing(requested: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Requested tickers that the store does not hold yet, or all of them with ``force``."""
    if force:
        return requested
    known = stored.filter(F.col("ticker") != "").select(F.upper("ticker").alias("_known")).distinct()
    return requested.join(known, F.upper("ticker") == F.col("_known"), "left_anti")
