"""The registered queries: every operator over the whole of the given tables.

Stand-ins: orders are observations (one series per priority, or per customer) and filings,
customers are companies, documents are pages and sections, pages are landed HTML,
benchmark texts are questions, and embeddings are stored vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from . import ask
from ..functions import text as tx, vectors as vx
from ..operators import (
    asof, correlation, documents as docs, embedding, filings as fl, profile, retrieval as rt,
    sentiment as sent, series as se, stores, topics,
)
from ..session import ensure_checkpoint_dir
from ..sources import sinks, tables
from ..sources.tables import table, text_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters of the stand-in data.
ORDER_SERIES = {
    "URGENT": ("Urgent orders", "Fast"),
    "HIGH": ("High orders", "Fast"),
    "MEDIUM": ("Medium orders", "Regular"),
    "NOT_SPECIFIED": ("Unspecified orders", "Regular"),
    "LOW": ("Low orders", "Regular"),
}
ORDER_IDS = list(ORDER_SERIES)
ORDER_SPREAD = ("yield_curve", "HIGH", "LOW")
DOC_CATALOG = [
    ("opening", ["of the in", "is and"]),
    ("middle", ["and the", "de la"]),
    ("closing", ["in the", "le des", "el la"]),
    ("annex", ["that the", "der und"]),
]
PAGE_CATALOG = [("opening", ["the of", "of the"]), ("middle", ["and the", "in a"]), ("closing", ["to the", "is the"])]
PAGE_QUARTERLY = [("first", ["la de", "le la"]), ("second", ["des un", "und die"])]
PAGE_UPPERCASE = [("head", [r"The\s+[a-z]+"]), ("tail", [r"In\s+[a-z]+", r"La\s+[a-z]+"])]
LINK_SUFFIXES = ("e", "n", "r", "t", "s")
DEMO_LEXICON = {
    "the": 0.5, "of": -0.4, "and": 1.2, "that": -1.5, "for": 2.0, "with": -2.2,
    "la": 0.7, "le": -0.9, "des": 1.1, "und": -1.3, "der": 0.6, "el": -0.8,
}
DIM = 64
TOP_K = 6


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _folder(spark: SparkSession) -> str:
    """A new path beside the checkpoints, which all executors share, for what a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- stand-in tables -------------------------------------------------------------------


def order_obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.replace(F.expr("substring(o_orderpriority, 3)"), F.lit(" "), F.lit("_")).alias("series_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_totalprice").alias("value"),
        "o_orderkey",
    )


def customer_obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("series_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_totalprice").alias("value"),
        "o_orderkey",
    )


TIES = ("o_orderkey",)


def shipping_panel(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.last_day("l_shipdate").alias("macro_date"))
        .agg(
            F.sum("l_quantity").alias("qty_total"),
            F.max("l_extendedprice").alias("price_max"),
            F.min("l_extendedprice").alias("price_min"),
            F.count(F.lit(1)).alias("n_items"),
        )
    )


def order_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").alias("compound")
    )


def merged_orders(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_join(order_sentiment(spark, d), shipping_panel(spark, d), "o_orderdate", "macro_date")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the documents as a chunk store without vectors."""
    passages = docs.over_min_tokens(
        docs.page_chunks(text_table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    )
    ticker, accession = F.upper("source"), F.col("doc_id").cast("string")
    return passages.select(
        docs.ch.chunk_id(ticker, accession, F.col("lang"), F.col("chunk_index")).alias("chunk_id"),
        F.col("sentence_chunk").alias("document"),
        ticker.alias("ticker"),
        F.concat(F.lit("Company "), "source").alias("company_name"),
        accession.alias("accession_number"),
        F.col("lang").alias("section"),
        F.lit("10-K").alias("form_type"),
        F.lit("").alias("filing_date"),
        "chunk_index",
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def encoded_questions(spark: SparkSession, d: str) -> DataFrame:
    return embedding.hashed_embedding(questions(spark, d), "question", DIM)


def encoded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store with vectors, written once: search reads the vectors, its result the texts."""
    embedding.hashed_embedding(document_chunks(spark, d), "document", DIM).write.parquet(path := _folder(spark))
    return spark.read.parquet(path)


def found_passages(spark: SparkSession, d: str) -> DataFrame:
    return rt.search(encoded_questions(spark, d), encoded_chunks(spark, d), TOP_K)


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("section")
    )


def dated_vectors(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").cast("date").cast("string").alias("filing_date")
    )
    return stored_vectors(spark, d).join(dates, "chunk_id", "left")


def bounded_questions(spark: SparkSession, d: str) -> DataFrame:
    return encoded_questions(spark, d).withColumns(
        {"date_start": F.lit("1996-01-01"), "date_end": F.lit("1999-12-31")}
    )


def page_filings(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("accession_number"),
        F.when(F.contains("url", F.lit("/en")), "10-K").otherwise("10-Q").alias("form_type"),
        "html",
    )


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return docs.parse_sections(
        page_filings(spark, d), annual=PAGE_CATALOG, quarterly=PAGE_QUARTERLY,
        uppercase=PAGE_UPPERCASE, boundary_tag="p",
    )


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = text_table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("accession_number"), F.upper("source").alias("ticker"), "text"
    )
    return docs.catalog_sections(rows, DOC_CATALOG)


# ---- series ----------------------------------------------------------------------------


@query
def macro_monthly_last(spark, d):
    return se.monthly_series(order_obs(spark, d), limit=0, tie_break=TIES)


@query
def macro_ffill3(spark, d):
    return se.monthly_series(customer_obs(spark, d), limit=3, tie_break=TIES)


@query
def macro_yoy_mom(spark, d):
    return rounded(se.macro_features(customer_obs(spark, d), tie_break=TIES), "yoy", "mom")


@query
def macro_panel(spark, d):
    wide = se.macro_panel(order_obs(spark, d), ORDER_IDS, ORDER_SPREAD, tie_break=TIES)
    return rounded(wide, *[c for c in wide.columns if c != "date"])


@query
def macro_panel_features(spark, d):
    monthly = se.monthly_series(order_obs(spark, d), tie_break=TIES)
    raw = se.pivot_panel(
        monthly.withColumns({"yoy": F.lit(None).cast("double"), "mom": F.lit(None).cast("double")}), ORDER_IDS, None
    ).select("date", *ORDER_IDS)
    wide = se.add_panel_features(raw)
    return rounded(wide, *[c for c in wide.columns if c != "date"])


@query
def macro_spread(spark, d):
    obs = order_obs(spark, d)
    wide = se.macro_panel(obs, ["HIGH", "LOW"], ORDER_SPREAD, tie_break=TIES)
    return rounded(wide.select("date", "yield_curve"), "yield_curve")


@query
def macro_summary_stats(spark, d):
    stats = se.summary_stats(se.monthly_series(order_obs(spark, d), tie_break=TIES))
    return rounded(stats, "change_1m", "change_1y")


@query
def macro_summary_table(spark, d):
    return se.summary_table(se.summary_stats(se.monthly_series(order_obs(spark, d), tie_break=TIES)), ORDER_SERIES)


@query
def macro_slice(spark, d):
    wide = se.macro_panel(order_obs(spark, d), ORDER_IDS, None, tie_break=TIES)
    return se.slice_panel(wide, se.category_ids(wide, "Fast", ORDER_SERIES), "1997-01-01", "1999-06-30")


@query
def macro_category(spark, d):
    monthly = se.monthly_series(order_obs(spark, d), tie_break=TIES)
    return monthly.select(
        "series_id",
        "month",
        "value",
        se.series_names(F.col("series_id"), ORDER_SERIES).alias("series_name"),
        se.series_categories(F.col("series_id"), ORDER_SERIES).alias("category"),
    )


@query
def macro_extent(spark, d):
    monthly = se.monthly_series(order_obs(spark, d), tie_break=TIES)
    return se.date_extent(monthly.withColumnRenamed("month", "date"))


@query
def observation_scan(spark, d):
    inside = se.observations(order_obs(spark, d), "1996-03-01", "1999-10-31")
    return inside.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date")
    )


@query
def recession_tag(spark, d):
    monthly = se.monthly_series(order_obs(spark, d), tie_break=TIES)
    return monthly.select("series_id", "month", se.in_intervals(F.col("month")).alias("in_recession"))


@query
def recession_overlap(spark, d):
    monthly = se.monthly_series(order_obs(spark, d), tie_break=TIES)
    return se.overlapping_intervals(monthly.withColumnRenamed("month", "date"))


# ---- as-of join and correlation --------------------------------------------------------


@query
def asof_sentiment_macro(spark, d):
    return merged_orders(spark, d)


@query
def asof_same_day_ties(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    right = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return asof.asof_join(left, right, "l_shipdate", "o_orderdate", right_order=["o_orderkey"])


@query
def corr_table(spark, d):
    return correlation.correlation_table(merged_orders(spark, d), catalog={"qty_total": ("Quantity", "")})


@query
def corr_top(spark, d):
    return correlation.strongest(corr_table(spark, d), 3)


@query
def corr_significance(spark, d):
    return correlation.labelled(corr_table(spark, d))


@query
def sentiment_macro_study(spark, d):
    scores = sent.score_texts(
        text_table(spark, d, "documents").select("doc_id", "text"), lexicon=DEMO_LEXICON, rules=False,
        max_chars=None, digits=(6, 6),
    ).drop("text")
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("filing_date"))
    panel = shipping_panel(spark, d).withColumnRenamed("macro_date", "date")
    return sent.sentiment_macro_study(scores.join(dates, "doc_id").drop("doc_id"), panel)


# ---- text ------------------------------------------------------------------------------


@query
def page_stats(spark, d):
    return docs.page_stats(
        text_table(spark, d, "documents").select(F.col("doc_id").alias("page_number"), "text")
    )


@query
def text_profile(spark, d):
    stats = page_stats(spark, d)
    return profile.describe(
        stats, ["page_number", "page_char_count", "page_word_count", "page_sentence_count_raw", "page_token_count"]
    )


@query
def sentences(spark, d):
    return docs.sentence_rows(text_table(spark, d, "documents").select("doc_id", "text"))


@query
def page_sentence_counts(spark, d):
    return docs.page_sentence_counts(text_table(spark, d, "documents").select("doc_id", "text"))


@query
def fixed_chunks(spark, d):
    return docs.page_chunks(text_table(spark, d, "documents").select("doc_id", "text"))


@query
def chunk_min_tokens(spark, d):
    return docs.over_min_tokens(fixed_chunks(spark, d)).drop("sentence_chunk")


@query
def chunk_under_min_tokens(spark, d):
    return docs.under_min_tokens(fixed_chunks(spark, d))


@query
def overlap_chunks(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.posexplode(docs.ch.overlap_chunks(F.col("text"))).alias("chunk_index", "document"))


@query
def chunk_records(spark, d):
    rows = text_table(spark, d, "documents").select(
        F.col("source").alias("ticker"),
        F.col("doc_id").cast("string").alias("accession_number"),
        F.col("lang").alias("section"),
        "text",
    )
    return docs.chunk_table(rows, size=400, overlap=1)


@query
def html_text(spark, d):
    return docs.clean_documents(text_table(spark, d, "pages").select("page_id", "html")).drop("html")


@query
def text_cuts(spark, d):
    t = F.col("text")
    return text_table(spark, d, "documents").select(
        "doc_id", tx.snippet(t, 400).alias("snippet"), tx.ellipsis(t, 120).alias("title"),
        F.length(tx.snippet(t, 10_000)).alias("scored_chars"),
    )


@query
def sections(spark, d):
    return document_sections(spark, d)


@query
def sections_cascade(spark, d):
    return page_sections(spark, d)


@query
def ingest_counts(spark, d):
    found = document_sections(spark, d)
    return docs.ingest_counts(found, docs.chunk_table(found))


# ---- filings ---------------------------------------------------------------------------


@query
def link_ranking(spark, d):
    pages = text_table(spark, d, "pages").select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("accession_number"), "page_id", "url", "html"
    )
    href = fl.best_link(F.col("html"), F.col("accession_number"), LINK_SUFFIXES)
    return pages.select("page_id", href.alias("href"))


@query
def resolved_documents(spark, d):
    pages = text_table(spark, d, "pages")
    filings = pages.select(
        F.col("page_id").cast("string").alias("accession_number"), F.col("url").alias("document_url")
    )
    index = pages.select(F.col("page_id").cast("string").alias("accession_number"), "html")
    return fl.primary_documents(filings, index, keep_suffixes=LINK_SUFFIXES)


@query
def readable_pages(spark, d):
    """Landed pages with a text; every tenth is taken as an empty one, and every eleventh as missing."""
    html = F.when(F.col("page_id") % 10 == 0, "").when(F.col("page_id") % 11 != 0, F.col("html"))
    landed = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("accession_number"), html.alias("html"))
    return fl.readable(landed).select("accession_number", F.length("html").alias("n_chars"))


@query
def ticker_resolution(spark, d):
    requested = table(spark, d, "supplier").select(
        F.lower(F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer"))).alias("ticker")
    )
    known = table(spark, d, "customer").select(
        F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_mktsegment").alias("title")
    )
    return fl.ticker_matches(requested, known).withColumn("reason", F.coalesce("reason", F.lit("")))


@query
def company_info(spark, d):
    landed = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("cik"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("tickers"),
        F.col("c_nationkey").cast("string").alias("sic"),
        F.col("c_mktsegment").alias("sicDescription"),
        F.col("c_nationkey").cast("string").alias("stateOfIncorporation"),
    )
    return fl.company_info(landed)


@query
def filing_index(spark, d):
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    rows = table(spark, d, "orders").select(
        fl.pad_cik(F.col("o_custkey")).alias("cik"),
        F.col("o_orderstatus").alias("form_type"),
        F.concat_ws("-", F.substring(key, 1, 6), F.substring(key, 7, 6)).alias("accession_number"),
        F.col("o_orderdate").cast("date").cast("string").alias("filing_date"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        F.col("o_orderkey").alias("pos"),
    )
    return fl.first_filings(rows, "F", 5).drop("pos")


@query
def skip_existing(spark, d):
    customers = table(spark, d, "customer")
    pending = table(spark, d, "orders").filter(F.col("o_orderstatus") == "P")
    stored = pending.join(customers, pending.o_custkey == customers.c_custkey).select(F.col("c_name").alias("ticker"))
    return fl.skip_existing(customers.select(F.lower("c_name").alias("ticker"), "c_custkey"), stored)


# ---- vectors and retrieval -------------------------------------------------------------


@query
def embed_texts(spark, d):
    vectors = embedding.hashed_embedding(text_table(spark, d, "documents").select("doc_id", "text"), "text", DIM)
    return vectors.select("doc_id", F.posexplode(F.slice("embedding", 1, DIM)).alias("slot", "weight")).filter(
        F.col("weight") > 0
    ).select("doc_id", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query
def vector_measures(spark, d):
    v = F.col("embedding")
    ones = F.transform(v, lambda x: F.lit(1.0).cast("float"))
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.round(vx.l2_norm(v), 6).alias("norm"),
        F.round(vx.dot(v, ones), 6).alias("dot_ones"),
        F.round(vx.cosine(v, ones), 6).alias("cos_ones"),
    )


def _ranked(spark, d, **options):
    found = rt.exact_topk(encoded_questions(spark, d), stored_vectors(spark, d), **options)
    return rounded(found, "score")


@query
def vector_dot_topk(spark, d):
    return _ranked(spark, d, k=5, cosine=False)


@query
def vector_cosine_topk(spark, d):
    return _ranked(spark, d, k=TOP_K)


@query
def vector_filtered_topk(spark, d):
    asked = encoded_questions(spark, d).withColumn(
        "sections", F.array((F.length("question") % 5).cast("string"), (F.length("question") % 7).cast("string"))
    )
    found = rt.search(asked, stored_vectors(spark, d), TOP_K)
    return rounded(found, "score").select("query_id", "chunk_id", "section", "score", "rank")


@query
def vector_date_postfilter(spark, d):
    found = rt.search(bounded_questions(spark, d), dated_vectors(spark, d), TOP_K)
    return rounded(found, "score").select("query_id", "chunk_id", "filing_date", "score", "rank")


@query
def vector_date_prefilter(spark, d):
    found = rt.search(bounded_questions(spark, d), dated_vectors(spark, d), TOP_K, date_mode="pre")
    return rounded(found, "score").select("query_id", "chunk_id", "filing_date", "score", "rank")


@query
def vector_metadata_filter(spark, d):
    chosen = rt.metadata_filter(tickers=["src3", "src7"], sections=["en"], form_types=["10-K"])
    return document_chunks(spark, d).filter(chosen).select("chunk_id", "ticker", "section", "chunk_index")


def _neighbours(spark, d):
    """(found, exact): neighbours of every vector whose id is divisible by 20 among all others, by the index and by full search."""
    vectors = stored_vectors(spark, d)
    asked = vectors.filter(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    centroids = rt.fit_cells(vectors)
    index = rt.write_cells(rt.with_cells(vectors.select("chunk_id", "embedding"), centroids), _folder(spark))
    probes = rt.tuned_probes(vectors, index, centroids, TOP_K)
    others = lambda found: found.filter("query_id <> chunk_id")
    return others(rt.cells_topk(asked, index, centroids, TOP_K + 1, probes)), others(rt.exact_topk(asked, vectors, TOP_K + 1))


@query
def vector_index_topk(spark, d):
    return rounded(_neighbours(spark, d)[0], "score").select("query_id", "chunk_id", "score")


@query
def vector_index_recall(spark, d):
    """How many pairs full search finds, and whether the index found 0.9 of them."""
    return rt.recall(*_neighbours(spark, d)).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query
def passage_topk(spark, d):
    found = found_passages(spark, d)
    return rounded(found, "score").select("query_id", "chunk_id", "document", "ticker", "section", "score", "rank")


@query
def context_budget(spark, d):
    return rt.within_budget(found_passages(spark, d)).select(
        "query_id", "rank", "chunk_id", "tokens_used", "in_context"
    )


@query
def prompt_table(spark, d):
    budgeted = rt.within_budget(found_passages(spark, d))
    return rt.prompts(questions(spark, d), rt.contexts(budgeted))


@query
def prompt_bullets(spark, d):
    budgeted = rt.within_budget(found_passages(spark, d), budget=600)
    filled = rt.prompts(questions(spark, d), rt.contexts(budgeted, bullets=True), fv.BULLET_TEMPLATE)
    return filled.select("query_id", "prompt")


@query
def citations(spark, d):
    cited = rt.citations(found_passages(spark, d))
    return cited.select("query_id", F.posexplode("sources").alias("position", "s")).select(
        "query_id", "position", "s.*"
    )


@query
def ask_questions(spark, d):
    answered = ask.ask(
        questions(spark, d), encoded_chunks(spark, d), TOP_K, encode=lambda df, text: embedding.hashed_embedding(df, text, DIM)
    )
    return answered.select("query_id", "context", "prompt", F.size("sources").alias("n_sources"))


# ---- sentiment -------------------------------------------------------------------------


@query
def lexicon_sentiment(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "lang", "text")
    return sent.score_texts(rows, lexicon=DEMO_LEXICON, rules=False, max_chars=None, digits=(6, 6)).drop("text")


@query
def section_sentiment(spark, d):
    scored = sent.score_sections(document_sections(spark, d), DEMO_LEXICON, rules=False, digits=(6, 6))
    return sent.sentiment_series(scored).select(
        "ticker", "accession_number", "section", "pos", "neu", "neg", "compound"
    )


@query
def lexicon_table_sentiment(spark, d):
    """Base terms from a table (the words of all benchmark texts), with domain terms laid over them."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1)).alias("term"))
    valence = (F.pmod(F.length("term") * 7, F.lit(9)) - 4) / F.lit(2.0)
    base = words.filter("term <> ''").distinct().select("term", valence.alias("valence"))
    lexicon = sent.merged_lexicon(base, sent.lexicon_rows(spark, DEMO_LEXICON))
    return sent.score_by_table(text_table(spark, d, "documents").select("doc_id", "text"), "doc_id", lexicon)


@query
def rule_sentiment(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "text")
    return sent.score_texts(rows, lexicon=DEMO_LEXICON, max_chars=None).drop("text")


# ---- stores ----------------------------------------------------------------------------


@query
def sentiment_upsert(spark, d):
    existing = text_table(spark, d, "documents").select(
        F.col("doc_id").alias("accession_number"), F.lit("body").alias("section"),
        F.col("n_chars").cast("double").alias("compound"), F.lit("old").alias("origin"),
    )
    batch = table(spark, d, "labels").select(
        F.col("doc_id").alias("accession_number"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("body").alias("section"),
        F.col("quality").cast("double").alias("compound"), F.lit("new").alias("origin"),
    )
    twice = batch.unionByName(batch.withColumn("compound", F.col("compound") - 5))
    scores = sinks.UpsertTable(spark, _folder(spark), ["accession_number", "section"])
    scores.upsert(existing, order=["compound"])
    scores.upsert(twice, order=["compound"])
    return scores.read()


def _rechunked(spark, d):
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("accession_number"))
    return document_chunks(spark, d), labelled


@query
def chunk_upsert(spark, d):
    stored, labelled = _rechunked(spark, d)
    batch = stored.join(labelled, "accession_number", "left_semi").filter(F.col("chunk_index") < 2).select(
        *[c if c != "document" else F.concat(F.lit("New: "), "document").alias("document") for c in stored.columns]
    )
    chunks = sinks.UpsertTable(spark, _folder(spark), ["chunk_id"])
    chunks.upsert(stored, order=["document"])
    chunks.upsert(batch, order=["document"])
    return chunks.read().select("chunk_id", "accession_number", "chunk_index", "document")


@query
def chunk_replace(spark, d):
    stored, labelled = _rechunked(spark, d)
    batch = stored.join(labelled, "accession_number", "left_semi").filter(F.col("chunk_index") < 2)
    chunks = sinks.UpsertTable(spark, _folder(spark), ["chunk_id"])
    chunks.upsert(stored, order=["document"])
    chunks.upsert(batch, order=["document"], replace="accession_number")
    return chunks.read().select("chunk_id", "accession_number", "chunk_index")


def source_store(spark, d):
    """The chunk store with one filing per source, whose sections are the languages."""
    return document_chunks(spark, d).withColumn("accession_number", F.lower("ticker"))


@query
def store_stats(spark, d):
    return stores.total_chunks(source_store(spark, d))


@query
def filing_summary(spark, d):
    return stores.summary_display(stores.filing_summary(source_store(spark, d)))


@query
def distinct_tags(spark, d):
    chunks = source_store(spark, d)
    tickers = stores.distinct_values(chunks, "ticker").select(F.lit("ticker").alias("kind"), F.col("ticker").alias("tag"))
    names = stores.all_sections(stores.filing_summary(chunks))
    return tickers.unionByName(names.select(F.lit("section").alias("kind"), F.col("section").alias("tag")))


@query
def section_reader(spark, d):
    return stores.section_text(document_chunks(spark, d))


# ---- topics ----------------------------------------------------------------------------


@query
def tfidf(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "text")
    return rounded(topics.tfidf_table(rows, "doc_id", stop_words=fv.FILING_STOP_WORDS), "weight")


#: Fitted topic models of this session by folder: a vocabulary and a matrix each, so one fit serves all queries.
_MODELS: dict[tuple[str, str], topics.TopicModel] = {}


def _fitted(spark, d):
    rows = text_table(spark, d, "documents").select("doc_id", "lang", "text")
    key = (spark.conf.get("spark.app.id"), d)
    if key not in _MODELS:
        _MODELS[key] = topics.fit_topics(rows)
    return _MODELS[key], rows


@query
def lda_topics(spark, d):
    model, _ = _fitted(spark, d)
    return model.topic_table(spark)


@query
def doc_topics(spark, d):
    model, rows = _fitted(spark, d)
    return model.transform(rows).drop("text")


@query
def dominant_topic(spark, d):
    model, rows = _fitted(spark, d)
    return model.dominant(rows).drop("text")


@query
def topic_mix(spark, d):
    model, rows = _fitted(spark, d)
    return topics.topic_mix(model.transform(rows), "lang")


@query
def sample_rows(spark, d):
    return profile.sample_rows(table(spark, d, "documents").select("doc_id", "lang", "source"), 100, "doc_id")


@query
def sample_by_lang(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    return profile.sample_fractions(rows, "lang", {"en": 0.1, "de": 0.5, "fr": 0.25}, "doc_id")


@query
def first_rows(spark, d):
    return profile.head(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 5, "doc_id")


# ---- written tables, read again ----------------------------------------------------------


@query
def series_store(spark, d):
    sinks.write_series(se.monthly_series(order_obs(spark, d), limit=0, tie_break=TIES), path := _folder(spark))
    return spark.read.parquet(path).select("series_id", "month", "value")


@query
def panel_store(spark, d):
    sinks.write_panel(_QUERIES["macro_panel"](spark, d), path := _folder(spark))
    return tables.read_if_exists(spark, path)


@query
def observations_csv(spark, d):
    order_obs(spark, d).select("series_id", "obs_date", "value").write.option("header", True).csv(path := _folder(spark))
    return tables.observations(spark, path, "1996-03-01", "1999-10-31", fmt="csv")


@query
def vectors_csv(spark, d):
    sinks.write_vectors_csv(table(spark, d, "embeddings").select("vec_id", "embedding"), path := _folder(spark))
    read = tables.vectors_csv(spark, path, "vec_id bigint, embedding string")
    return read.select(
        "vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(vx.l2_norm(F.col("embedding")), 6).alias("norm"),
        F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"),
    )


@query
def sentiment_dates(spark, d):
    day = F.col("o_orderdate").cast("date").cast("string")
    records = table(spark, d, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"),
        F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(day).alias("filing_date"),
        F.col("o_orderkey").cast("string").alias("section"),
        F.col("o_totalprice").alias("compound"),
    )
    records.write.parquet(path := _folder(spark))
    return sent.sentiment_series(tables.sentiment(spark, path)).select(
        "ticker", F.col("filing_date").cast("date").alias("filing_date"), "section", "compound"
    )


# ---- one company of many -----------------------------------------------------------------


@query
def one_ticker_summary(spark, d):
    return stores.summary_display(stores.filing_summary(source_store(spark, d)), ticker="SRC3")


@query
def ticker_filings(spark, d):
    """The parallel-array index of each customer, asked for by ticker; unknown tickers are rejected."""
    customers = table(spark, d, "customer")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    filing = F.struct(
        "o_orderkey", F.col("o_orderstatus").alias("form"),
        F.concat_ws("-", F.substring(key, 1, 6), F.substring(key, 7, 6)).alias("accession"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("document"),
    )
    listed = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(filing)).alias("f"))
    submissions = listed.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").cast("string").alias("cik"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("name"),
        F.array("c_name").alias("tickers"), F.lit("").alias("sic"), F.lit("").alias("sicDescription"),
        F.lit("").alias("stateOfIncorporation"),
        F.struct(F.struct(
            F.col("f.form").alias("form"), F.col("f.accession").alias("accessionNumber"),
            F.col("f.day").alias("filingDate"), F.col("f.document").alias("primaryDocument"),
        ).alias("recent")).alias("filings"),
    )
    requested = table(spark, d, "part").select(
        F.concat(F.lit("customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("ticker")
    )
    known = customers.select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_mktsegment").alias("title"))
    found, rejected = fl.filings_for_tickers(requested, known, submissions, "F", 5)
    return found.withColumn("reason", F.lit("")).unionByName(rejected, allowMissingColumns=True)
