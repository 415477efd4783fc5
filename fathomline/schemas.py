"""Explicit schemas of the landed and derived tables."""

TICKER_MAP = "ticker string, cik_str bigint, title string"
SUBMISSIONS = (
    "cik string, name string, tickers array<string>, sic string, sicDescription string, "
    "stateOfIncorporation string, filings struct<recent:struct<form:array<string>,"
    "accessionNumber:array<string>,filingDate:array<string>,primaryDocument:array<string>>>"
)
INDEX_PAGES = "accession_number string, html string"
RAW_DOCUMENTS = "accession_number string, html string"
OBSERVATIONS = "series_id string, obs_date date, value double"
SENTIMENT = (
    "ticker string, company_name string, cik string, form_type string, filing_date timestamp_ntz, "
    "accession_number string, section string, pos double, neu double, neg double, compound double"
)
PAGE_TEXTS = "page_number int, text string"
QUESTIONS = (
    "query_id bigint, question string, tickers array<string>, sections array<string>, "
    "form_types array<string>, date_start string, date_end string"
)

FILING_META = ["ticker", "company_name", "cik", "form_type", "filing_date", "accession_number"]
