import random
import re

import pytest
from conftest import one
from pyspark.sql import functions as F

from fathomline import fixed_values as fv
from fathomline.functions import chunking as ch, sections as sx, text as tx
from fathomline.operators import documents as docs

X = F.col("x")


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Hello <b>world</b></p><script>bad()</script>", "Hello world"),
        ("<head><title>t</title></head><header>kept</header>", "kept"),
        ("a<!-- <p>gone</p> -->b", "a b"),
        ("<style>p{}</style>x &lt; y &amp;lt; z", "x < y &lt; z"),
        ("1 < 2 and <i title='a>b'>c</i>", "1 < 2 and c"),
        ("&#8217;&#x41;&eacute;&bogus;&copy AT&T &#0;", "’Aé&bogus;© AT&T &#0;"),
        ("a<br><br>\n\n\n\nb", "a \n\nb"),
        ("", ""),
        ("<p>unclosed <script>x", "unclosed"),
    ],
)
def test_html_to_text(spark, html, text):
    assert one(spark, html, tx.html_to_text(X)) == text


def test_statistics_count_empty_pieces(spark):
    assert one(spark, "a  b. c", tx.word_count(X)) == 4
    assert one(spark, "a. b. c", tx.rough_sentence_count(X)) == 3
    assert one(spark, "", tx.word_count(X)) == 1
    assert one(spark, "abcdef", tx.token_estimate(X)) == 1.5
    assert one(spark, " a\nb  ", tx.one_line(X)) == "a b"
    assert one(spark, "abcdef", tx.ellipsis(X, 3)) == "abc..."


def test_sentences(spark):
    assert one(spark, "Rain fell all night. The dam held! Nobody slept.", tx.sentences(X)) == [
        "Rain fell all night.", "The dam held!", "Nobody slept.",
    ]
    assert one(spark, 'He said "Stop." Then left! Why? 3.5 kg.', tx.sentences(X)) == [
        'He said "Stop."', "Then left!", "Why?", "3.5 kg.",
    ]


def plain_chunks(sentences, size, overlap):
    out, cur, n = [], [], 0
    for s in sentences:
        if n + len(s) > size and cur:
            out.append(" ".join(cur))
            cur = cur[-overlap:] if overlap else []
            n = sum(map(len, cur))
        cur.append(s)
        n += len(s)
    if cur:
        out.append(" ".join(cur))
    return [c for c in out if len(c) > 50]


@pytest.mark.parametrize("size, overlap", [(300, 2), (120, 1), (200, 0), (80, 3)])
def test_overlap_chunks_against_plain_walk(spark, size, overlap):
    rng = random.Random(size)
    texts = [
        " ".join("w" * rng.randint(1, 90) + rng.choice(".!?") for _ in range(rng.randint(0, 40))) for _ in range(40)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r["i"]: r["c"] for r in df.select("i", ch.overlap_chunks(X, size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        parts = [s for s in re.split(r"(?<=[.!?])\s+", t) if s]
        assert got[i] == plain_chunks(parts, size, overlap)


def test_short_texts_give_no_chunk(spark):
    assert one(spark, "Hi. Ok. Yes. No.", ch.overlap_chunks(X)) == []
    assert one(spark, "Revenue grew strongly this period.", ch.overlap_chunks(X)) == []


def test_fixed_groups(spark):
    sizes = lambda n: [len(g) for g in one(spark, list(range(n)), ch.fixed_groups(X, 10), "array<int>")]
    assert sizes(25) == [10, 10, 5] and sizes(10) == [10] and sizes(0) == []
    assert one(spark, ["One.", "Two  x."], ch.group_text(X), "array<string>") == "One. Two x."


def test_chunk_id(spark):
    got = one(spark, "aapl", ch.chunk_id(X, F.lit("acc"), F.lit("mda"), F.lit(0)))
    assert got == "f07d0e7583f568c0f56937e789e9eb49"


def test_last_match_does_not_overlap(spark):
    text = "x quantitative a quantitative b market risk"
    assert one(spark, text, sx.last_match_start(X, "(?iuUd)quantitative.*market risk")) == 2
    assert one(spark, "none", sx.last_match_start(X, "zzz")) is None
    assert one(spark, "zzz at the start", sx.last_match_start(X, "zzz")) == 0
    assert one(spark, "", sx.last_match_start(X, "zzz")) is None


def test_header_scan_matches_plain_python(spark):
    rng = random.Random(5)
    parts = ["item 1", "Item 1a", "ITEM 7A", "item\u00a07", "risk factors", "Quantitative", "market risk", "management's discussion", "\n", " ", "\x01", "\x02", "é", "😀", "financial statements", "md&a", "$1", "item 8"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    found = df.select("k", sx.header_positions(X, fv.ANNUAL_SECTIONS).alias("p"))
    for k, hits in found.collect():
        want = []
        for i, (key, patterns) in enumerate(fv.ANNUAL_SECTIONS):
            starts = next((s for p in patterns if (s := [m.start() for m in re.finditer(p, texts[k], re.I)])), None)
            want += [(starts[-1], i, key)] if starts else []
        assert [tuple(h) for h in hits] == sorted(want), texts[k]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(" not in plan


PARAGRAPH = "The firm sells goods in many places and its revenue went up. " * 5
ANNUAL = f"""<html><head><title>r</title></head><body><p>FORM</p>
<h2>Item&nbsp;1. Business</h2><p>{PARAGRAPH}</p><h2>Item 1A. Risk Factors</h2><p>{PARAGRAPH}</p>
<h2>Item 7. Management Discussion</h2><p>{PARAGRAPH}</p><h2>Item 8. Financial Statements</h2><p>{PARAGRAPH}</p></body></html>"""


def parse(spark, html, form="10-K", **options):
    df = spark.createDataFrame([("a", form, html)], "accession_number string, form_type string, html string")
    return {r["section"]: r["text"] for r in docs.parse_sections(df, **options).collect()}


def test_annual_filing(spark):
    found = parse(spark, ANNUAL)
    assert {"business", "risk_factors", "mda", "financials"} == set(found)
    assert "revenue" in found["mda"] and all(len(t) > 200 and "<" not in t for t in found.values())


def test_uppercase_tier_uses_annual_items_for_quarterly_forms(spark):
    body = f"<p>ITEM  7 X {PARAGRAPH}</p><p>ITEM  8 Y {PARAGRAPH}</p>"
    assert set(parse(spark, body, "10-Q")) == {"mda", "financials"}


def test_one_section_is_discarded(spark):
    found = parse(spark, f"<p>Item 8 {PARAGRAPH * 150}</p>")
    assert list(found) == ["section_1"] and len(found["section_1"]) > 30_000


def test_short_text_is_full_text(spark):
    assert parse(spark, "<p>Short text without sections.</p>") == {"full_text": "Short text without sections."}


def test_rule_split(spark):
    long = "z" * 400
    found = parse(spark, f"{long}<hr>{long}<hr/>{long}after")
    assert list(found) == ["section_1", "section_2", "section_3"] and found["section_3"] == long + "after"
    assert list(parse(spark, f"{long}<hr>{long}<hr/>{long}", keep_tail=False)) == ["section_1", "section_2"]
    assert list(parse(spark, "short<hr>short<hr>" + "y" * 150)) == ["full_text"]


def test_dash_split_keeps_gaps(spark):
    found = parse(spark, f"{'a' * 250} ------------ tiny ------------ {'b' * 250}")
    assert list(found) == ["section_1", "section_3"]


def test_sections_are_not_cut(spark):
    text = "Item 1 " + "a " * 200 + "Item 7 " + "b " * 20_000 + "Item 8 " + "c " * 20_000
    found = parse(spark, text)
    assert len(found["mda"]) > 30_000 and len(found["financials"]) > 30_000


def test_repeated_keys_keep_the_later(spark):
    catalog = [("s", ["alpha"]), ("t", ["beta"]), ("s", ["gamma"])]
    df = spark.createDataFrame([("alpha " + "x" * 250 + " beta " + "y" * 250 + " gamma " + "z" * 250,)], "text string")
    rows = docs.catalog_sections(df, catalog).collect()
    assert [(r["section"], r["text"][:5]) for r in rows] == [("t", "beta "), ("s", "gamma")]


def test_page_stats_and_chunk_records(spark):
    pages = spark.createDataFrame([(42, " One. Two.\nThree. ")], "page_number int, text string")
    row = docs.page_stats(pages).first()
    assert (row["page_number"], row["page_char_count"], row["text"]) == (1, 16, "One. Two. Three.")
    sections = spark.createDataFrame([(None, "mda", "The company grew its sales a lot in this year. " * 40)], "ticker string, section string, text string")
    chunks = docs.chunk_table(sections).collect()
    assert chunks[0]["ticker"] == "UNKNOWN" and [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)


def test_heavy_text_is_parsed_once(spark):
    df = spark.createDataFrame([("a", "10-K", ANNUAL)], "accession_number string, form_type string, html string")
    plan = docs.chunk_table(docs.parse_sections(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<script") == 2, "tag removal appears once for the page and once for the parts"
    assert "Exchange" not in plan and "Python" not in plan


def test_fixed_values():
    assert len(fv.FINANCE_LEXICON) == 46 and len(fv.SERIES) == 17
    assert len({c for _, c in fv.SERIES.values()}) == 6 and len(fv.FILING_STOP_WORDS) == 37


@pytest.mark.parametrize(
    "html, text",
    [
        ("a" + "<td></td>" * 60_000 + "b", "a b"),
        ("a<p title='x>" + "y's \"q\" " * 20_000, None),
        ("<!-- " + "x" * 500_000, ""),
        ("&amp;" * 20_000, "&" * 20_000),
    ],
)
def test_dirty_pages_do_not_exhaust_the_stack(spark, html, text):
    got = one(spark, html, tx.html_to_text(X))
    assert text is None or got == text


def test_book_size_text(spark):
    text = " ".join(f"Sentence number {i} of a long book is here." for i in range(60_000))
    chunks = one(spark, text, ch.overlap_chunks(X))
    assert len(chunks) > 3_000 and chunks[-1].endswith("Sentence number 59999 of a long book is here.")
