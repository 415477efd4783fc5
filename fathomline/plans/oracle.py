"""SQL counterparts of the registered queries, for checking the results.

Written relationally and independently of the Spark code; only parameters are shared.
"""

from __future__ import annotations

from .. import fixed_values as fv
from . import queries as q


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, final: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + final


# ---- series ----------------------------------------------------------------------------

OBS = """obs AS (
  SELECT replace(substr(o_orderpriority, 3), ' ', '_') AS series_id,
         CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value, o_orderkey FROM orders)"""
CUSTOMER_OBS = """obs AS (
  SELECT o_custkey AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
         o_totalprice AS value, o_orderkey FROM orders)"""
MONTHLY = """monthly AS (
  SELECT series_id, last_day(obs_date) AS month, value FROM obs
  QUALIFY row_number() OVER (PARTITION BY series_id, last_day(obs_date)
                             ORDER BY obs_date DESC, o_orderkey DESC, value DESC) = 1)"""
DENSE = """spans AS (
  SELECT series_id, min(date_trunc('month', obs_date)) AS lo, max(date_trunc('month', obs_date)) AS hi
  FROM obs GROUP BY series_id),
days AS (
  SELECT series_id, last_day(CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE)) AS month FROM spans),
dense AS (
  SELECT d.series_id, d.month, m.value FROM days d LEFT JOIN monthly m USING (series_id, month))"""
FILLED = """filled AS (
  SELECT series_id, month,
         last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month
           ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value FROM dense)"""
FEATURES = """calendar AS (SELECT DISTINCT month FROM filled),
grid AS (
  SELECT s.series_id, c.month, s.lo FROM spans s JOIN calendar c ON c.month >= CAST(s.lo AS DATE)),
padded AS (
  SELECT g.series_id, g.month, f.value,
         last_value(f.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.month) AS p
  FROM grid g LEFT JOIN filled f USING (series_id, month)),
lags AS (
  SELECT *, lag(p, 12) OVER w AS p12, lag(p, 1) OVER w AS p1 FROM padded
  WINDOW w AS (PARTITION BY series_id ORDER BY month)),
features AS (
  SELECT series_id, month, value,
         (p / nullif(p12, 0) - 1) * 100 AS yoy, (p / nullif(p1, 0) - 1) * 100 AS mom FROM lags)"""
SERIES = (OBS, MONTHLY, DENSE, FILLED)
ALL_FEATURES = (*SERIES, FEATURES)


def _pick(sid: str, col: str, alias: str, digits: int | None = 6) -> str:
    expr = f"max(CASE WHEN series_id = '{sid}' THEN {col} END)"
    return f'round({expr}, {digits}) AS "{alias}"' if digits is not None else f'{expr} AS "{alias}"'


def _panel() -> str:
    cols = [_pick(s, "value", s) for s in q.ORDER_IDS]
    cols += [_pick(s, c, f"{s}_{c}") for s in q.ORDER_IDS for c in ("yoy", "mom")]
    spread = (
        "round(max(CASE WHEN series_id = 'HIGH' THEN value END)"
        " - max(CASE WHEN series_id = 'LOW' THEN value END), 6) AS yield_curve"
    )
    return f"SELECT month AS date, {', '.join(cols)}, {spread} FROM features GROUP BY month"


def _panel_plain() -> str:
    """The panel without the spread: none of the series is one of its default names."""
    cols = [_pick(s, "value", s) for s in q.ORDER_IDS]
    cols += [_pick(s, c, f"{s}_{c}") for s in q.ORDER_IDS for c in ("yoy", "mom")]
    return f"SELECT month AS date, {', '.join(cols)} FROM features GROUP BY month"


STATS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS rn
  FROM filled WHERE value IS NOT NULL),
stats AS (
  SELECT series_id,
         max(CASE WHEN rn = 1 THEN value END) AS current,
         max(CASE WHEN rn = 1 THEN value END) - max(CASE WHEN rn = 2 THEN value END) AS change_1m,
         max(CASE WHEN rn = 1 THEN value END) - max(CASE WHEN rn = 13 THEN value END) AS change_1y,
         max(CASE WHEN rn <= 52 THEN value END) AS high,
         min(CASE WHEN rn <= 52 THEN value END) AS low
  FROM ranked GROUP BY series_id)"""


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_str(k)} THEN {_str(v)}" for k, v in pairs.items()) + " END"


NAMES = _case("series_id", {s: n for s, (n, _) in q.ORDER_SERIES.items()})
CATEGORIES = _case("series_id", {s: c for s, (_, c) in q.ORDER_SERIES.items()})
IN_RECESSION = " OR ".join(f"month BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in fv.RECESSIONS)
RECESSIONS = "recessions AS (SELECT * FROM (VALUES " + ", ".join(
    f"(DATE '{a}', DATE '{b}')" for a, b in fv.RECESSIONS
) + ') t("start", "end"))'

# ---- as-of and correlation -------------------------------------------------------------

PANEL = """panel AS (
  SELECT last_day(CAST(l_shipdate AS DATE)) AS macro_date, sum(l_quantity) AS qty_total,
         max(l_extendedprice) AS price_max, min(l_extendedprice) AS price_min, count(*) AS n_items
  FROM lineitem GROUP BY 1)"""
MERGED = """merged AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice AS compound, p.*
  FROM orders o ASOF LEFT JOIN panel p ON CAST(o.o_orderdate AS DATE) >= p.macro_date)"""


def _correlations(source: str, columns: list[str], names: dict[str, str]) -> tuple[str, ...]:
    """r and n per column, and p as a ratio of two midpoint sums of the t density in angle form."""
    rows = " UNION ALL ".join(
        f"""SELECT {_str(c)} AS series_id, {_str(names.get(c, c))} AS series_name,
              corr(compound, {c}) AS r, count(*) FILTER (compound IS NOT NULL AND {c} IS NOT NULL) AS n
            FROM {source}"""
        for c in columns
    )
    return (
        f"pairs AS ({rows})",
        """grid AS (
  SELECT *, (n - 3) AS power, 40 / sqrt(n - 3) AS width, asin(abs(r)) AS a FROM pairs WHERE n >= 10),
steps AS (SELECT unnest(generate_series(0, 99999)) + 0.5 AS i),
masses AS (
  SELECT series_id,
    sum(exp(power * ln(cos(a + i * (least(pi() / 2, a + width) - a) / 100000)))) * (least(pi() / 2, any_value(a + width)) - any_value(a)) AS tail,
    sum(exp(power * ln(cos(i * least(pi() / 2, width) / 100000)))) * least(pi() / 2, any_value(width)) AS whole
  FROM grid, steps GROUP BY series_id, a, width),
correlations AS (
  SELECT g.series_id, g.series_name, round(g.r, 4) AS correlation,
         round(m.tail / m.whole, 6) AS p_value, g.n AS n_observations
  FROM grid g JOIN masses m USING (series_id))""",
    )


ORDER_CORR = (
    PANEL, MERGED,
    *_correlations(
        "merged", ["o_orderkey", "o_custkey", "qty_total", "price_max", "price_min", "n_items"],
        {"qty_total": "Quantity"},
    ),
)

# ---- text ------------------------------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(expr: str) -> str:
    return STRIP.format(expr)


SENTENCE_LIST = (
    "list_filter(string_split(regexp_replace({0}, '([.!?][\"''”’)\\]]*)\\s+', '\\1' || chr(31), 'g'), chr(31)),"
    " lambda s: length(s) > 0)"
)


def sentence_list(expr: str) -> str:
    return SENTENCE_LIST.format(expr)


PAGE_STATS = f"""flat AS (SELECT doc_id - 41 AS page_number, {strip("replace(text, chr(10), ' ')")} AS text FROM documents),
page_stats AS (
  SELECT page_number, length(text)::INTEGER AS page_char_count, len(string_split(text, ' '))::INTEGER AS page_word_count,
         len(string_split(text, '. '))::INTEGER AS page_sentence_count_raw, length(text) / 4.0 AS page_token_count, text
  FROM flat)"""


def _profile() -> str:
    cols = ["page_number", "page_char_count", "page_word_count", "page_sentence_count_raw", "page_token_count"]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n_values, round(avg({c}), 2) AS mean,
              round(stddev_samp({c}), 2) AS std, round(min({c})::DOUBLE, 2) AS min,
              round(quantile_cont({c}::DOUBLE, 0.25), 2) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 2) AS p50,
              round(quantile_cont({c}::DOUBLE, 0.75), 2) AS p75, round(max({c})::DOUBLE, 2) AS max
            FROM page_stats"""
        for c in cols
    )


PASSAGES = f"""sentence_lists AS (SELECT doc_id, lang, source, {sentence_list("text")} AS ss FROM documents),
groups AS (
  SELECT doc_id, lang, source, g AS chunk_index, ss[g * 10 + 1 : g * 10 + 10] AS grp
  FROM (SELECT *, unnest(range(CAST(ceil(len(ss) / 10.0) AS BIGINT))) AS g FROM sentence_lists)),
passages AS (
  SELECT doc_id, lang, source, CAST(chunk_index AS INTEGER) AS chunk_index,
         regexp_replace({strip("replace(array_to_string(grp, ''), '  ', ' ')")}, '\\.([A-Z])', '. \\1', 'g') AS sentence_chunk
  FROM groups),
page_chunks AS (
  SELECT *, length(sentence_chunk)::INTEGER AS chunk_char_count, len(string_split(sentence_chunk, ' '))::INTEGER AS chunk_word_count,
         length(sentence_chunk) / 4.0 AS chunk_token_count FROM passages)"""
CHUNK_STORE = """chunks AS (
  SELECT md5(concat_ws('_', upper(source), doc_id::VARCHAR, lang, chunk_index::VARCHAR)) AS chunk_id,
         sentence_chunk AS document, upper(source) AS ticker, 'Company ' || source AS company_name,
         doc_id::VARCHAR AS accession_number, lang AS section, '10-K' AS form_type, '' AS filing_date, chunk_index
  FROM page_chunks WHERE chunk_token_count > 30)"""
PAGE_CHUNK_COLS = "doc_id, chunk_index, sentence_chunk, chunk_char_count, chunk_word_count, chunk_token_count"


def overlap(source: str, keys: list[str], size: int, carry: int, out: str = "chunked") -> tuple[str, ...]:
    """Overlapping chunks of ``source(keys.., text)`` by walking the sentences of each text."""
    k = ", ".join(keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    return (
        f"{out}_in AS (SELECT {k}, {sentence_list('text')} AS ss FROM {source})",
        f"""{out}_walk AS (
  SELECT {k}, 1 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS n, NULL::VARCHAR AS done, len(ss) AS total FROM {out}_in
  UNION ALL
  SELECT {k}, i + 1,
         list_append(CASE WHEN is_full THEN cur[-{carry}:] ELSE cur END, s),
         length(s) + CASE WHEN is_full
           THEN coalesce(list_sum(list_transform(cur[-{carry}:], lambda x: length(x))), 0)::BIGINT ELSE n END,
         CASE WHEN is_full THEN array_to_string(cur, ' ') END, total
  FROM (SELECT {rk}, r.i, r.cur, r.n, r.total, d.ss[r.i] AS s,
               (r.n + length(d.ss[r.i]) > {size} AND len(r.cur) > 0) AS is_full
        FROM {out}_walk r JOIN {out}_in d USING ({k}) WHERE r.i <= r.total))""",
        f"""{out}_all AS (
  SELECT {k}, i, done AS document FROM {out}_walk WHERE done IS NOT NULL
  UNION ALL
  SELECT {k}, i + 1, array_to_string(cur, ' ') FROM {out}_walk WHERE i = total + 1 AND len(cur) > 0)""",
        f"""{out} AS (
  SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY i) - 1 AS INTEGER) AS chunk_index, document
  FROM {out}_all WHERE length(document) > 50)""",
    )


ENTITIES = [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def entities(expr: str) -> str:
    for ref, char in ENTITIES:
        expr = f"replace({expr}, {_str(ref)}, {_str(char)})"
    return expr


def node_text(expr: str, head: bool) -> str:
    out = rf"regexp_replace({expr}, '(?s)<!--.*?(-->|\z)', '<!>', 'g')"
    for name in ("script", "style"):
        out = rf"regexp_replace({out}, '(?is)<{name}\b[^>]*>.*?(</{name}\s*>|\z)', '<!>', 'g')"
    if head:
        out = rf"regexp_replace({out}, '(?is)<head\b[^>]*>.*?(</head\s*>|\z)', '<!>', 'g')"
    return entities(f"regexp_replace({out}, '(<[a-zA-Z/!?][^>]*>)+', ' ', 'g')")


def html_text(expr: str) -> str:
    out = rf"regexp_replace({node_text(expr, True)}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def last_start(text: str, pattern: str) -> str:
    p = _str(pattern)
    return (
        f"CASE WHEN regexp_matches({text}, {p}) THEN length({text})"
        f" - length(string_split_regex({text}, {p})[-1]) - length(regexp_extract_all({text}, {p})[-1]) END"
    )


def catalog_slices(source: str, key: str, catalog: list, out: str, flags: str = "(?i)", where: str = "true") -> tuple[str, ...]:
    """Sections of ``source(key, text)`` by header positions, as ``out(key, pos, section, text)``."""
    hits = " UNION ALL ".join(
        f"SELECT {key}, text, {i} AS ord, {_str(name)} AS section, coalesce("
        + ", ".join(last_start("text", flags + p) for p in patterns)
        + f") AS pos FROM {source} WHERE {where}"
        for i, (name, patterns) in enumerate(catalog)
    )
    body = strip("substr(text, pos + 1, coalesce(nxt, length(text)) - pos)")
    return (
        f"{out}_hits AS ({hits})",
        f"""{out}_spans AS (
  SELECT *, lead(pos) OVER (PARTITION BY {key} ORDER BY pos, ord) AS nxt FROM {out}_hits WHERE pos IS NOT NULL)""",
        f"""{out} AS (
  SELECT {key}, pos, section, {body} AS text FROM {out}_spans WHERE length({body}) > 200)""",
    )


DOC_SECTIONS = (
    "doc_rows AS (SELECT doc_id::VARCHAR AS accession_number, upper(source) AS ticker, text FROM documents)",
    *catalog_slices("doc_rows", "accession_number, ticker", q.DOC_CATALOG, "found"),
)


def _cascade() -> str:
    parts = node_text("part", False)
    tier3 = rf"""parts AS (
  SELECT d.accession_number, d.form_type, i, string_split_regex(d.html, '(?i)<p\b[^>]*>') AS ps
  FROM docs d, range(100000) t(i) WHERE i < len(string_split_regex(d.html, '(?i)<p\b[^>]*>'))),
ruled AS (
  SELECT accession_number, row_number() OVER (PARTITION BY accession_number ORDER BY i) AS k, t AS text
  FROM (SELECT accession_number, i, {strip(node_text("ps[i + 1]", False))} AS t FROM parts) WHERE length(t) > 300),
dashed AS (
  SELECT accession_number, k, {strip("ds[k]")} AS text
  FROM (SELECT accession_number, ds, unnest(range(1, len(ds) + 1)) AS k
        FROM (SELECT accession_number, string_split_regex(text, '-{{10,}}') AS ds FROM docs
              WHERE len(string_split_regex(html, '(?i)<p\b[^>]*>')) < 3))),
c AS (
  SELECT accession_number, 'section_' || k AS section, text
  FROM (SELECT * FROM ruled WHERE accession_number IN
          (SELECT accession_number FROM docs WHERE len(string_split_regex(html, '(?i)<p\b[^>]*>')) >= 3)
        UNION ALL SELECT * FROM dashed)
  WHERE length(text) > 200)"""
    return with_(
        f"""docs AS (
  SELECT page_id::VARCHAR AS accession_number, CASE WHEN contains(url, '/en') THEN '10-K' ELSE '10-Q' END AS form_type,
         html, {html_text("html")} AS text FROM pages)""",
        *catalog_slices("docs", "accession_number", q.PAGE_CATALOG, "a1", where="form_type <> '10-Q'"),
        *catalog_slices("docs", "accession_number", q.PAGE_QUARTERLY, "a2", where="form_type = '10-Q'"),
        *catalog_slices("docs", "accession_number", q.PAGE_UPPERCASE, "b", flags=""),
        "a AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)",
        "a_ok AS (SELECT accession_number FROM a GROUP BY 1 HAVING count(*) >= 2)",
        """b_ok AS (SELECT accession_number FROM b GROUP BY 1 HAVING count(*) >= 2
                    EXCEPT SELECT accession_number FROM a_ok)""",
        tier3,
        """result AS (
  SELECT accession_number, section, text FROM a WHERE accession_number IN (FROM a_ok)
  UNION ALL SELECT accession_number, section, text FROM b WHERE accession_number IN (FROM b_ok)
  UNION ALL SELECT accession_number, section, text FROM c
    WHERE accession_number NOT IN (FROM a_ok) AND accession_number NOT IN (FROM b_ok))""",
        final="""SELECT r.accession_number, d.form_type, r.section, r.text FROM result r JOIN docs d USING (accession_number)
UNION ALL
SELECT accession_number, form_type, 'full_text', text FROM docs
WHERE accession_number NOT IN (SELECT accession_number FROM result)""",
    )


# ---- filings ---------------------------------------------------------------------------


def _links(accession: str) -> tuple[str, ...]:
    suffix = " OR ".join(f"ends_with(lower(href), '{s}')" for s in q.LINK_SUFFIXES)
    return (
        rf"""hrefs AS (
  SELECT page_id, url, {accession} AS accession, unnest(hs) AS href, unnest(range(len(hs))) AS pos
  FROM (SELECT *, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hs FROM pages))""",
        f"""ranked AS (
  SELECT *, CASE WHEN contains(href, accession) THEN 0 WHEN regexp_matches(href, '[0-9]{{18}}') THEN 1 ELSE 2 END AS priority
  FROM hrefs WHERE ({suffix}) AND NOT contains(lower(href), '-index.htm') AND NOT ends_with(lower(href), '.txt'))""",
        """best AS (
  SELECT page_id, href FROM ranked
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority, pos) = 1)""",
    )


# ---- vectors ---------------------------------------------------------------------------


def hashed(source: str, key: str, text: str, out: str, dim: int = q.DIM) -> tuple[str, ...]:
    return (
        rf"""{out}_slots AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 6))::BIGINT % {dim} AS slot, count(*) AS c
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS w FROM {source}) GROUP BY ALL)""",
        f"{out}_norm AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {out}_slots GROUP BY {key})",
        f"""{out} AS (
  SELECT g.{key}, list(coalesce(s.c / n.norm, 0)::FLOAT::DOUBLE ORDER BY g.slot) AS vec
  FROM (SELECT {key}, unnest(range({dim})) AS slot FROM {source}) g
  LEFT JOIN {out}_slots s ON s.{key} = g.{key} AND s.slot = g.slot
  LEFT JOIN {out}_norm n ON n.{key} = g.{key} GROUP BY g.{key})""",
    )


QUESTIONS = (
    "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)",
    *hashed("questions", "query_id", "question", "qv"),
)
VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec, label::VARCHAR AS section FROM embeddings)"
COSINE = "CASE WHEN list_dot_product(a.vec, a.vec) = 0 OR list_dot_product(b.vec, b.vec) = 0 THEN 0 ELSE list_cosine_similarity(a.vec, b.vec) END"


def topk(source: str, k: int, measure: str = COSINE, where: str = "true", out: str = "ranked", extra: str = "") -> str:
    return f"""{out} AS (
  SELECT query_id, chunk_id, raw AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank{extra}
  FROM (SELECT a.query_id, b.*, round({measure}, 9) AS raw FROM qv a, {source} b WHERE {where})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) <= {k})"""


DATED = """dated AS (
  SELECT v.*, strftime(o.o_orderdate, '%Y-%m-%d') AS filing_date FROM vectors v LEFT JOIN orders o ON o.o_orderkey = v.chunk_id)"""
IN_DATES = "coalesce(filing_date, '') >= '1996-01-01' AND coalesce(filing_date, '') <= '1999-12-31'"
SEARCHED = (
    PASSAGES,
    CHUNK_STORE,
    *QUESTIONS,
    *hashed("chunks", "chunk_id", "document", "cv"),
    topk("cv", q.TOP_K),
    "found AS (SELECT r.query_id, r.score, r.rank, c.* FROM ranked r JOIN chunks c USING (chunk_id))",
    """budgeted AS (
  SELECT *, sum(length(document) / 4.0) OVER (PARTITION BY query_id ORDER BY rank) AS tokens_used FROM found)""",
)


def _prompt(template: str) -> str:
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return f"{_str(head)} || context || {_str(middle)} || question || {_str(tail)}"


def _contexts(budget: int, bullets: bool) -> str:
    joined = (
        r"'- ' || coalesce(string_agg(document, chr(10) || '- ' ORDER BY rank) FILTER (tokens_used <= {0}), '')"
        if bullets
        else r"coalesce(string_agg(document, chr(10) || chr(10) ORDER BY rank) FILTER (tokens_used <= {0}), '')"
    ).format(budget)
    return f"contexts AS (SELECT query_id, {joined} AS context FROM budgeted GROUP BY query_id)"


PROMPTED = """prompted AS (
  SELECT query_id, question, coalesce(c.context, '') AS context FROM questions LEFT JOIN contexts c USING (query_id))"""

# ---- sentiment -------------------------------------------------------------------------


def scored(source: str, keys: str, text: str = "text", out: str = "scored") -> tuple[str, ...]:
    value = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.DEMO_LEXICON.items()) + " ELSE 0 END"
    return (
        rf"""{out}_words AS (
  SELECT {keys}, ({value})::DOUBLE AS v FROM (
    SELECT {keys}, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS w FROM (
      SELECT {keys}, unnest(string_split_regex({text}, '\s+')) AS w FROM {source})) WHERE length(w) > 0)""",
        f"""{out}_sums AS (
  SELECT {keys}, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
         sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS g, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS z
  FROM {out}_words GROUP BY ALL)""",
        f"""{out} AS (
  SELECT {keys}, round(coalesce(p / (p + g + z), 0), 6) AS pos, round(coalesce(z / (p + g + z), 1), 6) AS neu,
         round(coalesce(g / (p + g + z), 0), 6) AS neg, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound
  FROM {source} LEFT JOIN {out}_sums USING ({keys}))""",
    )


STORE = "store AS (SELECT * REPLACE (lower(ticker) AS accession_number) FROM chunks)"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["macro_monthly_last"] = with_(OBS, MONTHLY, DENSE, final="SELECT series_id, month, value FROM dense")
    sql["macro_ffill3"] = with_(CUSTOMER_OBS, MONTHLY, DENSE, FILLED, final="FROM filled")
    sql["macro_yoy_mom"] = with_(
        CUSTOMER_OBS, MONTHLY, DENSE, FILLED, FEATURES,
        final="SELECT series_id, month, value, round(yoy, 6) AS yoy, round(mom, 6) AS mom FROM features",
    )
    sql["macro_panel"] = with_(*ALL_FEATURES, final=_panel())
    sql["macro_panel_features"] = with_(*ALL_FEATURES, final=_panel_plain())
    sql["macro_spread"] = with_(
        OBS[:-1] + " WHERE o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '%LOW')",
        MONTHLY, DENSE, FILLED, FEATURES, f"wide AS ({_panel()})",
        final="SELECT date, yield_curve FROM wide",
    )
    sql["macro_summary_stats"] = with_(
        *SERIES, STATS,
        final="""SELECT series_id, current, round(change_1m, 6) AS change_1m, round(change_1y, 6) AS change_1y,
                        high, low FROM stats""",
    )
    sql["macro_summary_table"] = with_(
        *SERIES, STATS,
        final=f"""SELECT {NAMES} AS series, printf('%.3f', current) AS current,
                         coalesce(printf('%+.3f', change_1m), '—') AS change_1m,
                         coalesce(printf('%+.3f', change_1y), '—') AS change_1y,
                         printf('%.3f', high) AS high, printf('%.3f', low) AS low FROM stats""",
    )
    sql["macro_slice"] = with_(
        *SERIES,
        "wide AS (SELECT month AS date, " + ", ".join(_pick(s, "value", s, None) for s in ("URGENT", "HIGH"))
        + " FROM filled GROUP BY month)",
        final="""SELECT * FROM wide WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'
                 AND NOT ("URGENT" IS NULL AND "HIGH" IS NULL)""",
    )
    sql["macro_category"] = with_(
        *SERIES, final=f"SELECT series_id, month, value, {NAMES} AS series_name, {CATEGORIES} AS category FROM filled"
    )
    sql["macro_extent"] = with_(*SERIES, final="SELECT min(month) AS date_min, max(month) AS date_max FROM filled")
    sql["observation_scan"] = with_(
        OBS,
        final="""SELECT series_id, count(*) AS n, min(obs_date) AS first_date, max(obs_date) AS last_date FROM obs
                 WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '1999-10-31' GROUP BY series_id""",
    )
    sql["recession_tag"] = with_(*SERIES, final=f"SELECT series_id, month, ({IN_RECESSION}) AS in_recession FROM filled")
    sql["recession_overlap"] = with_(
        *SERIES, RECESSIONS, "extent AS (SELECT min(month) AS lo, max(month) AS hi FROM filled)",
        final='SELECT "start", "end" FROM recessions, extent WHERE "start" <= hi AND "end" >= lo',
    )

    sql["asof_sentiment_macro"] = with_(PANEL, MERGED, final="FROM merged")
    sql["asof_same_day_ties"] = with_(
        """days AS (
  SELECT o_orderdate, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1)""",
        final="""SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, d.*
                 FROM lineitem l ASOF LEFT JOIN days d ON l.l_shipdate >= d.o_orderdate""",
    )
    sql["corr_table"] = with_(*ORDER_CORR, final="FROM correlations")
    sql["corr_top"] = with_(*ORDER_CORR, final="FROM correlations ORDER BY abs(correlation) DESC, series_id LIMIT 3")
    sql["corr_significance"] = with_(
        *ORDER_CORR,
        """starred AS (
  SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars
  FROM correlations)""",
        final="""SELECT *, series_name || ' ' || stars AS label,
                        CASE WHEN correlation < 0 THEN 'negative' ELSE 'positive' END AS sign FROM starred""",
    )
    sql["sentiment_macro_study"] = with_(
        PANEL,
        "doc_text AS (SELECT doc_id, text FROM documents)",
        *scored("doc_text", "doc_id"),
        "placed AS (SELECT s.pos, s.neu, s.neg, s.compound, o.o_orderdate FROM scored s JOIN orders o ON o.o_orderkey = s.doc_id)",
        "merged AS (SELECT * FROM placed s ASOF LEFT JOIN panel p ON CAST(s.o_orderdate AS DATE) >= p.macro_date)",
        *_correlations("merged", ["pos", "neu", "neg", "qty_total", "price_max", "price_min", "n_items"], {}),
        final="FROM correlations",
    )

    sql["page_stats"] = with_(PAGE_STATS, final="FROM page_stats")
    sql["text_profile"] = with_(PAGE_STATS, final=_profile())
    sql["sentences"] = f"""SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sentence_index, unnest(ss) AS sentence
FROM (SELECT doc_id, {sentence_list("text")} AS ss FROM documents)"""
    sql["page_sentence_counts"] = f"""SELECT doc_id, len(ss)::INTEGER AS page_sentence_count, CAST(ceil(len(ss) / 10.0) AS BIGINT) AS num_chunks
FROM (SELECT doc_id, {sentence_list("text")} AS ss FROM documents)"""
    sql["fixed_chunks"] = with_(PASSAGES, final=f"SELECT {PAGE_CHUNK_COLS} FROM page_chunks")
    sql["chunk_min_tokens"] = with_(
        PASSAGES,
        final="""SELECT doc_id, chunk_index, chunk_char_count, chunk_word_count, chunk_token_count
                 FROM page_chunks WHERE chunk_token_count > 30""",
    )
    sql["chunk_under_min_tokens"] = with_(
        PASSAGES, final=f"SELECT {PAGE_CHUNK_COLS} FROM page_chunks WHERE chunk_token_count <= 30"
    )
    sql["overlap_chunks"] = with_(*overlap("documents", ["doc_id"], 800, 2), final="FROM chunked", recursive=True)
    sql["chunk_records"] = with_(
        *overlap("documents", ["doc_id", "source", "lang"], 400, 1),
        final="""SELECT md5(concat_ws('_', upper(source), doc_id::VARCHAR, lang, chunk_index::VARCHAR)) AS chunk_id, document,
                        upper(source) AS ticker, '' AS company_name, '' AS cik, '' AS form_type, '' AS filing_date,
                        doc_id::VARCHAR AS accession_number, lang AS section, chunk_index FROM chunked""",
        recursive=True,
    )
    sql["html_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
    sql["text_cuts"] = """SELECT doc_id, substr(text, 1, 400) AS snippet,
       CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS title,
       CAST(least(length(text), 10000) AS INTEGER) AS scored_chars FROM documents"""
    sql["sections"] = with_(*DOC_SECTIONS, final="SELECT accession_number, ticker, section, text FROM found")
    sql["sections_cascade"] = _cascade()
    sql["ingest_counts"] = with_(
        *DOC_SECTIONS,
        *overlap("found", ["accession_number", "section"], 800, 2),
        "s AS (SELECT accession_number, count(*) AS n_sections FROM found GROUP BY 1)",
        "c AS (SELECT accession_number, count(*) AS n_chunks FROM chunked GROUP BY 1)",
        final="""SELECT accession_number, n_sections, coalesce(n_chunks, 0) AS n_chunks
                 FROM s LEFT JOIN c USING (accession_number)""",
        recursive=True,
    )

    sql["link_ranking"] = with_(
        *_links("regexp_extract(html, 'lang=\"([a-z]+)\"', 1)"),
        final="SELECT p.page_id, b.href FROM pages p LEFT JOIN best b USING (page_id)",
    )
    sql["resolved_documents"] = with_(
        *_links("page_id::VARCHAR"),
        final=f"""SELECT p.page_id::VARCHAR AS accession_number, p.url AS document_url,
                  coalesce(CASE WHEN starts_with(b.href, 'http') THEN b.href ELSE '{fv.SITE_URL}' || b.href END, p.url) AS resolved_url
                  FROM pages p LEFT JOIN best b USING (page_id)""",
    )
    sql["readable_pages"] = """SELECT page_id::VARCHAR AS accession_number, length(html) AS n_chars FROM pages
WHERE page_id % 10 <> 0 AND page_id % 11 <> 0 AND html <> ''"""
    sql["ticker_resolution"] = """WITH wanted AS (SELECT upper(replace(s_name, 'Supplier', 'Customer')) AS ticker FROM supplier)
SELECT w.ticker, lpad(c.c_custkey::VARCHAR, 10, '0') AS cik, c.c_mktsegment AS title,
       CASE WHEN c.c_name IS NULL THEN 'unknown ticker' ELSE '' END AS reason
FROM wanted w LEFT JOIN customer c ON upper(c.c_name) = w.ticker"""
    sql["company_info"] = """SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_name AS name,
       CASE WHEN c_acctbal >= 0 THEN c_name END AS ticker, c_nationkey::VARCHAR AS sic,
       c_mktsegment AS sic_description, c_nationkey::VARCHAR AS state FROM customer"""
    sql["filing_index"] = f"""WITH chosen AS (
  SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderstatus AS form_type, lpad(o_orderkey::VARCHAR, 12, '0') AS k,
         strftime(o_orderdate, '%Y-%m-%d') AS filing_date, 'doc' || o_orderkey || '.htm' AS primary_document, o_custkey
  FROM orders WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5),
linked AS (
  SELECT *, '{fv.ARCHIVE_URL}/' || CASE WHEN o_custkey = 0 THEN '' ELSE o_custkey::VARCHAR END || '/' || k AS folder FROM chosen)
SELECT cik, form_type, substr(k, 1, 6) || '-' || substr(k, 7, 6) AS accession_number, filing_date, primary_document,
       folder || '/' || primary_document AS document_url, folder || '/' AS index_url FROM linked"""
    sql["skip_existing"] = """SELECT lower(c_name) AS ticker, c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""

    sql["embed_texts"] = with_(
        *hashed("documents", "doc_id", "text", "dv"),
        final="""SELECT s.doc_id, CAST(s.slot AS INTEGER) AS slot, round((s.c / n.norm)::FLOAT::DOUBLE, 6) AS weight
                 FROM dv_slots s JOIN dv_norm n USING (doc_id)""",
    )
    sql["vector_measures"] = """SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(v), 6) AS dot_ones,
       round(list_sum(v) / (sqrt(list_dot_product(v, v)) * sqrt(len(v))), 6) AS cos_ones
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""
    ranked_rows = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked"
    sql["vector_dot_topk"] = with_(
        *QUESTIONS, VECTORS, topk("vectors", 5, "list_dot_product(a.vec, b.vec)"), final=ranked_rows
    )
    sql["vector_cosine_topk"] = with_(*QUESTIONS, VECTORS, topk("vectors", q.TOP_K), final=ranked_rows)
    sql["vector_index_recall"] = f"""SELECT count(*) AS wanted, true AS enough FROM (
  SELECT a.vec_id, b.vec_id AS other FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) <= {q.TOP_K})"""
    sql["vector_filtered_topk"] = with_(
        *QUESTIONS, VECTORS,
        "wanted AS (SELECT query_id, [(length(question) % 5)::VARCHAR, (length(question) % 7)::VARCHAR] AS sections FROM questions)",
        topk("vectors", q.TOP_K, where="list_contains((SELECT w.sections FROM wanted w WHERE w.query_id = a.query_id), b.section)"),
        final="""SELECT r.query_id, r.chunk_id, v.section, round(r.score, 6) AS score, r.rank
                 FROM ranked r JOIN vectors v USING (chunk_id)""",
    )
    dated_rows = """SELECT r.query_id, r.chunk_id, d.filing_date, round(r.score, 6) AS score, r.rank
                    FROM ranked r JOIN dated d USING (chunk_id)"""
    sql["vector_date_postfilter"] = with_(
        *QUESTIONS, VECTORS, DATED, topk("vectors", q.TOP_K), final=f"{dated_rows} WHERE {IN_DATES}"
    )
    sql["vector_date_prefilter"] = with_(
        *QUESTIONS, VECTORS, DATED, topk("dated", q.TOP_K, where=IN_DATES), final=dated_rows
    )
    sql["vector_metadata_filter"] = with_(
        PASSAGES, CHUNK_STORE,
        final="""SELECT chunk_id, ticker, section, chunk_index FROM chunks
                 WHERE ticker IN ('SRC3', 'SRC7') AND section = 'en' AND form_type = '10-K'""",
    )
    sql["passage_topk"] = with_(
        *SEARCHED,
        final="SELECT query_id, chunk_id, document, ticker, section, round(score, 6) AS score, rank FROM found",
    )
    sql["context_budget"] = with_(
        *SEARCHED,
        final="SELECT query_id, rank, chunk_id, tokens_used, tokens_used <= 1200 AS in_context FROM budgeted",
    )
    sql["prompt_table"] = with_(
        *SEARCHED, _contexts(1200, False), PROMPTED,
        final=f"SELECT query_id, question, context, {_prompt(fv.ANSWER_TEMPLATE)} AS prompt FROM prompted",
    )
    sql["ask_questions"] = with_(
        *SEARCHED, _contexts(1200, False), PROMPTED,
        "sources AS (SELECT query_id, count(*) AS n_sources FROM found GROUP BY query_id)",
        final=f"""SELECT query_id, context, {_prompt(fv.ANSWER_TEMPLATE)} AS prompt, CAST(n_sources AS INTEGER) AS n_sources
                  FROM prompted LEFT JOIN sources USING (query_id)""",
    )
    sql["prompt_bullets"] = with_(
        *SEARCHED, _contexts(600, True), PROMPTED,
        final=f"SELECT query_id, {_prompt(fv.BULLET_TEMPLATE)} AS prompt FROM prompted",
    )
    sql["citations"] = with_(
        *SEARCHED,
        final="""SELECT query_id, rank - 1 AS position, ticker, company_name, filing_date, form_type, section,
                        accession_number, substr(document, 1, 400) AS text FROM found""",
    )

    sql["lexicon_sentiment"] = with_(
        *scored("documents", "doc_id"),
        final="SELECT d.doc_id, d.lang, s.pos, s.neu, s.neg, s.compound FROM documents d JOIN scored s USING (doc_id)",
    )
    demo = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in q.DEMO_LEXICON.items())
    sql["lexicon_table_sentiment"] = rf"""WITH base AS (
  SELECT DISTINCT term, ((length(term) * 7) % 9 - 4) / 2.0::DOUBLE AS valence
  FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS term FROM benchmark) WHERE term <> ''
), extra(term, valence) AS (VALUES {demo}
), lexicon AS (SELECT * FROM extra UNION ALL SELECT * FROM base WHERE term NOT IN (SELECT term FROM extra)
), words AS (
  SELECT doc_id, coalesce(valence, 0) AS v FROM (
    SELECT doc_id, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS w FROM (
      SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS w FROM documents)) LEFT JOIN lexicon ON term = lower(w) WHERE length(w) > 0
), sums AS (
  SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
         sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS g, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS z FROM words GROUP BY ALL)
SELECT doc_id, round(coalesce(p / (p + g + z), 0), 6) AS pos, round(coalesce(z / (p + g + z), 1), 6) AS neu,
       round(coalesce(g / (p + g + z), 0), 6) AS neg, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound
FROM documents LEFT JOIN sums USING (doc_id)"""
    sql["section_sentiment"] = with_(
        *DOC_SECTIONS,
        "cut AS (SELECT ticker, accession_number, section, text FROM found)",
        *scored("cut", "ticker, accession_number, section"),
        final="FROM scored",
    )

    sql["sentiment_upsert"] = """WITH batch AS (
  SELECT doc_id AS accession_number, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'body' END AS section,
         max(quality::DOUBLE) AS compound, 'new' AS origin FROM labels GROUP BY ALL)
FROM batch
UNION ALL
SELECT doc_id, 'body', n_chars::DOUBLE, 'old' FROM documents
WHERE doc_id NOT IN (SELECT accession_number FROM batch WHERE section = 'body')"""
    labelled = "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id::VARCHAR = accession_number)"
    sql["chunk_upsert"] = with_(
        PASSAGES, CHUNK_STORE,
        final=f"""SELECT chunk_id, accession_number, chunk_index,
                         CASE WHEN chunk_index < 2 AND {labelled} THEN 'New: ' || document ELSE document END AS document FROM chunks""",
    )
    sql["chunk_replace"] = with_(
        PASSAGES, CHUNK_STORE,
        "batch AS (SELECT * FROM chunks WHERE chunk_index < 2 AND " + labelled + ")",
        final="""SELECT chunk_id, accession_number, chunk_index FROM chunks
                 WHERE accession_number NOT IN (SELECT accession_number FROM batch)
                 UNION ALL SELECT chunk_id, accession_number, chunk_index FROM batch""",
    )
    stored = (PASSAGES, CHUNK_STORE, STORE)
    sql["store_stats"] = with_(*stored, final="SELECT count(*) AS total_chunks FROM store")
    sql["filing_summary"] = with_(
        *stored,
        final="""SELECT ticker, any_value(company_name) AS company_name, any_value(filing_date) AS filing_date,
                        any_value(form_type) AS form_type, string_agg(DISTINCT section, ', ' ORDER BY section) AS sections,
                        count(*) AS chunk_count, accession_number FROM store GROUP BY ticker, accession_number""",
    )
    sql["distinct_tags"] = with_(
        *stored,
        final="""SELECT DISTINCT 'ticker' AS kind, ticker AS tag FROM store
                 UNION ALL SELECT DISTINCT 'section', section FROM store""",
    )
    sql["section_reader"] = with_(
        PASSAGES, CHUNK_STORE,
        """firsts AS (
  SELECT * FROM chunks)""",
        final="""SELECT accession_number, section, count(*) AS n_chunks,
                        string_agg(document, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM firsts GROUP BY 1, 2""",
    )

    sql["one_ticker_summary"] = f"FROM ({sql['filing_summary']}) WHERE ticker = 'SRC3'"
    sql["series_store"] = sql["macro_monthly_last"]
    sql["panel_store"] = sql["macro_panel"]
    sql["observations_csv"] = with_(
        OBS,
        final="SELECT series_id, obs_date, value FROM obs WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'",
    )
    sql["vectors_csv"] = """SELECT vec_id, len(v) AS n, round(sqrt(list_dot_product(v, v)), 6) AS norm, v[1] AS first, v[-1] AS last
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""
    sql["sentiment_dates"] = """SELECT 'C' || o_custkey AS ticker, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS filing_date,
       o_orderkey::VARCHAR AS section, o_totalprice AS compound FROM orders"""
    sql["ticker_filings"] = f"""WITH asked AS (
  SELECT p_partkey, 'CUSTOMER#' || lpad(p_partkey::VARCHAR, 9, '0') AS ticker FROM part),
found AS (SELECT a.ticker, c.* FROM asked a JOIN customer c ON upper(c.c_name) = a.ticker),
index AS ({sql["filing_index"]})
SELECT i.cik, i.form_type, i.accession_number, i.filing_date, i.primary_document, i.document_url, i.index_url, f.ticker,
       CASE WHEN f.c_acctbal >= 0 THEN f.c_mktsegment ELSE f.ticker END AS company_name, '' AS reason
FROM index i JOIN found f ON i.cik = lpad(f.c_custkey::VARCHAR, 10, '0')
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, ticker, NULL, 'unknown ticker' FROM asked
WHERE ticker NOT IN (SELECT upper(c_name) FROM customer)"""

    stops = ", ".join(_str(w) for w in fv.FILING_STOP_WORDS)
    sql["tfidf"] = rf"""WITH words AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stops})) AS ws
  FROM documents),
terms AS (
  SELECT doc_id, unnest(ws) AS term FROM words
  UNION ALL
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM words)),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocabulary AS (
  SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM counted, n GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.9 * any_value(n.n)
  ORDER BY sum(tf) DESC, term LIMIT 5000),
raw AS (SELECT doc_id, term, tf, tf * idf AS w FROM counted JOIN vocabulary USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""
    sql["sample_rows"] = """SELECT doc_id, lang, source FROM documents
ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 100"""
    sql["sample_by_lang"] = """SELECT doc_id, lang, source FROM documents
WHERE ('0x' || substr(md5('42|' || doc_id::VARCHAR), 1, 8))::BIGINT
      < CASE lang WHEN 'en' THEN 429496730 WHEN 'de' THEN 2147483648 WHEN 'fr' THEN 1073741824 ELSE 0 END"""
    sql["first_rows"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5"
    return sql
