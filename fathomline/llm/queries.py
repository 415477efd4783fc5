"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import (
    chat_format, conversation_repair, decontamination, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, packing,
    phrase_mining, quality, span_dedup, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that pages are judged by: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def tokenizer_path() -> str:
    """The vocabulary that documents are packed with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(table(spark, d, "documents"))


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = line_dedup.deduplicate(table(spark, d, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(table(spark, d, "documents"))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontamination.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_span_dedup(spark: SparkSession, d: str) -> DataFrame:
    return span_dedup.deduplicate(table(spark, d, "documents"))


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages"), [url_filter.site_rule(*r) for r in URL_RULES])


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_path())


def op9_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash_dedup.groups(table(spark, d, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


def op11_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return conversation_repair.report(conversation_repair.damage(turns), turns)


def op12_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    quoted = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digest(chat_format.format_turns(turns.union(quoted)))


def op13_phrase_mining(spark: SparkSession, d: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, d, "documents"))


def registered() -> dict[str, Query]:
    own = (
        op1_license_scan, op2_line_dedup, op3_language_id, op4_decontamination, op5_span_dedup,
        op6_quality, op7_url_filter, op8_packing, op9_embedding_dedup, op10_minhash_dedup,
        op11_conversation_repair, op12_chat_format, op13_phrase_mining,
    )
    return {f.__name__: f for f in own}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINES = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), bad AS (
  SELECT trim(line, ' ') AS k FROM l WHERE length(trim(line, ' ')) >= {line_dedup.MIN_CHARS}
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), m AS (SELECT l.*, bad.k FROM l LEFT JOIN bad ON trim(l.line, ' ') = bad.k
), r AS (
  SELECT doc_id, count(*) AS n_lines, count(k) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k IS NULL), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE kept END AS text
FROM documents d LEFT JOIN r USING (doc_id)
"""

_WINDOWS = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), p AS (SELECT item_id, w, least({decontamination.WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0
), f AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM p
), wi AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM f
), dn AS (SELECT d.doc_id, d.w, ns.n, unnest(range(1, len(d.w) - ns.n + 2)) AS s FROM d, (SELECT DISTINCT n FROM wi) ns WHERE len(d.w) >= ns.n
), h AS (
  SELECT dn.doc_id, dn.s, dn.n, wi.item_id FROM dn JOIN wi ON wi.n = dn.n AND wi.k = array_to_string(dn.w[dn.s : dn.s + dn.n - 1], ' ')
), c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontamination.PARTS} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_URLS = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}
), best AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id
), own AS (
  SELECT page_id, '.' || rtrim(regexp_replace(regexp_replace(translate(url_decode(host), '{UPPER}', '{LOWER}'), '^.*@', ''), ':[0-9]*$', ''), '.') || '/' AS site FROM p
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(site, '[.]({"|".join(url_filter.TRUSTED)})/$') THEN 'allow'
         WHEN regexp_matches(site, '({"|".join(url_filter.BLOCKED_ANYWHERE)})|({"|".join(url_filter.BLOCKED_ENDINGS)})[-./]|[-.]({"|".join(url_filter.BLOCKED_WORDS)})[-./]')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN own USING (page_id) LEFT JOIN best b USING (page_id)
"""

_VECTORS = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_cosine_similarity(a.x, b.x) >= {embedding_dedup.COSINE}
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(links, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

_SHINGLES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT doc_id, w, least(4, len(w)) AS n FROM w WHERE len(w) > 0
), f AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM p
), s AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + n - 1], ' ') AS k FROM f
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT m.a, m.b FROM m JOIN z x ON x.doc_id = m.a JOIN z y ON y.doc_id = m.b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

_CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, sha256(text) AS hash, regexp_replace(regexp_replace(text, '<(\\*)(\|im_start\|>|\|im_end\|>|/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS escaped FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, hash)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, hash) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_PHRASES = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM d
), o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM p
), g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM o, (SELECT unnest(range(1, {phrase_mining.LONGEST} + 1)) AS k) WHERE s + k - 1 <= len(w)
), f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrase_mining.LEAST}
), cut AS (SELECT *, unnest(range(1, k)) AS j FROM c
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.j, x.f AS l, y.f AS r, 1000000 * cut.a * cut.a // (x.f * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1 : j], ' ')
           JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1 : cut.k], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM c WHERE k = 3) h
    WHERE h.lang = b.lang AND h.sub = b.phrase AND 100 * h.a >= {phrase_mining.COVERED} * b.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= {phrase_mining.TOP}
"""


def statements() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {
        "op2_line_dedup": _LINES, "op4_decontamination": _WINDOWS, "op7_url_filter": _URLS,
        "op9_embedding_dedup": _VECTORS, "op10_minhash_dedup": _SHINGLES, "op12_chat_format": _CHATS, "op13_phrase_mining": _PHRASES,
    }
