"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

A window is ``window`` consecutive words of an item (all its words where it has fewer). A document
can only hold a window whole if it holds the window's rarest word, so that word is the window's
necessary prefix: words are counted over all documents, every window is filed under its rarest
one, and only words of documents that are such a prefix are looked at. Bounds come next: a
neighbour of the word must agree, and the window must lie within the document. What is left is
compared word by word, over a slice as long as the window.

Each document word is visited once per pass, inside one stage: split, explode, probe the
broadcast prefixes, compare. Only occurrences and one row per document are shuffled. Prefixes are
broadcast in blocks of a bounded size, one pass over the documents each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .shared import attach, cut, spare

WINDOW = 13
#: Contaminated from one word in so many.
PARTS = 20
#: Bytes of prefixes (or of item words) that one broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Bytes of word counts up to which they are broadcast to the item words; beyond, only the hottest words are.
COUNT_BYTES = 32 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that lower() would change besides A-Z.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z: runs of a-z, 0-9 and characters beyond ASCII; null has none."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~F.regexp_like(text, F.lit(OTHER_CAPITALS))
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def _blocks(df: DataFrame, size: Column, *key: str) -> list[DataFrame]:
    """``df`` in parts that hold about BROADCAST_BYTES at most each."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = 1 + int(total) // BROADCAST_BYTES
    return [df.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) for k in range(n)] if n > 1 else [df]


def word_counts(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of the items occurs in all documents."""
    vocabulary = cut(items.select(F.explode("words").alias("word")).distinct())
    spread = docs.select(F.explode(F.concat(words(F.col(text)), F.array().cast("array<string>"))).alias("word"))
    counts = None
    for block in _blocks(vocabulary, F.octet_length("word") + 64, "word"):
        part = spread.join(F.broadcast(block), "word").groupBy("word").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.union(part)
    return counts


def prefixes(docs: DataFrame, items: DataFrame, window: int, text: str = "text") -> DataFrame:
    """Each item's windows under their rarest words: (word, item_id, words, at, length, starts)."""
    places = items.select("item_id", "words", F.posexplode("words").alias("at", "word"))
    counts = cut(word_counts(docs, items, text))
    size = counts.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    if size <= COUNT_BYTES:
        known = places.join(F.broadcast(counts), "word", "left")
    else:
        held = places.groupBy("word").agg(F.count("*").alias("places"))
        known = attach(places, held.join(counts, "word", "left"), "word", "places")
    counted = (
        known.groupBy("item_id", "words")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranked"))
    )
    length = F.least(F.lit(window), F.size("words"))
    rarest = lambda s: F.array_min(F.transform(F.slice("ranked", s + 1, length), lambda x: F.struct(x["n"], x["at"])))["at"]
    filed = counted.select(
        "item_id", "words", length.alias("length"),
        F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda s: F.struct(s.alias("start"), rarest(s).alias("at")))).alias("w"),
    )
    return (
        filed.groupBy("item_id", "words", "length", F.col("w.at").alias("at")).agg(F.collect_list("w.start").alias("starts"))
        .select(F.element_at("words", F.col("at") + 1).alias("word"), "item_id", "words", "at", "length", "starts")
    )


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, start, length) of every occurrence of a window in ``docs``.

    Besides, one row per document, with null item_id and start and length 0.
    """
    own = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    own = cut(own)
    filed = cut(prefixes(docs, own, window, text))
    # the empty word, which no text has, stands at the end of every document and meets this row
    end = filed.sparkSession.range(1).select(
        F.lit("").alias("word"), F.lit(None).cast(own.schema["item_id"].dataType).alias("item_id"),
        F.array().cast("array<string>").alias("words"), F.lit(0).alias("at"), F.lit(0).alias("length"), F.array(F.lit(0)).alias("starts"),
    )
    size = F.aggregate("words", F.lit(128), lambda n, w: n + F.octet_length(w) + 24) + 8 * F.size("starts")
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("own")
    )
    spread = source.select("*", F.posexplode(F.concat("own", F.array(F.lit("")))).alias("pos", "word"))
    neighbour = lambda by: F.get("own", F.col("pos") + by) == F.get("words", F.col("at") + by)
    found = None
    for k, block in enumerate(_blocks(filed, size, "word", "item_id", "at")):
        probe = block.unionByName(end) if k == 0 else block
        near = spread.join(F.broadcast(probe), "word").where((F.col("length") < 2) | neighbour(-1) | neighbour(1))
        placed = near.select("*", F.explode("starts").alias("s")).withColumn("start", F.col("pos") - F.col("at") + F.col("s"))
        inside = placed.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("own")))
        exact = inside.where(F.slice("own", F.col("start") + 1, "length") == F.slice("words", F.col("s") + 1, "length"))
        part = exact.select("doc_id", "text_hash", F.size("own").alias("n_words"), "item_id", F.when(F.col("length") > 0, F.col("start")).alias("start"), "length")
        found = part if found is None else found.union(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, parts: int = PARTS, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids, contaminated) of every row of ``docs`` (doc_id, text).

    A word inside any occurrence of a window of ``items`` (item_id, text) is hit; contaminated means
    that at least one word in ``parts`` is. Null and empty texts have no words; items without
    words have no window; repeated items count once; a null item id is left out of item_ids.
    Repeated rows are all returned. Empty tables give no occurrence or no rows; other columns are not read.
    """
    key = ["doc_id", "text_hash"]
    found = occurrences(docs, items, window, text)
    # counted in the tasks first, so a row that repeats very often comes to its group once a task
    once = found.groupBy(*key, "start", "length", "item_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n"))
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = once.withColumn("cover", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, "start"))))
    by_doc = covered.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("cover"), F.lit(0)).cast("long").alias("n_hit"),
        F.collect_set("item_id").alias("item_ids"), F.max(F.when(F.col("start").isNull(), F.col("n"))).alias("copies"),
    )
    share = (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))
    # repeated rows came together above; each gets its row again
    return by_doc.select(*key, "n_words", "n_hit", "item_ids", share.alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, parts: int = PARTS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table of items takes nothing away.
    """
    names = spare(docs, "__id", "__hash")
    bad = contamination(docs, items, window, parts).where("contaminated").select("doc_id", "text_hash").distinct().toDF(*names)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col("text")) == F.col(names[1]))
    return docs.join(bad, same, "left_anti")
