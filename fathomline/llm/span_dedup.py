"""Substring dedup over sliding sentence spans.

Runs of consecutive sentences are hashed; runs meet globally by hash; sentences covered by a run
that is not the first of its hash are removed. The shortest run (at least two sentences) with enough words
that starts at each sentence is hashed, and the shortest one that ends at it. So the same passage gives the
same runs wherever it stands, each of its sentences is in one of them, and longer runs need no hash: they
repeat where these do. Text without sentence marks is cut at words chosen by their own hash.

Only (hash, document, position) travels: one aggregate with a map-side combine finds the first document
of each hash, one join finds the runs to remove. A hash that many documents share is one row on the
small side of that join, and its rows on the other side can be split.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

SENTENCES = 2
WORDS = 20
#: An unmarked sentence of more words is cut.
LONG_SENTENCE = 30
_SENTENCE = re.compile(r"[^.!?\n。！？]*[.!?\n。！？]+\s*|[^.!?\n。！？]+")
#: Scripts that do not part words by spaces (Thai, Lao, Khmer, kana, Chinese characters): each letter is a word.
_LETTER = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_LETTER}]")
_WORD = re.compile(f"[{_LETTER}]|[^\\s{_LETTER}]+")
_TOKEN = re.compile(f"(?:[{_LETTER}]|[^\\s{_LETTER}]+)\\s*")
#: The id that orders rows without one.
_LAST = 2**63 - 1


def splitter(text: str):
    """What splits the sentences of a text into words."""
    return str.split if text.isascii() or not _UNSPACED.search(text) else _WORD.findall


def sentences(text: str) -> list[str]:
    """Pieces of a text that give it back when joined; leading white space belongs to the first."""
    out: list[str] = []
    split = splitter(text)
    least = 2 * LONG_SENTENCE if split is str.split else LONG_SENTENCE
    for piece in _SENTENCE.findall(text):
        if len(piece) > least and len(split(piece)) > LONG_SENTENCE:
            held: list[str] = []
            lead = piece[: len(piece) - len(piece.lstrip())]
            for token in _TOKEN.findall(piece):
                held.append(token)
                if len(held) == LONG_SENTENCE or xxhash.xxh32_intdigest(token.strip().lower()) % 12 == 0:
                    out.append(lead + "".join(held))
                    held, lead = [], ""
            if held:
                out.append(lead + "".join(held))
        else:
            out.append(piece)
    return out


def runs(text: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the shortest runs with enough words that start or end at each sentence, by place."""
    split = splitter(text)
    own = [split(s.lower()) for s in sentences(text)]
    at = [k for k, w in enumerate(own) if w]
    hashes = b"".join(xxhash.xxh3_64_digest(" ".join(own[k])) for k in at)
    sizes = [len(own[k]) for k in at]
    found, end, held = [], 0, 0
    for first in range(len(at)):
        while end < len(at) and (held < least_words or end - first < least_sentences):
            held += sizes[end]
            end += 1
        if held < least_words or end - first < least_sentences:
            break
        found.append((first, end))
        held -= sizes[first]
    from_here, first, held = set(found), 0, 0
    for end in range(1, len(at) + 1):
        held += sizes[end - 1]
        while end - first > least_sentences and held - sizes[first] >= least_words:
            held -= sizes[first]
            first += 1
        if held >= least_words and end - first >= least_sentences and (first, end) not in from_here:
            found.append((first, end))
    return [(xxhash.xxh3_64_intdigest(hashes[8 * a : 8 * b]) - (1 << 63), at[a], at[b - 1] - at[a] + 1) for a, b in sorted(found)]


def span_rows(docs: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """(run, row, doc_id, first, n, again) of every run; ``again`` where the document had the hash before."""

    def work(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seen = set()
                for h, first, n in runs(text.as_py() or "", least_sentences, least_words):
                    for c, v in zip(columns, (h, row, doc, first, n, h in seen)):
                        c.append(v)
                    seen.add(h)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["run", "row", "doc_id", "first", "n", "again"])

    source = docs.select(_row(), _own_id(), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, "run long, row long, doc_id long, first int, n int, again boolean")


def _row() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def _own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id")


def _place() -> Column:
    """One number that orders rows by id and then by a hash of the row: rows of one id are documents of their own."""
    low = F.col("row").bitwiseAND(F.lit(_LAST))
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(str(2**63)).cast("decimal(20,0)") + low.cast("decimal(19,0)")


def repeated(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """(row, first, n, first_doc): runs that are not the first of their hash, and the document that has the first."""
    spans = cut(span_rows(docs, least_sentences, least_words))
    again = spans.where("again").select("row", "first", "n", F.col("doc_id").alias("first_doc"))
    ids = docs.select(_own_id(), _row()).groupBy("doc_id").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    if ids.where("least < most").isEmpty():  # an id tells rows apart, so ids alone order the runs
        whole = spans.groupBy("run").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        shared = whole.where("first_doc < last_doc").select("run", "first_doc")
        later = spans.where("not again").join(shared, "run").where("doc_id > first_doc")
    else:
        place = _place().cast("decimal(38,0)")
        whole = spans.groupBy("run").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.min("doc_id").alias("first_doc"))
        shared = whole.where("first_place < last_place").select("run", "first_place", "first_doc")
        later = spans.where("not again").join(shared, "run").where(place > F.col("first_place"))
    return later.select("row", "first", "n", "first_doc").union(again)


def deduplicate(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, first_docs, text) of every row of ``docs`` (doc_id, text).

    The first occurrence of a run is the one in the document with the smallest id, and there the
    earliest. ``text`` lacks the removed sentences and is otherwise unchanged; ``first_docs`` lists the
    ids that keep them. Words are compared lower-cased, white space does not count; in scripts without
    spaces each letter is a word. Each row is a document: of rows that share an id, or have none (these come
    last), one has the first occurrence, and of equal rows one is taken to come first. Null texts stay
    null, with no sentences. Very long texts are read whole by the task that has them. Other columns are
    not read.
    """
    covers = (
        repeated(docs, least_sentences, least_words)
        .groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    )
    own = docs.select(_row(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    equal = cut(own.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1"))
    none = F.array().cast("array<long>")

    def work(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans, copy in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                raw = text.as_py()
                own = sentences(raw) if raw else []
                if copy > 1 and raw:  # every run of a later copy is in the first one
                    spans = [{"first": first, "n": n} for _, first, n in runs(raw, least_sentences, least_words)]
                drop = {k for s in spans or [] for k in range(s["first"], s["first"] + s["n"])}
                total.append(len(own)), gone.append(len(drop))
                kept.append("".join(s for k, s in enumerate(own) if k not in drop) if drop else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column(3), pa.array(kept, pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "first_docs", "text"],
            )

    def covered(rows: DataFrame) -> DataFrame:
        return rows.join(covers, "row", "left").withColumn("first_docs", F.coalesce("first_docs", none))

    once = F.lit(1).cast("long").alias("copy")
    if equal.isEmpty():
        rows = covered(own).select("doc_id", "text", "spans", "first_docs", once)
    else:
        single = covered(own.join(equal, "row", "left_anti")).select("doc_id", "text", "spans", "first_docs", once)
        # equal rows come together before they are told apart again, so their number is no one's burden
        one = own.join(equal, "row").groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "copies")))
        each = covered(one).select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        again = F.array_sort(F.array_union("first_docs", F.when(F.col("doc_id").isNull(), none).otherwise(F.array("doc_id"))))
        rows = single.unionByName(each.select("doc_id", "text", "spans", F.when(F.col("copy") == 1, F.col("first_docs")).otherwise(again).alias("first_docs"), F.col("copy").cast("long").alias("copy")))
    shown = F.filter("first_docs", lambda d: d < _LAST)
    done = rows.select("doc_id", "text", "spans", shown.alias("first_docs"), "copy").mapInArrow(
        work, "doc_id long, n_sentences long, n_removed long, first_docs array<long>, text string"
    )
    return done.withColumn("first_docs", F.when(F.col("n_removed") > 0, F.col("first_docs")).otherwise(F.array().cast("array<long>")))
