"""Line dedup by distinct-site spread.

Each line's sites go into a HyperLogLog sketch per line hash; sketches merge as the aggregation
merges, so a line that half of the corpus has costs one sketch per task. Lines far from the threshold
are decided by the sketch, lines near it by an exact distinct count. Lines of many sites are
boilerplate and are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from .shared import cut, spare

MIN_SITES = 8
MIN_CHARS = 16
#: 2^10 registers: a standard error of 3.3 percent; the band is over nine of them.
LOG_REGISTERS = 10
BAND = 0.3
#: Line hashes that may be broadcast: 8 bytes each, so 16 MB.
BROADCAST_LINES = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_rows(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """(doc, doc_id, pos, line, site) of every line that counts; ``line`` is a hash of its text."""
    key = F.xxhash64("doc_id", "text").alias("doc")
    source = docs.select(key, F.col("doc_id"), F.xxhash64(F.col(site).cast("string")).alias("__site"), F.col(site).isNull().alias("__none"), F.posexplode(F.concat(_lines(F.col("text")), F.array().cast("array<string>"))).alias("pos", "__line"))
    own = F.trim("__line")
    return source.where(F.char_length(own) >= min_chars).select(
        "doc", "doc_id", "pos", F.xxhash64(own).alias("line"), F.when(~F.col("__none"), F.col("__site")).alias("site")
    )


def _semi(rows: DataFrame, lines: DataFrame) -> DataFrame:
    small = lines.count() <= BROADCAST_LINES
    return rows.join(F.broadcast(lines) if small else lines, "line", "left_semi")


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line): hashes of the lines that ``min_sites`` distinct sites or more have."""
    rows = _line_rows(docs, site, min_chars).select("line", "site")
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    estimates = sketches.select("line", F.hll_sketch_estimate("sketch").alias("n"))
    likely = cut(estimates.where(F.col("n") >= min_sites * (1 - BAND)))
    sure = likely.where(F.col("n") > min_sites * (1 + BAND)).select("line")
    near = likely.where(F.col("n") <= min_sites * (1 + BAND)).select("line")
    exact = _semi(rows, near).groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("line")
    return sure.union(exact)


def deduplicate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, keep_first: bool = False,
    counts: tuple[str, str] = ("__n_lines", "__n_removed"),
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, site) with lines of ``min_sites`` sites or more taken out of ``text``.

    All columns stay, whatever their names; the two ``counts`` (lines, removed lines) are added and must
    be names that ``docs`` does not have. Lines end at a newline and are
    compared without spaces around them; lines under ``min_chars`` characters always stay. A
    null site is none. With ``keep_first`` a line stays in the document with the smallest id
    that has it, so that documents copied over many sites are not lost. Null texts stay null with
    no lines; a text all of whose lines go becomes empty. Repeated rows are treated alike. The time for a
    text grows with its length, however many of its lines go. An empty table gives an empty table.
    """
    lines = cut(spread_lines(docs, site, min_sites, min_chars))
    marks = _semi(_line_rows(docs, site, min_chars), lines)
    if keep_first:
        first = cut(marks.groupBy("line").agg(F.min("doc_id").alias("first")))
        small = first.count() <= BROADCAST_LINES
        marks = marks.join(F.broadcast(first) if small else first, "line").where(F.coalesce(F.col("doc_id") > F.col("first"), F.col("first").isNotNull()))
    doc, places = spare(docs, "__doc", "__gone")
    gone = marks.groupBy("doc").agg(F.collect_set("pos").alias(places)).withColumnRenamed("doc", doc)
    met = docs.withColumn(doc, F.xxhash64("doc_id", "text")).join(gone, doc, "left")
    # places that stay, by a set difference, then the lines at them
    kept = let(_lines(F.col("text")), lambda own: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), places), lambda k: F.get(own, k)), "\n"
    ))
    return met.select(
        *(F.when(F.col(places).isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias(counts[0]),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias(counts[1]),
    )
