"""Sentence chunks: overlapping by size, or fixed groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as tx
from .binding import let


def overlap_chunks(
    text: Column, size: int = 800, overlap: int = 2, min_chars: int = 50
) -> Column:
    """Array of chunks of about ``size`` characters that share ``overlap`` sentences.

    Sentences are added until the next one would pass ``size``; lengths leave out the
    joining spaces. ``overlap=0`` carries nothing over. Chunks up to ``min_chars`` are dropped.
    """
    # The walk carries sentence numbers only, so a long text never drags its chunks along:
    # ``cuts`` holds (first, end) of each closed chunk, ``first`` opens the current one.
    begin = F.struct(
        F.array().cast("array<bigint>").alias("cuts"),
        F.lit(0).alias("first"),
        F.lit(0).alias("i"),
        F.lit(0).alias("n"),
    )
    width = F.lit(1 << 32)

    def walk(ss: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            full = (acc["n"] + F.length(s) > size) & (acc["i"] > acc["first"])
            first = F.when(full, F.greatest(acc["i"] - overlap, acc["first"])).otherwise(acc["first"])
            kept = F.aggregate(
                F.slice(ss, F.greatest(acc["i"] - overlap, acc["first"]) + 1, F.least(F.lit(overlap), acc["i"] - acc["first"])),
                F.lit(0),
                lambda n, k: n + F.length(k),
            )
            return F.struct(
                F.when(full, F.array_append(acc["cuts"], acc["first"] * width + acc["i"]))
                .otherwise(acc["cuts"]).alias("cuts"),
                first.alias("first"),
                (acc["i"] + 1).alias("i"),
                (F.when(full, kept).otherwise(acc["n"]) + F.length(s)).alias("n"),
            )

        def finish(acc: Column) -> Column:
            last = F.when(acc["i"] > acc["first"], F.array(acc["first"] * width + acc["i"]))
            return F.concat(acc["cuts"], F.coalesce(last, F.array().cast("array<bigint>")))

        def passage(cut: Column) -> Column:
            first = F.shiftright(cut, 32).cast("int")
            end = (cut % width).cast("int")
            return F.array_join(F.slice(ss, first + 1, end - first), " ")

        texts = F.transform(F.aggregate(ss, begin, add, finish), passage)
        return F.filter(texts, lambda c: F.length(c) > min_chars)

    return let(tx.sentences(text), walk)


def fixed_groups(items: Column, size: int = 10) -> Column:
    """Consecutive groups of ``size`` items; the last one holds the remainder."""

    def grouped(all_items: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_items), F.lit(1)) - 1) / size).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * size + 1, size)
        )

    return F.filter(let(items, grouped), lambda g: F.size(g) > 0)


def group_text(sentences: Column) -> Column:
    """A group as one passage: joined, double spaces halved once, a space after a glued full stop."""
    joined = tx.strip(F.replace(F.array_join(sentences, ""), F.lit("  "), F.lit(" ")))
    return F.regexp_replace(joined, r"\.([A-Z])", ". $1")


def chunk_id(ticker: Column, accession: Column, section: Column, index: Column) -> Column:
    """Stable id of a chunk, so that a repeated write replaces it."""
    return F.md5(
        F.concat_ws("_", F.upper(ticker), accession, section, index.cast("string"))
    )
