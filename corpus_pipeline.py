"""From raw documents to packed training sequences, in stages that each call one operator.

Every stage takes all documents that the one before it kept, and its decisions take effect: stages
1 to 4 return the columns of ``documents``, the last one returns token pieces with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm import decontamination, line_dedup, minhash_dedup, packing, quality
from fathomline.llm.queries import tokenizer_path
from fathomline.llm.shared import spare, stored
from fathomline.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts (a score of 0.7 or more).

    Null texts are judged as empty ones, very long ones whole, and repeated rows alike; columns of any name
    stay. Without labels to learn from, or without documents, nothing is rejected.
    """
    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    if ranking is None:  # nothing to learn from, so nothing to reject by
        return docs
    (score,) = spare(docs, "__score")
    return quality.scored(docs, ranking, score).where(F.col(score) >= ranking.cut).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; the first document with such a line keeps it.

    So a document copied over many sites stays whole once. One of which nothing is left goes. ``n_chars``
    follows the text. Null and empty texts stay as they are, repeated rows are treated alike, columns of any
    name stay, and no documents give no documents.
    """
    lines, removed = spare(docs, "__n_lines", "__n_removed")
    found = line_dedup.deduplicate(docs, keep_first=True, counts=(lines, removed))
    rest = found.where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    size = F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", size).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts without words, null texts and rows without an id stay; of repeated rows one stays; columns of any name stay.
    """
    return minhash_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a window of a benchmark item.

    Null and empty texts stay, repeated rows stay or go together, and columns of any name stay.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are empty, so they are one end mark; texts over a sequence are cut; repeated rows are packed each.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Ranking, tokenizing and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
