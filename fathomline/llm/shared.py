"""Helpers of the training-data operators: lineage cuts, hot keys, bounded caches."""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage, ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key counts as hot from one row in so many; at most so many keys can be hot.
HOT_SHARE = 1000


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder beside the checkpoints and read it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def attach(rows: DataFrame, facts: DataFrame, key: str, copies: str, how: str = "left") -> DataFrame:
    """Left (or inner) join of ``facts`` (one row per ``key``, with the number of rows in ``copies``).

    Keys that hold over 1/1000 of all rows are joined by broadcast: there are at most 1,000 of
    them whatever the size of the table. All others are joined by a shuffle, in which no key is hot.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * HOT_SHARE > F.lit(total)
    names = [c for c in facts.columns if c not in (key, copies)]
    hot_facts = facts.where(hot).select(key, F.struct(*names).alias("__hot"))
    cold_facts = facts.where(~hot).select(key, F.struct(*names).alias("__cold"))
    near = rows.join(F.broadcast(hot_facts), key, "left")
    # rows of hot keys need no partner: their own spread-out key keeps them off one task
    near = near.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)))
    found = near.where("__hot is not null").select(*rows.columns, *(F.col(f"__hot.{c}").alias(c) for c in names))
    rest = near.where("__hot is null").drop("__hot", "__key").join(cold_facts, key, how)
    return found.unionByName(rest.select(*rows.columns, *(F.col(f"__cold.{c}").alias(c) for c in names)))


def ordered_digest(rows: DataFrame, key: str, order: list[str], texts: list[str], sums: list[str], glue: str = "") -> DataFrame:
    """(key, sha256 of each of ``texts`` fed row by row in ``order``, sum of each of ``sums``) per key.

    ``glue`` is fed between texts.

    Rows stream through a task in order, which holds one hash per column and never a key's texts.
    Null texts feed nothing. A hash has to read its rows in sequence, so a key is one task's work.
    """
    fields = [rows.schema[key], *(T.StructField(c, T.StringType()) for c in texts), *(T.StructField(c, T.LongType()) for c in sums)]

    def digests(batches):
        import pyarrow as pa

        state, begun = None, []  # key, hashes, sums of the key that is being read; which hashes were fed
        names = [key, *texts, *sums]

        def closed(done):
            columns = list(zip(*((k, *(h.hexdigest() for h in hashes), *totals) for k, hashes, totals in done)))
            types = [batch.column(key).type, *[pa.string()] * len(texts), *[pa.int64()] * len(sums)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            done = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in names)):
                if state is None or state[0] != k:
                    if state is not None:
                        done.append(state)
                    state, begun = (k, [hashlib.sha256() for _ in texts], [0] * len(sums)), [False] * len(texts)
                for i, (h, text) in enumerate(zip(state[1], values)):
                    if text is not None:
                        h.update((glue * begun[i] + text).encode())
                        begun[i] = True
                for i, value in enumerate(values[len(texts) :]):
                    state[2][i] += value or 0
            if done:
                yield closed(done)
        if state is not None:
            yield closed([state])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *texts, *sums)
    return dealt.mapInArrow(digests, T.StructType(fields))


class Cache(dict):
    """A memo over a pure function that starts anew when it holds ``limit`` entries."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
