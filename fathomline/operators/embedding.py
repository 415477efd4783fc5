"""Text to vectors: a built-in hashed encoder that stays in the JVM, and a hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def hashed_embedding(
    df: DataFrame, text: str, dim: int = 384, out: str = "embedding", idf: bool = False
) -> DataFrame:
    """Unit vectors of hashed word counts: deterministic, and equal on every machine.

    A word's slot comes from its md5. With ``idf`` words are weighted by rarity over ``df``,
    which adds one pass over it.
    """
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    slots = F.transform(
        F.filter(words, lambda w: F.length(w) > 0), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % dim).cast("string")
    )
    hashed = df.withColumn("_slots", slots)
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_slots", outputCol="_counts"
    )
    counted = counter.transform(hashed)
    if idf:
        counted = (
            IDF(inputCol="_counts", outputCol="_weighted").fit(counted).transform(counted)
            .drop("_counts").withColumnRenamed("_weighted", "_counts")
        )
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_slots", "_counts", "_unit")


def model_embedding(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Callable[[list[str]], list]],
    batch_size: int = 64,
    out: str = "embedding",
) -> DataFrame:
    """Vectors of any model. ``make_encoder`` runs once per task and returns texts -> vectors (rows of one length)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    at, arrow = df.columns.index(text), to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                piece = batch.slice(i, batch_size)
                vectors = np.asarray(encoder(piece.column(at).to_pylist()), dtype=np.float32)
                ends = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
                column = pa.ListArray.from_arrays(ends, vectors.ravel()).cast(arrow.field(out).type)
                yield pa.RecordBatch.from_arrays([*piece.columns, column], schema=arrow)

    return df.mapInArrow(encode, schema)


def random_vectors(spark, n: int, dim: int = 768, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Normally distributed vectors for scan-cost runs (bench data, not a query)."""
    numbers = F.array(*[F.randn(seed + i).cast("float") for i in range(dim)])
    rows = spark.range(n, numPartitions=partitions) if partitions else spark.range(n)
    return rows.select(F.col("id").alias("vec_id"), numbers.alias("embedding"))
