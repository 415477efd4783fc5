"""Readers of landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import vectors as vx


# Session setting: the number of tasks that texts are dealt out to before row-local work.
TEXT_PARTITIONS = "spark.fathomline.textPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, as it is scanned.

    A file with one row group is one task however small the splits are. A session over such
    files (local runs) can set ``spark.fathomline.textPartitions``; it is unset by default.
    """
    df = table(spark, folder, name)
    parts = spark.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """The landed ticker object ({"0": {...}, "1": {...}}) as rows with their position."""
    entries = f"map<string,struct<{schemas.TICKER_MAP.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.explode(F.map_entries(F.from_json("value", entries))).alias("e")
    ).select(F.expr("try_cast(e.key as bigint)").alias("pos"), "e.value.*")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUBMISSIONS).option("multiLine", True).json(path)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML files, one row each, keyed by file name without extension."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(name.alias("accession_number"), F.col("value").alias("html"))


def observations(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """(series_id, obs_date, value) inside inclusive bounds, filtered in the scan."""
    from ..operators.series import observations as bounded

    reader = spark.read.schema(schemas.OBSERVATIONS)
    rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return bounded(rows, start, end)


def vectors_csv(spark: SparkSession, path: str, schema: str, vec: str = "embedding") -> DataFrame:
    """CSV whose vector column holds ``[a b c]``."""
    raw = (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    return raw.withColumn(vec, vx.text_to_vector(F.col(vec)))


def sentiment(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored scores with dates read leniently, or None."""
    df = read_if_exists(spark, path)
    return df if df is None else with_lenient_dates(df)


def with_lenient_dates(df: DataFrame, date: str = "filing_date") -> DataFrame:
    """Text or timestamps as timestamps; what cannot be read becomes null."""
    return df.withColumn(date, F.try_to_timestamp(F.col(date).cast("string")).cast("timestamp_ntz"))
