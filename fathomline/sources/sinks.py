"""Writers: series, panel, vector CSV, and keyed upserts on plain Parquet with a commit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as vx
from ..operators import stores
from .tables import path_exists


def write_series(monthly: DataFrame, path: str) -> None:
    """One partition folder per series; only the series of this write are replaced."""
    (
        monthly.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("series_id").parquet(path)
    )


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").parquet(path)


def write_vectors_csv(df: DataFrame, path: str, vec: str = "embedding") -> None:
    (
        df.withColumn(vec, vx.vector_to_text(F.col(vec)))
        .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )


class CommitLog:
    """The runs that readers may see: one row per run and table, written in one file after all data of the run.

    Tables of one store share a log, so a run that writes several of them becomes visible in all at once, and
    one that breaks off in none. Data of broken runs stay aside, unseen.
    """

    SCHEMA = "run string, seq bigint, name string, base boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def holds(self, run: str, name: str) -> bool:
        return not self.read().filter((F.col("run") == run) & (F.col("name") == name)).isEmpty()

    def commit(self, run: str, names: list[str], base: bool = False) -> None:
        """Makes a run visible. ``base`` says that earlier runs of its tables are no longer read."""
        last = self.read().agg(F.max("seq")).first()[0] or 0
        rows = [(run, last + 1, name, base) for name in names]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


class UpsertTable:
    """A Parquet table with one visible row per key, to which batches are only added.

    A batch is a folder of its own (``run=...``) that no later batch touches. Readers see the runs of the
    log, and of rows with one key the one of the newest run. Which rows are out of date is found over keys
    and run numbers alone; the rows themselves are then filtered by it. ``compact`` writes the visible rows
    as one run, from which reading starts. Each table has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], log: CommitLog | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.name = self.path.rsplit("/", 1)[-1]
        self.log = log or CommitLog(spark, f"{self.path}/_log")

    def _visible(self) -> DataFrame:
        """(run, seq) of the runs that are read, each once."""
        own = self.log.read().filter(F.col("name") == self.name)
        base = own.agg(F.max(F.when(F.col("base"), F.col("seq")))).first()[0] or 0
        return own.filter(F.col("seq") >= base).groupBy("run").agg(F.min("seq").alias("_seq"))

    def _runs(self, folder: str, visible: DataFrame) -> DataFrame | None:
        """Rows of the visible runs below ``folder``, with the schema of the newest."""
        newest = visible.orderBy(F.desc("_seq")).first()
        if newest is None or not path_exists(self.spark, f"{folder}/run={newest['run']}"):
            return None
        schema = self.spark.read.parquet(f"{folder}/run={newest['run']}").schema.add("run", "string")
        return self.spark.read.schema(schema).parquet(folder).join(visible, "run").drop("run")

    def read(self) -> DataFrame | None:
        visible = self._visible()
        rows = self._runs(self.path, visible)
        if rows is None:
            return None
        last = rows.groupBy(*self.keys).agg(F.max("_seq").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        stale = last.select(*[F.col(c).alias(f"_k_{c}") for c in self.keys], "_last")
        older = F.col("_seq") < F.col("_last")
        for c in self.keys:
            older = older & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        kept = rows.join(stale, older, "left_anti")
        folder = f"{self.path}/_replaced"
        if path_exists(self.spark, folder):
            # what a later run replaced: values of one column, whose older rows are gone
            gone = self.spark.read.schema("_column string, _value string, run string").parquet(folder).join(visible, "run")
            for r in gone.select("_column").distinct().collect():  # names of columns
                own = gone.filter(F.col("_column") == r["_column"]).groupBy("_value").agg(F.max("_seq").alias("_gone"))
                dead = (F.col(r["_column"]).cast("string") == F.col("_value")) & (F.col("_seq") < F.col("_gone"))
                kept = kept.join(own, dead, "left_anti")
        return kept.drop("_seq")

    def append(self, batch: DataFrame, run: str, order: list[str] | None = None, replace: str | None = None) -> None:
        """Writes a batch that is seen once ``run`` is committed; a broken write of the run is overwritten.

        ``order`` says which row of a key is the last; without it no key may repeat. ``replace`` names a column
        (a filing, say) all of whose older rows go where the batch has its value.
        """
        target = f"{self.path}/run={run}"
        fresh = stores.keep_last(batch, self.keys, [F.col(c) for c in order]) if order else batch
        fresh.write.mode("overwrite").parquet(target)
        written = self.spark.read.schema(fresh.schema).parquet(target)
        if not order and not written.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"a key of {self.name} repeats in the batch; order says which row is the last")
        if replace:
            values = written.select(F.lit(replace).alias("_column"), F.col(replace).cast("string").alias("_value")).distinct()
            values.write.mode("overwrite").parquet(f"{self.path}/_replaced/run={run}")

    def upsert(self, batch: DataFrame, order: list[str] | None = None, replace: str | None = None, run: str | None = None) -> None:
        """Batch rows win over stored ones. A run that was committed before changes nothing."""
        run = run or uuid.uuid4().hex
        if not self.log.holds(run, self.name):
            self.append(batch, run, order, replace)
            self.log.commit(run, [self.name])

    def compact(self) -> None:
        """Writes the visible rows as one run; older runs are no longer read."""
        rows = self.read()
        if rows is not None:
            run = f"base-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/run={run}")
            self.log.commit(run, [self.name], base=True)


def store_log(spark: SparkSession, path: str) -> CommitLog:
    """The log that the tables beside ``path`` share."""
    return CommitLog(spark, f"{path.rstrip('/').rsplit('/', 1)[0]}/_log")


def sentiment_table(spark: SparkSession, path: str) -> UpsertTable:
    """Scores by filing and section."""
    return UpsertTable(spark, path, ["accession_number", "section"], store_log(spark, path))


def section_table(spark: SparkSession, path: str) -> UpsertTable:
    """Sections of all filings that were ever ingested, by filing and name."""
    return UpsertTable(spark, path, ["accession_number", "section"], store_log(spark, path))


def chunk_table(spark: SparkSession, path: str) -> UpsertTable:
    """Chunks by their id."""
    return UpsertTable(spark, path, ["chunk_id"], store_log(spark, path))
