"""Session helpers: a local builder for tests and bench, and the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "fathomline", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.fathomline.textPartitions", str(cores) if str(cores).isdigit() else "")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so a lost executor does not undo it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
