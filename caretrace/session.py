"""Session settings shared by tests, bench and the query registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "caretrace", cores: str | int = "*", memory: str = "12g", shuffle: int = 8, shared: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session in.

    ``shared`` is the folder for checkpoints and written tables (``spark.checkpoint.dir``).
    """
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on.

    Only correctness settings are touched: partition counts, memory and broadcast thresholds stay
    with whoever launched the session.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; with a local master, the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: plans that are reused many times read only the columns they
    need, survive lost executors and see the same rows. :func:`discard` removes it after its last reader."""
    path = f"{shared_root(df.sparkSession)}/caretrace/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut_lineage` that nothing reads any more."""
    for table in tables:
        discard_path(table.sparkSession, table.written_to)


def discard_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
