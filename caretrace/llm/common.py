"""Table access, shared staging folder and small expressions used by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: With this on, Spark removes a query's shuffle files at its end, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows for which a table of known size gets another part file.
FILE_ROWS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str | Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/caretrace-llm/{uuid.uuid4().hex}"


def staged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what was computed is not computed again when an executor is lost, and every reader sees the same
    rows. The shuffle files of the write go with its end, nothing reads them again. ``rows``, where it is known, is the
    most rows that ``df`` has: a small table then gets few part files, however many shuffle partitions there are. The
    folder is swept together with ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    written = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        written.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the folder of a :func:`staged` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
