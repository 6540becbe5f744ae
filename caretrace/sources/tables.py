"""Roster text, terminology configuration and the feature table sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrace.functions.columns import parse_utc

ROSTER_COLUMNS = ("start_dt", "end_dt", "rn_count", "na_count", "patient_census")
ROSTER_SCHEMA = ", ".join(f"{c} STRING" for c in ROSTER_COLUMNS)
TERMINOLOGY_DOMAINS = ("nanda_to_snomed", "nic_to_snomed", "noc_to_loinc")


def read_roster_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ROSTER_SCHEMA, mode="PERMISSIVE")


def _count(c: Column) -> Column:
    """int(float(text or 0))"""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("double").cast("int")


def load_roster_csv(rows: DataFrame, *, unit_id: Column | int, keep: list[str] | None = None) -> DataFrame:
    """Typed shifts from text rows; rows without both readable timestamps are skipped."""
    census = F.nullif(F.trim("patient_census"), F.lit(""))
    return rows.select(
        *(keep or []),
        (unit_id if isinstance(unit_id, Column) else F.lit(unit_id)).alias("unit_id"),
        parse_utc("start_dt").alias("start_dt"),
        parse_utc("end_dt").alias("end_dt"),
        _count(F.col("rn_count")).alias("rn_count"),
        _count(F.col("na_count")).alias("na_count"),
        census.try_cast("double").cast("int").alias("patient_census"),
    ).filter(F.col("start_dt").isNotNull() & F.col("end_dt").isNotNull())


def load_terminology(configs: DataFrame, *, column: str = "config") -> DataFrame:
    """(domain, source_code, target_code) from JSON texts with the three maps; bad JSON gives no rows."""
    other = [c for c in configs.columns if c != column]
    shape = ", ".join(f"{d} MAP<STRING, STRING>" for d in TERMINOLOGY_DOMAINS)
    parsed = configs.withColumn("_c", F.from_json(column, shape))
    maps = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"_c.{d}").alias("m")) for d in TERMINOLOGY_DOMAINS])
    pairs = parsed.select(*other, F.inline(maps)).select(*other, "domain", F.explode("m").alias("_s", "_t"))
    return pairs.filter((F.col("_s") != "") & (F.col("_t") != "")).select(
        *other, "domain", F.trim("_s").alias("source_code"), F.trim("_t").alias("target_code")
    )


def read_terminology(spark: SparkSession, path: str) -> DataFrame:
    """The configuration file is one JSON document."""
    return load_terminology(spark.read.text(path, wholetext=True).withColumnRenamed("value", "config"))


def write_features(df: DataFrame, path: str, *, partition_by: str = "unit_id", truncate: bool = False) -> None:
    """Parquet partitioned by ``partition_by``.

    ``truncate`` rebuilds the table; otherwise only the partitions present in ``df`` are replaced, so a
    rebuild of some units is idempotent. Rows are spread over (partition, episode) first: a partition
    with a large share of the rows is written by many tasks.
    """
    mode = "static" if truncate else "dynamic"
    (
        df.repartition(partition_by, "episode_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(partition_by)
        .parquet(path)
    )
