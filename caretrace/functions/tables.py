"""DataFrame idioms used by more than one operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace.session import cut_lineage


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row per key.

    An aggregate, not a window: partial maxima are taken before the shuffle, so a key that owns a
    large share of the rows sends one row per map task instead of all of them.
    """
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def settled(stats: DataFrame) -> DataFrame:
    """The single row of ``stats``, computed now: a table of literals.

    Statistics that many expressions read are settled, so that their plan is optimised once and not once per reader.
    """
    row = stats.first()
    values = [F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name) for f in stats.schema.fields]
    out = stats.sparkSession.range(1).select(*values)
    out.settled_row = F.struct(*values)
    return out


def with_stats(df: DataFrame, stats: DataFrame, name: str = "_s") -> DataFrame:
    """Attach the single row of ``stats`` to every row as a struct.

    Uses an uncorrelated scalar subquery: the row is computed once and inlined, with no join; a :func:`settled` row is
    inlined as it is.
    """
    row = getattr(stats, "settled_row", None)
    return df.withColumn(name, row if row is not None else stats.select(F.struct(*stats.columns).alias("_row")).scalar())


def stat_columns(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Like ``with_stats`` but spread into columns."""
    return (
        with_stats(df, stats, "_stat_row")
        .select(*df.columns, *[F.col(f"_stat_row.{c}").alias(c) for c in stats.columns])
    )


def distinct_values_per_key(df: DataFrame, keys: Sequence[str], array_col: str, out: str) -> DataFrame:
    """Sorted union of array members per key; members are deduplicated before they are collected."""
    return (
        df.select(*keys, F.explode(array_col).alias("_v"))
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_v")).alias(out))
    )


def unpivot_columns(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form of one-type columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.inline(pairs))


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, out: str = "_slice") -> DataFrame:
    """``df`` with a slice number: slices follow each other in (keys, order) and hold about ``rows`` rows each.

    A range partitioning, written before it is read again, so that a slice stays what it is. Rows that agree in keys and
    order share a slice; a key with a third of all rows has as many slices as its rows need.
    """
    parts = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn(out, F.spark_partition_id())
    return cut_lineage(dealt)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, out: str = "_number") -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its key: counts per slice give a slice its first number, and
    rows are only ordered inside a slice."""
    keys = list(keys)
    sliced = range_slices(df, keys, order, rows)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    named = starts.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_slice"]})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_slice"]]
    return sliced.join(named, same).withColumn(out, F.col("_start") + F.row_number().over(inside) - 1).select(*df.columns, out)
