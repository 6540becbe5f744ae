"""Query registry: one Spark plan and, where SQL can say the same, one DuckDB text per key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrace.plans.adapter import CTES, Tables
from caretrace.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _as_output(name: str, kind: T.DataType, digits: int) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(c.cast("double"), digits) + F.lit(0.0)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), "|")
    return c


def emit(df: DataFrame, *, digits: int = 6, **per_column: int) -> DataFrame:
    """Comparable output types: BIGINT, rounded DOUBLE, text timestamps, joined string arrays."""
    return df.select(
        *[_as_output(f.name, f.dataType, per_column.get(f.name, digits)).alias(f.name) for f in df.schema.fields]
    )


def with_ctes(body: str) -> str:
    """Prefix the shared definitions that ``body`` mentions, in dependency order."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(CTES[name])
    if not needed:
        return body.strip()
    used = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {used},\n{text[len('WITH RECURSIVE'):].strip()}"
    if text.upper().startswith("WITH"):
        return f"WITH {used},\n{text[len('WITH'):].strip()}"
    return f"WITH {used}\n{text}"


def query(name: str, sql: str | None = None):
    """Register a plan taking the table adapter; ``sql`` is the DuckDB text, if any."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return build

    return wrap


def ts(col: str, alias: str | None = None) -> str:
    """DuckDB text of a timestamp in the output format."""
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or col.split('.')[-1]}"


def rnd(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"
