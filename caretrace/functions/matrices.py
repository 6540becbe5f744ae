"""Sums of products as one matrix per partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariances) of the rows without a missing value.

    One pass: a task returns its row count, means and centred products, and they are joined pairwise as centred moments, so
    nothing cancels. What reaches the driver is one square matrix per task, summed up a tree of ten.
    """
    columns = list(columns)
    p = len(columns)
    clean = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    clean = clean.dropna()  # NaN counts as missing

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, prod = 0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if len(x):
                m = x.mean(axis=0)
                n, mean, prod = _together((n, mean, prod), (len(x), m, (x - m).T @ (x - m)))
        if n:
            yield _row(n, mean, prod)

    def joined(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(*_all(group, p))])

    kind = "n long, mean binary, prod binary"
    parts = clean.mapInArrow(partial, kind)
    tree = parts.withColumn("_g", F.pmod(F.xxhash64("mean"), F.lit(10))).groupBy("_g").applyInArrow(joined, kind)
    n, mean, prod = _all(tree.toArrow(), p)
    return n, mean, prod / max(n, 1)


def _row(n: int, mean: np.ndarray, prod: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([prod.tobytes()], pa.binary())], ["n", "mean", "prod"])


def _together(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _all(parts: pa.Table, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    rows = [(n, np.frombuffer(m, float), np.frombuffer(q, float).reshape(p, p)) for n, m, q in zip(*(parts[c].to_pylist() for c in ("n", "mean", "prod")), strict=True)]
    out = (0, np.zeros(p), np.zeros((p, p)))
    for r in sorted(rows, key=lambda r: (r[0], r[1].tobytes())):
        out = _together(out, r)
    return out
