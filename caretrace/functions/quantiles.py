"""Exact quantiles without sorting the whole column in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
BRACKET = 0.001
# A bracket's half-width is the first of BRACKET, 2 BRACKET, 4 BRACKET ... that spans this many ranks, else the whole range.
RANKS = 20
LADDER = 10
CELLS = 1024  # cells of equal width inside a bracket; only those that hold a wanted rank are ordered by value


def exact_quantiles(df: DataFrame, value: Column | str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with linearly interpolated quantiles of ``value`` (NULLs ignored)."""
    return exact_quantiles_of(df, [(n, value, q) for n, q in zip(names, probs)])


def exact_medians(df: DataFrame, values: dict[str, Column | str]) -> DataFrame:
    """One row with the median of every named column."""
    return exact_quantiles_of(df, [(n, v, 0.5) for n, v in values.items()])


def exact_quantiles_of(
    df: DataFrame,
    wanted: Sequence[tuple[str, Column | str, float]],
    rank_of: Callable[[float, int], float] | None = None,
) -> DataFrame:
    """One row with a linearly interpolated quantile per (name, column, q).

    ``rank_of(q, n)`` gives the zero-based rank when it is not ``q * (n - 1)``; it must stay near it.

    Pass 1 sketches a bracket around each wanted rank (rank error of the sketch is far below the
    bracket half-width). Pass 2 counts the rows below each bracket exactly and keeps only the distinct
    values inside it with their counts, about 0.2 % of the rows in the worst case. These are counted per
    cell of the bracket; the running count is over cells, and values are ordered only within the cells
    that hold a wanted rank. No column is collected or sorted whole, and only bracket rows are shuffled:
    the rest collapses in the map-side aggregate. The same path serves every number of rows.
    """
    columns = list(dict.fromkeys(str(v) if not isinstance(v, str) else v for _, v, _ in wanted))
    exprs = {(v if isinstance(v, str) else str(v)): (F.col(v) if isinstance(v, str) else v) for _, v, _ in wanted}
    pos = {c: i for i, c in enumerate(columns)}

    def finite(c: Column) -> Column:
        c = c.cast("double")
        return F.when(~F.isnan(c), c)

    data = df.select(*[finite(exprs[c]).alias(f"v{i}") for i, c in enumerate(columns)])
    steps = [BRACKET * 2**k for k in range(LADDER)]
    probs = {i: [] for i in range(len(columns))}
    for _, v, q in wanted:
        probs[pos[v if isinstance(v, str) else str(v)]] += [p for step in steps for p in (max(q - step, 0.0), min(q + step, 1.0))]
    sketch = data.agg(
        F.struct(
            *[
                F.struct(
                    F.percentile_approx(f"v{i}", probs[i], SKETCH_ACCURACY).alias("b"),
                    F.count(f"v{i}").alias("n"),
                    F.min(f"v{i}").alias("mn"),
                    F.max(f"v{i}").alias("mx"),
                ).alias(f"c{i}")
                for i in range(len(columns))
            ]
        ).alias("_s")
    )
    # The sketch is one row: it is read here, and a data row only compares itself with numbers.
    sketched, used, settled = sketch.first()["_s"], dict.fromkeys(range(len(columns)), 0), []
    for _, v, q in wanted:
        i = pos[v if isinstance(v, str) else str(v)]
        j, c = used[i], sketched[f"c{i}"]
        used[i] += 1
        at = next((k for k in range(LADDER) if c["n"] * steps[k] >= RANKS), None)
        low = c["mn"] if at is None or q - steps[at] <= 0 else c["b"][2 * (LADDER * j + at)]
        high = c["mx"] if at is None or q + steps[at] >= 1 else c["b"][2 * (LADDER * j + at) + 1]
        settled.append({"rank": float(rank_of(q, c["n"]) if rank_of else q * (c["n"] - 1)), "lo": low, "hi": high})
    number = lambda x: F.lit(x).cast("double")
    spread = data.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("i"), F.col(f"v{pos[v if isinstance(v, str) else str(v)]}").alias("v"), *[number(x).alias(n) for n, x in settled[k].items()])
                    for k, (_, v, _) in enumerate(wanted)
                ]
            )
        )
    )
    inside = F.col("v") >= F.col("lo")
    cell = F.when(inside, F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0)))
    below = spread.filter(F.col("v") <= F.col("hi")).select("i", "rank", F.coalesce(cell, F.lit(-1)).cast("long").alias("cell"), F.when(inside, F.col("v")).alias("v"))
    # Rows under the bracket collapse to one count per quantile (cell -1) before they reach a window.
    collapsed = below.groupBy("i", "rank", "cell", "v").agg(F.count(F.lit(1)).alias("c"))
    cells = collapsed.groupBy("i", "rank", "cell").agg(F.sum("c").alias("k"))
    upto_cell = cells.withColumn("end", F.sum("k").over(Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.col("end") - F.col("k")
    holds = lambda r: (F.col("end") > r) & (before <= r)
    hit = upto_cell.filter(holds(F.floor("rank")) | holds(F.ceil("rank"))).select("i", "cell", before.alias("before"))
    run = Window.partitionBy("i", "cell").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = collapsed.join(hit, ["i", "cell"]).withColumn("e", F.col("before") + F.sum("c").over(run))
    at = upto.groupBy("i").agg(
        F.min(F.when(F.col("e") > F.floor("rank"), F.col("v"))).alias("low"),
        F.min(F.when(F.col("e") > F.ceil("rank"), F.col("v"))).alias("high"),
        F.first("rank").alias("rank"),
    )
    value_at = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    return at.agg(*[F.max(F.when(F.col("i") == k, value_at)).alias(n) for k, (n, _, _) in enumerate(wanted)])


def weighted_quantiles(
    df: DataFrame, *, key: str, value: str, weight: str, probs: Sequence[float], names: Sequence[str], cell: float
) -> DataFrame:
    """Per key: smallest value whose cumulative weight reaches q * total (weights > 0 only).

    Rows are first summed per (key, value), then per (key, value cell of width ``cell``). Only the cells
    that hold a wanted quantile are ordered value by value, so a key with a third of the rows is split
    by cell instead of being sorted in one task.
    """
    finite = (F.col(value).isNotNull()) & (~F.isnan(value)) & (F.col(weight) > 0) & (~F.isnan(weight))
    sums = (
        df.filter(finite)
        .groupBy(key, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(F.col(weight).cast("double")).alias("_w"))
        .withColumn("_cell", F.floor(F.col("_v") / F.lit(cell)))
    )
    cells = sums.groupBy(key, "_cell").agg(F.sum("_w").alias("_cw"))
    w = Window.partitionBy(key)
    cum = cells.withColumn(
        "_end", F.sum("_cw").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("_total", F.sum("_cw").over(w))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    hits = (
        cum.select(key, "_cell", "_cw", "_end", "_total", F.inline(wanted))
        .filter(F.col("_end") >= F.col("q") * F.col("_total"))
        .groupBy(key, "i")
        .agg(F.min(F.struct("_cell", (F.col("_end") - F.col("_cw")).alias("_before"), (F.col("q") * F.col("_total")).alias("_cut"))).alias("_h"))
        .select(key, "i", "_h._cell", "_h._before", "_h._cut")
    )
    inside = Window.partitionBy(key, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sums.join(hits, [key, "_cell"]).withColumn("_acc", F.col("_before") + F.sum("_w").over(inside))
    picked = ranked.groupBy(key, "i").agg(
        F.min(F.when(F.col("_acc") >= F.col("_cut"), F.col("_v"))).alias("_p"), F.max("_v").alias("_last")
    )
    return picked.groupBy(key).agg(
        *[F.max(F.when(F.col("i") == i, F.coalesce("_p", "_last"))).alias(n) for i, n in enumerate(names)]
    )
