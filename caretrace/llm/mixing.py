"""Mixing sources to target weights by pivotal dependent rounding along a reduction tree."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace.llm.common import WORD, staged

#: Rows that one block of the reduction tree rounds one after the other (on average; blocks are hash buckets).
BLOCK_ROWS = 1024
ITEM = "doc_id long, source string, text_key long, size long, source_size long, target double, order_key long, p double, copies long"
ITEM_COLUMNS = [c.split()[0] for c in ITEM.split(", ")]


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, rows, target) from rows of (source, size).

    Sources in code-point order (null last) weigh ``weights``, repeating. Together they get ``share`` of all sizes. No
    target exceeds ``most`` times its source; what is cut off is reshared by weight among the others. The fixed point is
    read from running sums over the sources in order of their cap per weight: one row per source reaches these windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    caps = caps.withColumn("fill", F.col("cap") / F.col("weight"))
    below = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    caps = caps.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    return caps.withColumn("reached", reached).select(
        "source",
        "source_size",
        "rows",
        F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("reached") * F.col("weight"))).alias("target"),
    )


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the shares ``p`` of one block, given from large to small sizes; at most one stays fractional, a small one.

    Two items trade words until one of them is at 0 or 1. The words of the pair stay the same and each direction has the
    odds that leave both expectations as they were. When all items of a size class (powers of two) are done, the one left
    trades in the same way with all smaller items at once, so that no large document is left to the end.
    """
    out = p.copy()
    draws = rng.random(len(p))
    classes = np.frexp(size)[1]
    i = -1
    for j in range(len(p)):
        if i >= 0 and classes[j] != classes[j - 1]:
            rest = slice(j, None)
            words = size[rest].sum()
            down, up = (1 - out[i]) * size[i] / words, out[i] * size[i] / words
            if out[rest].min() > down and out[rest].max() + up < 1:
                if rng.random() < out[i]:
                    out[i], out[rest] = 1.0, out[rest] - down
                else:
                    out[i], out[rest] = 0.0, out[rest] + up
                i = -1
        if not 0.0 < out[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        held_i, room_i = out[i] * size[i], (1 - out[i]) * size[i]
        held_j, room_j = out[j] * size[j], (1 - out[j]) * size[j]
        up, down = min(room_i, held_j), min(held_i, room_j)  # words that may go from j to i, from i to j
        if draws[j] * (up + down) < down:
            out[i] = 1.0 if room_i <= held_j else out[i] + up / size[i]
            out[j] = 0.0 if held_j <= room_i else out[j] - up / size[j]
        else:
            out[i] = 0.0 if held_i <= room_j else out[i] - down / size[i]
            out[j] = 1.0 if room_j <= held_i else out[j] + down / size[j]
        if not 0.0 < out[i] < 1.0:
            i = j if 0.0 < out[j] < 1.0 else -1
    return out


def _round_block(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_class=-np.frexp(pdf["size"].to_numpy(float))[1]).sort_values(["_class", "order_key", "doc_id", "size"], kind="stable")
        rng = np.random.default_rng([seed, int(pdf["order_key"].min()) & 0xFFFFFFFF, len(pdf)])
        p = pivot(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), rng)
        if last:
            p = np.where((p > 0) & (p < 1), rng.random() < p, p).astype(float)
        whole = (p == 0) | (p == 1)
        return pdf[ITEM_COLUMNS].assign(p=np.where(whole, np.nan, p), copies=pdf["copies"] + np.where(whole, p, 0).astype(np.int64))

    return run


def _blocks(rows: DataFrame, level: int) -> DataFrame:
    """Deal the rows of each source to hash buckets of about BLOCK_ROWS; on higher levels to fewer."""
    per_block = float(BLOCK_ROWS) ** (level + 1)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(per_block)))
    return rows.withColumn("block", F.pmod(F.xxhash64("order_key", F.lit(level)), buckets))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies): how often the mix takes each document.

    Every document of a source should be taken target / source_size times. The whole part is certain; the fractions are
    rounded by pivoting within blocks of a source, and what stays fractional (one row per block at most) goes up a tree
    whose blocks hold the rests of BLOCK_ROWS blocks, until one rest per source is drawn. The words a source gives
    therefore miss its target by less than the size of one document, as a rule a small one. A source with a third of all rows is many blocks.

    * null or empty texts have size 0 and are taken as the whole part says: they add no words
    * a null source is a source, last in order; repeated rows and ids are rows of their own
    * order and draws come from hashes of id and text, so that a rerun or a lost executor gives the same mix
    * an empty table gives an empty result; other columns are ignored
    """
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            word_count(text_col).alias("size"),
        )
    )
    targets = staged(source_targets(rows, weights, share, most))
    largest = targets.agg(F.max("rows")).first()[0] or 0
    levels = 1
    while BLOCK_ROWS**levels < largest:
        levels += 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = targets.withColumnRenamed("source", "_source")
    items = (
        rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("ratio", F.when(F.col("target") >= F.lit(float(most)) * F.col("source_size"), F.when(F.col("source_size") > 0, F.lit(float(most))).otherwise(F.lit(0.0))).otherwise(ratio))
        .withColumn("copies", F.floor("ratio").cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(F.lit(0.0)))
        .withColumn("order_key", F.xxhash64("doc_id", "text_key", F.lit(seed)))
        .drop("_source", "ratio")
    )
    done = [items.where("p = 0").drop("p", "rows")]
    open_rows = items.where("p > 0")
    for level in range(levels):
        rounded = staged(
            _blocks(open_rows, level)
            .groupBy("source", "block")
            .applyInPandas(_round_block(seed + level, level == levels - 1), ITEM)
        )
        done.append(rounded.where("p is null or isnan(p)").drop("p"))
        open_rows = rounded.where("p > 0 and not isnan(p)").join(
            targets.select(F.col("source").alias("_source"), "rows"), F.col("source").eqNullSafe(F.col("_source"))
        ).drop("_source")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("order_key")


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row repeated as often as ``mixed`` takes it; rows taken 0 times go.

    Rows that repeat id and text count together: one of them carries the copies of all.
    """
    key = mixed.groupBy(F.col("doc_id").alias("__ct_id"), F.col("text_key").alias("__ct_key")).agg(F.sum("copies").alias("__ct_copies"), F.count(F.lit(1)).alias("__ct_rows"))
    joined = docs.withColumn("__ct_text_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(
        key, F.col(id_col).cast("long").eqNullSafe(F.col("__ct_id")) & (F.col("__ct_text_key") == F.col("__ct_key"))
    )
    once = joined.where("__ct_rows = 1").unionByName(joined.where("__ct_rows > 1").dropDuplicates(["__ct_id", "__ct_key"]))
    return once.where("__ct_copies > 0").withColumn("__ct_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__ct_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
