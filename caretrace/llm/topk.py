"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caretrace.llm.common import staged

#: Queries and candidates of one cell of the grid, on average.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
#: Segments per vector at each resolution, coarse to fine; those above the dimension are left out.
RESOLUTIONS = (1, 4, 16)
#: Survivor pairs whose exact scores are computed at a time.
PAIRS = 1 << 15
#: Tasks of the grid at most; beyond it a task takes several cells, one after the other.
MOST_TASKS = 20_000


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Root-length-weighted mean and deviation of each segment of each row."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    centred = x - np.repeat(mean, lengths, axis=1)
    deviation = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / lengths)
    return mean * np.sqrt(lengths), deviation * np.sqrt(lengths)


def top_of_cell(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the ``k`` best candidates of each query, ties to smaller ids.

    Over a segment of m components, q.x = m mean(q) mean(x) + centred part, and the centred part is at most m dev(q) dev(x):
    half the lower bound on the squared distance that segment statistics give, turned round. Each resolution
    computes these bounds for all pairs of the cell as one small matrix product; a pair stays while its bound reaches the
    ``k``-th best exact score its query has so far. Exact integer scores are computed for survivors only.
    """
    alive = own[:, None] != ids[None, :]
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-6 + 1e-9 * np.sqrt((qf * qf).sum(1))[:, None] * np.sqrt((xf * xf).sum(1))[None, :]
    floor = np.full(len(q), -np.inf)
    bound = np.zeros(alive.shape)
    for segments in [s for s in RESOLUTIONS if s <= x.shape[1]]:
        (qm, qd), (xm, xd) = segment_statistics(qf, segments), segment_statistics(xf, segments)
        bound = qm @ xm.T + qd @ xd.T + slack
        alive &= bound >= floor[:, None]
        trial = np.where(alive, bound, -np.inf)
        width = min(4 * k, x.shape[0])
        best = np.argpartition(-trial, width - 1, axis=1)[:, :width]
        exact = np.einsum("id,ijd->ij", qf, xf[best])
        exact[~np.take_along_axis(alive, best, 1)] = -np.inf
        if width >= k:
            kth = np.partition(exact, width - k, axis=1)[:, width - k]
            floor = np.maximum(floor, kth - slack.max(axis=1))
    alive &= bound >= floor[:, None]
    rows, cols = np.nonzero(alive)
    scores = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        part = slice(at, at + PAIRS)
        scores[part] = np.einsum("id,id->i", q[rows[part]], x[cols[part]])
    order = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], scores[keep]


def _cell(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, given = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(asked) or not len(given):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})
        dim = len(pdf["v"].iloc[0])
        q, x = (np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim) for part in (asked, given))
        own, ids = asked["vec_id"].to_numpy(np.int64), given["vec_id"].to_numpy(np.int64)
        r, c, s = top_of_cell(q, x, own, ids, k)
        return pd.DataFrame({"query_id": own[r], "query_key": asked["key"].to_numpy(np.int64)[r], "vec_id": ids[c], "score": s})

    return run


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): each component as floor(scale * x), x as double. Vectors with null or non-finite parts go."""
    part = F.col(vector_col).cast("array<double>")
    whole = ~F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & part.isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(part, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``, its ``k`` best other vectors.

    Queries meet candidates in a grid of bounded cells (QUERY_BLOCK x CANDIDATE_BLOCK, dealt by hash); a cell returns at most
    ``k`` rows per query, and the best of these are ranked.

    * vectors that are null or hold null or non-finite components, and rows without an id, take no part
    * score: integer inner product in 64 bits; ties go to the smaller vec_id; fewer than ``k`` candidates: all of them
    * only vectors of the same length are compared; empty vectors score 0 with each other
    * a row repeated in full counts as often as it stands among the candidates (beyond ``k`` times changes nothing) and asks
      once; rows that share a query's vec_id are its own. An id with several vectors asks once for each
    * an empty table gives an empty result; other columns are ignored
    """
    distinct = quantised(vectors, scale, id_col, vector_col).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    rows = staged(
        distinct.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))).alias("copy"))
    )
    asks = (F.col("vec_id") % every == 0) & (F.col("copy") == 1)
    grid = rows.groupBy("dim").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(asks) / QUERY_BLOCK)).alias("n_q"), F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).alias("n_c")
    )
    spread = rows.join(grid, "dim")
    zero = F.lit(0).cast("long")
    queries = spread.where(asks).select(
        "dim", "vec_id", "v", "key", F.lit(True).alias("asks"), F.pmod(F.xxhash64("vec_id", "key"), "n_q").alias("qb"), F.explode(F.sequence(zero, F.col("n_c") - 1)).alias("cb")
    )
    candidates = spread.select(
        "dim", "vec_id", "v", "key", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id", "key", "copy"), "n_c").alias("cb"), F.explode(F.sequence(zero, F.col("n_q") - 1)).alias("qb")
    )
    # A cell is much work on few bytes: cells are dealt to a stated number of tasks, so that they are not put together.
    cells = grid.agg(F.sum(F.col("n_q") * F.col("n_c"))).first()[0] or 1
    dealt = queries.unionByName(candidates).repartition(int(min(cells, MOST_TASKS)), "dim", "qb", "cb")
    found = dealt.groupBy("dim", "qb", "cb").applyInPandas(_cell(k), "query_id long, query_key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
