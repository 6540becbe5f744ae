"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that can be reached.

    Large-star and small-star rounds: every node hands its larger, then its smaller neighbours to its smallest one, until
    the edges are stars. Rounds grow with the logarithm of the longest path. A hub's smallest neighbour is found by a
    partial aggregate, written, and handed out by a join of two tables that are both dealt anew, which adaptive execution
    can split: no adjacency list is ever built and no task holds a hub. What a round has written is deleted after it. No
    table of a round has more than two rows an edge, by which its part files are counted.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _fingerprint(now)
    while mark[0]:
        most = 2 * mark[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), most)
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, most)
        nearest = staged(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), most)
        small = (
            large.join(nearest, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = staged(small, most)
        for used in (now, least, large, nearest):
            unstage(used)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free hash: what two equal edge tables share."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
