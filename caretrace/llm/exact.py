"""Exact deduplication by rounds of partial aggregates over digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.common import lower_ascii, staged

#: Runs that the input partitions are folded into, and how many runs one merge joins: 512 -> 64 -> 8 -> 1.
RUNS = 512
FAN_IN_BITS = 3
KEYS = ["digest", "check", "n_bytes"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, check, n_bytes): SHA-256 of the lower-cased (A-Z) text, a second hash and the length that verify it."""
    return docs.select(F.col(id_col).alias("id"), lower_ascii(text_col).alias("t")).select(
        "id", F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").cast("long").alias("n_bytes")
    )


def tree_merge(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge digest runs in rounds until one is left: (digest, check, n_bytes, keep_id, group_size).

    ``runs`` has (run, id, digest, check, n_bytes, copies). In each round eight neighbouring runs meet. Equal digests that
    also agree in the second hash and the length collapse to one row before and after the exchange, so that a digest
    shared by a third of all rows travels as one row per task, and a round moves distinct digests only. The exchange is on
    (run, digest): the last round is spread over all digests, no task holds a whole run.

    What runs are hash aggregates on (run, digest, second hash, length), one per round. The optimiser drops a sort that
    stands below an aggregate or a join, so no order is used and rounds are not a multiway merge of sorted runs.
    """
    best = F.max if keep == "largest" else F.min
    level = runs.withColumnsRenamed({"id": "keep_id", "copies": "group_size"})
    width = RUNS
    while True:
        level = (
            level.groupBy("run", *KEYS)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("run", "digest")
        )
        if width == 1:
            return level.drop("run")
        width >>= FAN_IN_BITS
        level = level.withColumn("run", F.shiftright("run", FAN_IN_BITS))


def exact_duplicates(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` is "largest" or "smallest" id.

    * null text counts as empty; empty texts are a group like any other; length does not matter, texts never leave the scan
    * ties: of rows that repeat an id and a text, exactly one stays
    * null ids: they lose to any id; in a group of null ids only, one row stays (keep_id null)
    * an empty table gives an empty result; other columns are ignored
    """
    rows = staged(
        digest_rows(docs, id_col, text_col)
        .withColumn("run", F.pmod(F.spark_partition_id(), F.lit(RUNS)))
        .groupBy("run", "id", *KEYS)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    keepers = tree_merge(rows, keep)
    per_id = rows.groupBy("id", *KEYS).agg(F.sum("copies").alias("copies"))
    return (
        per_id.join(keepers, KEYS)
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops, all columns kept.

    Rows that repeat both id and text have nothing to tell them apart in the decision; one of them, whichever Spark meets
    first, stays.
    """
    marks = exact_duplicates(docs, keep, id_col, text_col)
    stay = marks.where("kept").select(F.col(id_col).alias("__ct_stay"), F.col("text_sha256").alias("__ct_sha"))
    several = marks.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    stay = stay.join(several.select(F.col(id_col).alias("__ct_several_id"), F.col("text_sha256").alias("__ct_several_sha"), F.lit(True).alias("__ct_several")),
                     F.col("__ct_stay").eqNullSafe(F.col("__ct_several_id")) & (F.col("__ct_sha") == F.col("__ct_several_sha")), "left")
    stay = staged(stay.select("__ct_stay", "__ct_sha", F.coalesce("__ct_several", F.lit(False)).alias("__ct_several")))
    left = docs.withColumn("__ct_text_sha", F.sha2(lower_ascii(text_col), 256)).join(
        stay, (F.col("__ct_text_sha") == F.col("__ct_sha")) & F.col(id_col).eqNullSafe(F.col("__ct_stay"))
    )
    once = left.where("not __ct_several")
    repeated = left.where("__ct_several").dropDuplicates(["__ct_text_sha", "__ct_stay"])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
