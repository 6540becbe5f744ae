"""Incremental versions of batch operators with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from caretrace.functions.tables import latest_by
from caretrace.sources.resources import RAW_KEYS, raw_latest

#: Keyed state that is larger than memory and changes by key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Time in microseconds; rows reach a stateful processor as tuples, whose names must not begin with an underscore.
MICROS = "denied_at_micros"


def file_stream(spark: SparkSession, path: str, *, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(query) -> StreamingQuery:
    """Start a configured writer for everything that is there now and wait for it; the ended query tells its progress."""
    started: StreamingQuery = query.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


# --- upsert log ------------------------------------------------------------------------------

# <path>/data/gen=N/bucket=B holds the current rows of a bucket of keys as batch N left them; <path>/pointers/at=N names the
# generation of every bucket after batch N. A pointer is written last and never changed, so it is what commits a batch.
POINTER = "bucket int, gen long"


def _pointer(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """(batch, generation by bucket) of the last committed pointer, or of the last one below ``before``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in fs.listStatus(hadoop) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(hadoop) else []
    done = [int(n.partition("=")[2]) for n in names if n.startswith("at=")]
    done = [n for n in done if before is None or n < before]
    if not done:
        return -1, {}
    rows = spark.read.schema(POINTER).parquet(f"{path}/pointers/at={max(done)}").collect()
    return max(done), {r["bucket"]: r["gen"] for r in rows}


def _buckets(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame | None:
    paths = [f"{path}/data/gen={gen}/bucket={bucket}" for bucket, gen in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def merge_batch(rows: DataFrame, path: str, batch_id: int, *, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], buckets: int) -> None:
    """Merge the rows of a micro-batch into the buckets of keys they touch; all other buckets stay as they are.

    ``merge`` reduces old and new rows together, with the columns of ``rows``. A batch starts from the pointer before it and
    commits by writing its own, so a replayed batch finds the same rows and changes nothing. ``buckets`` is fixed for the
    life of a log; what the driver holds is one number per bucket.
    """
    spark = rows.sparkSession
    _, held = _pointer(spark, path, batch_id)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    mine = rows.persist()
    touched = {r["b"] for r in mine.select(place.alias("b")).distinct().collect()}
    old = _buckets(spark, path, {b: g for b, g in held.items() if b in touched}, rows.schema)
    if touched:
        now = merge(mine if old is None else mine.unionByName(old)).withColumn("bucket", place)
        now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/gen={batch_id}")
    pointer = held | dict.fromkeys(touched, batch_id)
    spark.createDataFrame(sorted(pointer.items()), POINTER).coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/at={batch_id}")
    mine.unpersist()


def stream_raw_latest(stream: DataFrame, path: str, checkpoint: str, *, order: Sequence[str], buckets: int = 64) -> None:
    """Current rows by key in a bucketed log; an older row never replaces a newer one, in any order of arrival."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(raw_latest(batch, order=order), path, batch_id, keys=RAW_KEYS, merge=lambda both: latest_by(both, RAW_KEYS, list(order)), buckets=buckets)

    run_available(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def read_latest(spark: SparkSession, path: str, *, schema) -> DataFrame:
    """Current raw table of an upsert log, as of its last committed batch."""
    rows = _buckets(spark, path, _pointer(spark, path)[1], schema)
    return rows if rows is not None else spark.createDataFrame([], schema)


def drop_old_generations(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove bucket folders that none of the last ``keep`` pointers names; their paths."""
    last, held = _pointer(spark, path)
    used, at = set(), last
    for _ in range(keep):
        used |= set(held.items())
        at, held = _pointer(spark, path, at)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for gen in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
        for bucket in fs.listStatus(gen.getPath()):
            name = str(bucket.getPath().getName())
            if name.startswith("bucket=") and (int(name[7:]), int(str(gen.getPath().getName())[4:])) not in used:
                gone.append(str(bucket.getPath()))
                fs.delete(bucket.getPath(), True)
    return gone


# --- windows and denials ---------------------------------------------------------------------


def stream_window_counts(events: DataFrame, *, key: str, ts: str, hours: int = 12, lateness: str = "1 hour") -> DataFrame:
    """Counts and last value per key and clock window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, f"{hours} hours"), key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_nursing").alias("n_nursing"),
            F.max_by("value", F.struct(ts, "event_id")).alias("last_value"),
        )
        .select(key, F.col("window.start").alias("start_dt"), F.col("window.end").alias("end_dt"), "n", "n_nursing", "last_value")
    )


def stream_late_rows(events: DataFrame, path: str, checkpoint: str, *, key: str, ts: str, hours: int = 12, lateness: str = "1 hour") -> StreamingQuery:
    """Rows that :func:`stream_window_counts` leaves out, counted per key, window and micro-batch.

    The engine's own metric counts what is dropped after partial aggregation, not rows. Here every micro-batch is held
    against the mark left by the batches before it: the newest time so far less ``lateness``, as the watermark has it, one
    row per batch next to the log. A replayed batch finds the same marks and overwrites its own folder.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        newest = batch.agg((F.floor(F.unix_micros(F.max(ts)) / 1000)).cast("long").alias("ms"))
        newest.write.mode("overwrite").parquet(f"{path}-marks/after={batch_id}")
        marks = spark.read.schema("ms long, after int").parquet(f"{path}-marks").filter(F.col("after") < batch_id).agg(F.max("ms").alias("ms"))
        mark = marks.select(F.timestamp_millis("ms") - F.expr(f"INTERVAL '{lateness.split()[0]}' {lateness.split()[1].rstrip('s')}")).scalar()
        end = F.window(ts, f"{hours} hours")["end"]
        late = batch.withColumn("_end", end).withColumn("_mark", mark).filter(F.col("_end") <= F.col("_mark"))
        late.groupBy(key, (F.col("_end") - F.expr(f"INTERVAL '{hours}' HOUR")).alias("start_dt")).agg(F.count(F.lit(1)).alias("dropped")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return run_available(events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


class DenialGate(StatefulProcessor):
    """Per key the time logged last; the state goes when the watermark has passed all times it could still hold back."""

    def __init__(self, keys: list[str], gap: int):
        self.keys, self.gap = keys, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        last = self.last.get()[0] if self.last.exists() else None
        times = np.unique(np.concatenate([part[MICROS].to_numpy(np.int64) for part in rows]))
        logged, at = [], 0 if last is None else int(np.searchsorted(times, last + self.gap))
        while at < len(times):
            logged.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + self.gap))
        if logged:
            if last is not None:
                self.handle.deleteTimer(self.ends(last))
            self.last.update((logged[-1],))
            self.handle.registerTimer(self.ends(logged[-1]))
            yield pd.DataFrame({**{k: [v] * len(logged) for k, v in zip(self.keys, key, strict=True)}, MICROS: np.array(logged, np.int64)})

    def ends(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.last.exists() and self.ends(self.last.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_denial_dedupe(denials: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str], ts: str, seconds: int = 60, lateness: str = "1 hour") -> StreamingQuery:
    """Log one denial per key, then none until ``seconds`` have passed since the logged one.

    The time logged last is keyed state in a RocksDB store: a micro-batch touches only the keys it has, and a key's state is
    dropped ``seconds`` after its last logged time, once the watermark (``lateness`` behind the newest time) is there. Late
    rows are judged against the time logged last, rows behind the watermark are dropped. A batch's folder is
    overwritten, so a replayed batch leaves no duplicates. ``ts`` has to be a timestamp with time zone.
    """
    spark, keys = denials.sparkSession, list(keys)
    kinds = dict(denials.dtypes)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = denials.withWatermark(ts, lateness).withColumn(MICROS, F.unix_micros(ts)).filter(F.col(MICROS).isNotNull())
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {MICROS} long"
    logged = timed.groupBy(*keys).transformWithStateInPandas(DenialGate(keys, seconds * 1_000_000), schema, "append", "eventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*keys, F.timestamp_micros(MICROS).alias(ts)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_available(logged.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint))


FOLLOWUP = "record_id long, total long, new long, latest timestamp_ntz"


def stream_followup(evidence: DataFrame, records: DataFrame, path: str, checkpoint: str, *, ts: str, buckets: int = 64) -> None:
    """Evidence counts of every touched record in a bucketed log: counts add up, the latest time only moves forward."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newer = F.col("base_time").isNull() | (F.col(ts) > F.col("base_time"))
        counts = (
            batch.join(records.select("record_id", "episode_id", "base_time"), "episode_id")
            .groupBy(F.col("record_id").cast("long").alias("record_id"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(newer).alias("new"), F.max(ts).cast("timestamp_ntz").alias("latest"))
        )
        merge_batch(counts, path, batch_id, keys=["record_id"], merge=_added, buckets=buckets)

    run_available(evidence.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def _added(both: DataFrame) -> DataFrame:
    return both.groupBy("record_id").agg(F.sum("total").alias("total"), F.sum("new").alias("new"), F.max("latest").alias("latest"))


def read_followup(spark: SparkSession, path: str) -> DataFrame:
    """State of every touched record."""
    return read_latest(spark, path, schema=FOLLOWUP).withColumn("followup_status", F.when(F.col("new") > 0, F.lit("stale")).otherwise(F.lit("insufficient_evidence")))
