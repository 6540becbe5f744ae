"""Keyed stream state: expiry, late rows, restart."""

from pyspark.sql import functions as F

from caretrace.streaming import streams as S


def test_denial_state_expires_and_survives_restarts(spark, tmp_path):
    """Each run is a restart from the checkpoint; state goes when the watermark has passed it."""
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "caller string, s long, ts timestamp"

    def feed(rows):
        spark.createDataFrame(rows, "caller string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).write.mode("append").parquet(source)
        done = S.stream_denial_dedupe(S.file_stream(spark, source, schema=schema).select("caller", "ts"), out, ckpt, keys=["caller"], ts="ts", seconds=60, lateness="100 seconds")
        logged = {(r.caller, int(r.s)) for r in spark.read.parquet(out).select("caller", (F.unix_seconds("ts") - 1_000_000).alias("s")).collect()}
        state = [op.numRowsTotal for p in done.recentProgress for op in p.stateOperators]
        return logged, state[-1]

    first, held = feed([("a", 0), ("a", 59), ("a", 60), ("b", 10), (None, 5), ("a", 61)])
    assert first == {("a", 0), ("a", 60), ("b", 10), (None, 5)} and held > 0
    # a's state is used after the restart; 100 is late for a but after its gap is not over, 1000 moves the watermark
    second, _ = feed([("a", 100), ("b", 75), ("c", 1000)])
    assert second - first == {("b", 75), ("c", 1000)}
    # 850 is behind the watermark of 900 and is dropped; the states of a and b have gone by now
    third, _ = feed([("a", 850), ("d", 2000), ("a", 950)])
    assert third - second == {("d", 2000), ("a", 950)}
    fourth, _ = feed([("d", 5000)])
    fifth, last = feed([("d", 9000)])
    assert fifth - third == {("d", 5000), ("d", 9000)} and last <= held


def test_upsert_log_touches_only_its_buckets(spark, tmp_path):
    """Rows by key in any order of arrival; untouched buckets keep their files; a replayed batch changes nothing."""
    import glob
    import os
    import random

    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "episode_id long, resource_type string, resource_id string, ingested_at long, event_id long"
    rng, best, seen = random.Random(3), {}, 0

    def feed(rows, ckpt):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        S.stream_raw_latest(S.file_stream(spark, source, schema=schema), out, ckpt, order=["ingested_at", "event_id"], buckets=16)
        return sorted(tuple(r) for r in S.read_latest(spark, out, schema=schema).select("episode_id", "resource_type", "resource_id", "ingested_at", "event_id").collect())

    files = lambda: set(glob.glob(f"{out}/data/**/*.parquet", recursive=True))
    for size in (60, 3, 1):
        rows = []
        for _ in range(size):
            seen += 1
            rows.append((rng.randrange(6), rng.choice("ab"), f"k{rng.randrange(5)}", rng.randrange(100), seen))
        for r in rows:
            best[r[:3]] = max(best.get(r[:3], r), r, key=lambda x: x[3:])
        before = files()
        assert feed(rows, str(tmp_path / "ckpt")) == sorted(best.values())
        fresh = files() - before
        assert before <= files() and (size == 60 or len({os.path.dirname(f) for f in fresh}) <= size)
    # The last batch again: its checkpoint entry is lost, the log is not.
    current = S.read_latest(spark, out, schema=schema).orderBy("event_id").collect()
    last = S._pointer(spark, out)
    for name in (str(last[0]), f".{last[0]}.crc"):
        if os.path.exists(tmp_path / "ckpt" / "commits" / name):
            os.rename(tmp_path / "ckpt" / "commits" / name, tmp_path / f"was{name}")
    S.stream_raw_latest(S.file_stream(spark, source, schema=schema), out, str(tmp_path / "ckpt"), order=["ingested_at", "event_id"], buckets=16)
    assert S._pointer(spark, out) == last and S.read_latest(spark, out, schema=schema).orderBy("event_id").collect() == current
    gone = S.drop_old_generations(spark, out, keep=1)
    assert gone and S.read_latest(spark, out, schema=schema).orderBy("event_id").collect() == current
    assert S.read_latest(spark, str(tmp_path / "none"), schema=schema).collect() == []
