"""Long audit chains and denials of a hot caller: bounded batches and slices, same results as one walk."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrace.functions.tables import numbered, range_slices
from caretrace.operators import audit as L
from caretrace.session import cut_lineage, discard, shared_root


def audit(df):
    return df.select(
        F.col("chain"), F.col("id").alias("seq"), F.col("id").cast("string").alias("created_at"), F.lit("e").alias("event_type"),
        F.when(F.col("id") % 7 != 0, F.lit("a")).alias("actor"), F.lit("c").alias("context"), F.sha2(F.col("id").cast("string"), 256).alias("payload_sha256"),
    )


def test_one_long_chain_in_batches(spark, tmp_path):
    """A chain of 10^5 events beside short ones: the hashes of one walk, and what the manifest says when events go."""
    n = 100_000
    rows = spark.range(n).withColumn("chain", F.lit("hot")).unionByName(spark.range(500).withColumn("chain", F.concat(F.lit("c"), F.col("id") % 100)))
    args = {"chain": "chain", "seq": "seq"}
    sealed = L.seal_chains(audit(rows), str(tmp_path / "log"), secret="k", batch_events=15_000, **args)
    assert sealed.count() == n + 500 and not [f for f in sealed.schema if "array" in f.dataType.simpleString()]
    sizes = {(r.chain, r.batch): r["count"] for r in sealed.groupBy("chain", "batch").count().collect()}
    assert len({b for c, b in sizes if c == "hot"}) == 7 and max(sizes.values()) == 15_000 and sizes["c1", 0] == 5
    before, want = "", []
    for k in range(n):
        parts = [before, str(k), "e", *(["a"] if k % 7 else []), "c", hashlib.sha256(str(k).encode()).hexdigest()]
        before = hashlib.sha256("|".join(parts).encode()).hexdigest()
        want.append(before)
    got = sealed.filter("chain = 'hot'").orderBy("seq").select("chain_hash").toPandas()["chain_hash"].tolist()
    assert got == want
    manifest = cut_lineage(L.batch_manifest(sealed, **args))
    assert L.verify_audit_chain(sealed, secret="k", manifest=manifest, **args).count() == 0
    gone = L.verify_audit_chain(sealed.filter("not (chain = 'hot' and seq = 40000)"), secret="k", manifest=manifest, **args).collect()
    assert sorted((r.seq, r.reason) for r in gone) == [(40_001, "predecessor_missing"), (44_999, "batch_incomplete")]
    # A later request goes on from the tails, those of untouched chains included.
    more = spark.range(n, n + 10).withColumn("chain", F.lit("hot"))
    again = L.seal_chains(audit(more), str(tmp_path / "more"), secret="k", batch_events=4, tails=L.chain_tails(sealed, **args), **args)
    assert again.orderBy("seq").first().prev_hash == want[-1] and again.select("batch").distinct().count() == 3
    assert L.seal_chains(audit(more.limit(0)), str(tmp_path / "none"), secret="k", **args).count() == 0


def test_small_batches_share_a_round(spark, tmp_path):
    """Chains of 400 events in batches of three: one round, not one per batch, and the batches and hashes of single batches."""
    rows = audit(spark.range(800).withColumn("chain", F.concat(F.lit("c"), F.col("id") % 2)))
    args = {"chain": "chain", "seq": "seq"}
    sealed = L.seal_chains(rows, str(tmp_path / "log"), secret="k", batch_events=3, **args)
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) == 1
    cut = L.seal_chains(rows, str(tmp_path / "cut"), secret="k", batch_events=3, round_events=150, **args)
    whole = L.seal_audit_batch(rows, secret="k", **args)
    ours = lambda df: sorted((r.chain, r.seq, r.prev_hash, r.chain_hash, r.hmac_sig) for r in df.collect())
    assert ours(sealed) == ours(cut) == ours(whole)
    at = {(r.chain, r.seq): r.batch for r in sealed.collect()}
    assert at == {("c" + str(i % 2), i): i // 2 // 3 for i in range(800)}


def test_numbers_and_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(10**6)) for _ in range(3000)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "k string, t long").repartition(5)
    got = {(r.k, r.t): r._number for r in numbered(df, ["k"], ["t"], 200).collect()}
    for k in {k for k, _ in rows}:
        mine = sorted(t for c, t in rows if c == k)
        assert [got[k, t] for t in mine] == list(range(len(mine)))
    sliced = range_slices(df, ["k"], ["t"], 200)
    spans = sliced.groupBy("k", "_slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("k", "_slice").collect()
    assert max(s.n for s in spans) < 500 and all(a.k != b.k or a.hi < b.lo for a, b in zip(spans, spans[1:]))
    discard(sliced)


def walked(rows, gap, seed=None):
    want = set()
    for c in {c for c, _ in rows}:
        last = (seed or {}).get(c)
        for s in sorted({s for k, s in rows if k == c}):
            if last is None or s - last >= gap:
                want.add((c, s))
                last = s
    return want


@pytest.mark.parametrize(("gap", "slice_rows", "fan_in"), [(60, 100, 3), (86_400, 60, 2), (600, 30, 2)])
def test_denials_in_slices(spark, gap, slice_rows, fan_in):
    """Slices shorter and longer than the gap, trees of several levels, nodes too dense to join, null callers, a seed."""
    rng = random.Random(gap + slice_rows)
    rows = [("hot", rng.randrange(3 * 86_400)) for _ in range(700)] + [(c, rng.randrange(3 * 86_400)) for c in "abc" for _ in range(30)] + [(None, 5), (None, 64), (None, 65)]
    df = spark.createDataFrame(rows, "caller string, s int").withColumns({"ts": F.timestamp_seconds("s").cast("timestamp_ntz"), "error": F.lit(1)})
    stamp = F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")
    out = L.denial_dedupe(df, keys=["caller", "error"], ts="ts", seconds=gap, slice_rows=slice_rows, fan_in=fan_in)
    got = out.select("caller", stamp).collect()
    want = walked(rows, gap)
    assert {(r.caller, r.s) for r in got} == want and len(got) == len(want) and dict(out.dtypes)["ts"] == "timestamp_ntz"
    seed = spark.createDataFrame([("hot", 1, 1000), ("b", 1, 200_000), ("zz", 1, 5)], "caller string, error int, s long").withColumn("last_logged", F.timestamp_seconds("s"))
    again = L.denial_dedupe(df, keys=["caller", "error"], ts="ts", seconds=gap, slice_rows=slice_rows, fan_in=fan_in, seed=seed).select("caller", stamp).collect()
    late = [r for r in rows if not (r[0] == "hot" and r[1] < 1000 + gap) and not (r[0] == "b" and r[1] < 200_000 + gap)]
    assert {(r.caller, r.s) for r in again} == walked(late, gap)


def test_denials_without_rows(spark):
    empty = spark.createDataFrame([], "caller string, ts timestamp_ntz")
    assert L.denial_dedupe(empty, keys=["caller"], ts="ts").collect() == []


def test_pieces_join_like_walks():
    """Joined maps against walking, entry by entry."""
    rng = np.random.default_rng(2)
    for gap in (3, 10, 40):
        t = np.unique(rng.integers(0, 300, 90))
        cuts = [0, 20, 25, 60, len(t)]
        import pyarrow as pa

        parts = [L._summary(gap)(pa.table({"_key": ["k"] * (b - a), "_slice": pa.array([i] * (b - a), pa.int32()), "_t": t[a:b]})) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        node = L._joined(1, gap)(pa.concat_tables(parts)).to_pylist()[0]
        for carry in range(-60, int(t[0])):
            last = carry
            for x in t.tolist():
                if x - last >= gap:
                    last = x
            assert int(L._after(np.array([carry]), np.array(node["hi"]), np.array(node["exits"]), gap)[0]) == last


def test_shared_folder_is_named_on_a_cluster(spark):
    assert shared_root(spark).startswith(("/", "file:"))
