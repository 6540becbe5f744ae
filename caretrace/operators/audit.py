"""Audit chains, pseudonyms, snapshots and decisions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import hmac_sha256, string_array
from caretrace.functions.tables import numbered, range_slices
from caretrace.session import cut_lineage, discard, discard_path, shared_root


def link_material(prev: Column, created: Column, kind: Column, actor: Column, context: Column, payload_hash: Column) -> Column:
    return F.concat_ws("|", prev, created, kind, actor, context, payload_hash)


EVENT = ("created_at", "event_type", "actor", "context", "payload_sha256")


def seal_audit_batch(events: DataFrame, *, chain: str, seq: str, secret: str, batch: str | int | Column = 0, tails: DataFrame | None = None) -> DataFrame:
    """Events of one batch with batch, prev_hash, chain_hash and hmac_sig.

    Every event is linked to the one before it. ``tails`` (chain, tail_hash) are the last hashes of what was sealed
    earlier (see :func:`chain_tails`), so a chain goes on over any number of batches and does not depend on where they
    are cut. A chain's events of one batch are walked once, in order, in one task: that is why a batch is bounded by
    whoever cuts it, as :func:`seal_chains` does. ``batch`` is its name, or the column that names the batch of each event.
    """
    named_by_row = isinstance(batch, Column)
    if named_by_row:
        events = events.withColumn("batch", batch)
    kinds, own_batch = dict(events.dtypes), ["batch"] if named_by_row else []
    rows = events.select(chain, *own_batch, seq, *[F.col(c).cast("string").alias(f"_m_{c}") for c in EVENT], *[c for c in EVENT if c not in (chain, seq)])
    if tails is not None:
        named = tails.select(F.col(chain).alias("_t_chain"), F.col("tail_hash").alias("_tail"))
        rows = rows.join(named, F.col(chain).eqNullSafe(F.col("_t_chain")), "left").drop("_t_chain")
    else:
        rows = rows.withColumn("_tail", F.lit(None).cast("string"))
    kept = [chain, *own_batch, seq, *[c for c in EVENT if c not in (chain, seq)]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", prev_hash string, chain_hash string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = object(), ""  # the chain that is walked, and its last hash
        for part in batches:
            get = lambda c, part=part: part.column(part.schema.get_field_index(c)).to_pylist()
            prev, own = [], []
            for mine, tail, *parts in zip(get(chain), get("_tail"), *(get(f"_m_{c}") for c in EVENT), strict=True):
                if mine != at:
                    at, before = mine, tail or ""
                prev.append(before)
                before = hashlib.sha256("|".join([before, *(p for p in parts if p is not None)]).encode()).hexdigest()
                own.append(before)
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], [*kept, "prev_hash", "chain_hash"])

    # A partition holds whole chains, in order: they are walked as they stream by.
    ordered = rows.repartition(chain).sortWithinPartitions(chain, *own_batch, seq, *[f"_m_{c}" for c in EVENT])
    sealed = ordered.mapInArrow(walk, schema)
    cols = [chain, F.col("batch") if named_by_row else F.lit(batch).alias("batch"), seq, *[c for c in EVENT if c not in (chain, seq)], "prev_hash", "chain_hash"]
    return sealed.select(*cols).withColumn("hmac_sig", hmac_sha256(secret, F.col("chain_hash")))


def seal_chains(
    events: DataFrame, path: str, *, chain: str, seq: str, secret: str, batch_events: int = 100_000, tails: DataFrame | None = None, round_events: int = 100_000
) -> DataFrame:
    """Seal chains of any length to ``path`` (one folder per round) and read them back.

    Events are numbered per chain without ordering a chain as a whole; every ``batch_events`` of them are one batch. A
    round seals the next batches of every chain that has some, ``round_events`` events of a chain or one batch, in
    parallel, and hands on one tail per chain. No task holds more than a round of a chain, the work is linear, small
    batches cost no rounds of their own, and the hashes are those of one walk over each chain.
    """
    spark = events.sparkSession
    per_round = max(1, round_events // batch_events)
    batch = F.floor(F.col("_number") / batch_events).cast("int")
    place = numbered(events, [chain], [seq], batch_events * per_round).withColumn("_batch", batch).drop("_number")
    place = place.withColumn("_round", F.floor(F.col("_batch") / per_round).cast("int"))
    waiting = f"{shared_root(spark)}/caretrace/{uuid.uuid4().hex}"
    place.write.partitionBy("_round").parquet(waiting)
    staged = spark.read.schema(place.schema).parquet(waiting)
    last = staged.agg(F.max("_round")).first()[0]
    for k in range(0 if last is None else last + 1):
        part = seal_audit_batch(staged.filter(F.col("_round") == k).drop("_round"), chain=chain, seq=seq, secret=secret, batch=F.col("_batch"), tails=tails)
        part.write.mode("overwrite").parquet(f"{path}/round={k}")
        if k < last:
            sealed = spark.read.schema(part.schema).parquet(f"{path}/round={k}")
            fresh = chain_tails(sealed, chain=chain, seq=seq)
            if k == 0 and tails is not None:  # chains without events in this request keep their tail
                fresh = fresh.unionByName(tails.select(chain, "tail_hash").join(fresh.select(chain), chain, "left_anti"))
            tails = fresh
    if last is None:
        return seal_audit_batch(events, chain=chain, seq=seq, secret=secret, tails=tails)
    discard_path(spark, waiting)
    return spark.read.schema(part.schema).parquet(path).select(*part.columns)


def chain_tails(sealed: DataFrame, *, chain: str, seq: str) -> DataFrame:
    """(chain, tail_hash): where the next batch goes on."""
    return sealed.groupBy(chain).agg(F.max_by("chain_hash", seq).alias("tail_hash"))


def batch_manifest(sealed: DataFrame, *, chain: str, seq: str) -> DataFrame:
    """(chain, batch, n_events, last_seq, tail_hash): what has to be there of each sealed batch."""
    return sealed.groupBy(chain, "batch").agg(
        F.count(F.lit(1)).alias("n_events"), F.max(seq).alias("last_seq"), F.max_by("chain_hash", seq).alias("tail_hash")
    )


def verify_audit_chain(stored: DataFrame, *, chain: str, seq: str, secret: str, manifest: DataFrame | None = None) -> DataFrame:
    """(chain, seq, reason) of what breaks the chain.

    The hash of a row is recomputed in place; its predecessor is looked up by hash. With the ``manifest`` a batch of which
    rows are missing, its end or all of it included, is reported at its last number. Nothing is ordered globally.
    """
    wanted = F.sha2(link_material(F.col("prev_hash"), *[F.col(c) for c in EVENT]), 256)
    local = stored.select(
        chain,
        seq,
        "prev_hash",
        F.when(wanted != F.col("chain_hash"), F.lit("content_changed"))
        .when(hmac_sha256(secret, F.col("chain_hash")) != F.col("hmac_sig"), F.lit("signature_invalid"))
        .alias("reason"),
    )
    altered = local.filter(F.col("reason").isNotNull()).select(chain, seq, "reason")
    tails = stored.select(chain, F.col("chain_hash").alias("prev_hash")).distinct()
    orphans = local.filter(F.col("prev_hash") != "").join(tails, [chain, "prev_hash"], "left_anti")
    found = altered.unionByName(orphans.select(chain, seq, F.lit("predecessor_missing").alias("reason")))
    if manifest is None:
        return found
    there = batch_manifest(stored, chain=chain, seq=seq).select(chain, "batch", F.col("n_events").alias("_n"), F.col("tail_hash").alias("_tail"))
    short = manifest.join(there, [chain, "batch"], "left").filter(
        ~F.coalesce((F.col("n_events") == F.col("_n")) & (F.col("tail_hash") == F.col("_tail")), F.lit(False))
    )
    return found.unionByName(short.select(chain, F.col("last_seq").alias(seq), F.lit("batch_incomplete").alias("reason")))


def pseudonymize_actor(actor: Column, *, secret: str) -> Column:
    value = F.trim(F.coalesce(actor, F.lit("")))
    safe = value.rlike("^[a-z][a-z0-9_]*:[0-9a-f]{64}$") | value.rlike("^system:[a-z][a-z0-9_]*$")
    return (
        F.when(safe, value)
        .when(value.isin("api", "management_command"), F.concat(F.lit("system:"), value))
        .when(value == "", F.lit("system:unknown"))
        .otherwise(F.concat(F.lit("legacy_actor:"), hmac_sha256(secret, F.concat(F.lit("legacy_actor:"), value))))
    )


def audit_allowlist(payload: Column, allowed: Sequence[str] = C.AUDIT_FIELDS) -> Column:
    """Map without unknown keys and empty values."""
    return F.map_filter(payload, lambda k, v: F.array_contains(string_array(allowed), k) & v.isNotNull() & (v != ""))


def audit_recent(events: DataFrame, *, limit: int | None = 100, order: Sequence[str] = ("created_at",)) -> DataFrame:
    """Newest first; ``limit`` None gives all."""
    rows = events.orderBy(*[F.col(c).desc() for c in order])
    return rows if limit is None else rows.limit(limit)


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str) -> DataFrame:
    """(key, action, changes): changed columns as {from, to}; unchanged rows are dropped."""
    cols = [c for c in old.columns if c != key]
    pack = lambda df, name: df.select(key, F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]).alias(name))
    both = pack(old, "_o").join(pack(new, "_n"), key, "full_outer")
    at = lambda m, k: F.try_element_at(m, k)
    pairs = F.map_from_entries(
        F.transform(string_array(cols), lambda k: F.struct(k.alias("key"), F.struct(at(F.col("_o"), k).alias("from"), at(F.col("_n"), k).alias("to")).alias("value")))
    )
    changed = F.map_filter(pairs, lambda k, v: ~v["from"].eqNullSafe(v["to"]))
    action = F.when(F.col("_o").isNull(), F.lit("create")).when(F.col("_n").isNull(), F.lit("delete")).otherwise(F.lit("update"))
    out = both.select(key, action.alias("action"), F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), changed).otherwise(pairs).alias("changes"))
    return out.filter((F.col("action") != "update") | (F.size("changes") > 0))


def change_log_query(log: DataFrame, *, label: str | None = None, object_id: str | None = None, limit: int | None = 100) -> DataFrame:
    rows = log if not label else log.filter(F.col("label") == label)
    rows = rows if not object_id else rows.filter(F.col("object_id") == object_id)
    rows = rows.orderBy(F.col("created_at").desc(), "object_id")
    return rows if limit is None else rows.limit(limit)


def human_in_loop(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, status, human_override_flag, n_decisions, decisions): the last decision sets the status."""
    order = F.struct("created_at", "decision_id")
    g = decisions.groupBy("run_id").agg(
        F.max_by("decision_type", order).alias("_last"),
        F.count(F.lit(1)).alias("n_decisions"),
        F.array_sort(F.collect_list(F.struct("created_at", "decision_id", "decision_type"))).alias("_d"),
    )
    last = F.col("_last")
    status = (
        F.when(last == "approve", F.lit("accepted"))
        .when(last == "override", F.lit("modified"))
        .when(last == "reject", F.lit("overridden"))
        .when(last == "note", F.lit("noted"))
        .otherwise(F.lit("unreviewed"))
    )
    return runs.select("run_id").join(g, "run_id", "left").select(
        "run_id",
        status.alias("status"),
        F.coalesce(last.isin("override", "reject"), F.lit(False)).alias("human_override_flag"),
        F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"),
        F.coalesce(F.transform("_d", lambda d: d["decision_type"]), F.array().cast("array<string>")).alias("decisions"),
    )


# --- denials ---------------------------------------------------------------------------------

# What a run of times does to the time logged last before it: entry x (the earliest time that may be logged) up to hi[j]
# leaves exits[j] as the time logged last; beyond the last hi nothing is logged. ``low`` is the first time of the run.
NODE = "_key string, first long, level int, low long, hi array<long>, exits array<long>"


def _pieces(hi: np.ndarray, exits: np.ndarray, low: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that lead to the same exit are one piece; entries no earlier time can cause are left out."""
    reach = int(np.searchsorted(hi, low + gap)) + 1
    hi, exits = hi[:reach], exits[:reach]
    ends = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
    return hi[ends], exits[ends]


def _after(carry: np.ndarray, hi: np.ndarray, exits: np.ndarray, gap: int) -> np.ndarray:
    """The time logged last after a run, for each time logged last before it."""
    j = np.searchsorted(hi, carry + gap)
    return np.where(j < len(hi), np.append(exits, 0)[np.minimum(j, len(hi))], carry)


def _ordered(group: pa.Table) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    rows = sorted(group.to_pylist(), key=lambda r: r["first"])
    return [(r, np.array(r["hi"], np.int64), np.array(r["exits"], np.int64)) for r in rows]


def _summary(gap: int) -> Callable[[pa.Table], pa.Table]:
    """A slice of times as a node."""

    def run(group: pa.Table) -> pa.Table:
        t = np.sort(group["_t"].to_numpy())
        following = np.searchsorted(t, t + gap).tolist()
        last = t.tolist()
        for i in range(len(last) - 1, -1, -1):
            if following[i] < len(last):
                last[i] = last[following[i]]
        hi, exits = _pieces(t, np.array(last, np.int64), int(t[0]), gap)
        return pa.table({"_key": group["_key"].slice(0, 1), "first": pa.array([group["_slice"][0].as_py()], pa.int64()), "level": pa.array([0], pa.int32()), "low": pa.array([int(t[0])]), "hi": [hi.tolist()], "exits": [exits.tolist()]})

    return run


def _joined(level: int, gap: int) -> Callable[[pa.Table], pa.Table]:
    """Neighbouring nodes as one: entries are carried through all of them."""

    def run(group: pa.Table) -> pa.Table:
        parts = _ordered(group)
        low = parts[0][0]["low"]
        entry = np.unique(np.concatenate([hi for _, hi, _ in parts]))
        carry = entry - gap
        for _, hi, exits in parts:
            carry = _after(carry, hi, exits, gap)
        hi, exits = _pieces(entry, carry, low, gap)
        return pa.table({"_key": group["_key"].slice(0, 1), "first": pa.array([parts[0][0]["first"]], pa.int64()), "level": pa.array([level], pa.int32()), "low": pa.array([low]), "hi": [hi.tolist()], "exits": [exits.tolist()]})

    return run


def _handed_down(gap: int) -> Callable[[pa.Table], pa.Table]:
    """(_key, first, level, carry) of the nodes of a group, whose first one is entered with the group's carry."""

    def run(group: pa.Table) -> pa.Table:
        carry, out = np.array([group["carry"][0].as_py()], np.int64), []
        for r, hi, exits in _ordered(group):
            out.append((r["first"], r["level"], int(carry[0])))
            carry = _after(carry, hi, exits, gap)
        first, level, entered = zip(*out, strict=True)
        return pa.table({"_key": pa.concat_arrays([group["_key"].slice(0, 1).combine_chunks()] * len(out)) if out else [], "first": pa.array(first, pa.int64()), "level": pa.array(level, pa.int32()), "carry": pa.array(entered, pa.int64())})

    return run


def denial_dedupe(denials: DataFrame, *, keys: Sequence[str], ts: str, seconds: int = 60, slice_rows: int = 100_000, fan_in: int = 8, seed: DataFrame | None = None) -> DataFrame:
    """First denial per key, then none until ``seconds`` have passed since the one that was logged.

    Which times are logged depends on the last logged one, so a key's times are a chain of maps "logged last before ->
    logged last after". Times are cut into slices of about ``slice_rows`` whatever their key and span; each slice is
    reduced to the distinct exits its entries can lead to, neighbouring maps are joined ``fan_in`` at a time up a tree, and
    the entries come down it again, until each slice can be walked from its own. Nodes whose maps together have more than
    ``slice_rows`` pieces (times so dense that hardly any two entries meet) are not joined but entered one after the other,
    one round for the n-th node of every key. So no task holds more than a slice's rows or pieces, whether ``seconds`` is a
    minute or a day. ``seed`` (keys, last_logged) holds what was logged before; null times do not count.
    """
    keys, gap = list(keys), seconds * 1_000_000
    spark, kinds = denials.sparkSession, dict(denials.dtypes)
    name = F.to_json(F.struct(*keys)).alias("_key")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    times = denials.filter(F.col(ts).isNotNull()).select(name, micros.alias("_t")).distinct()
    slices = range_slices(times, ["_key"], ["_t"], slice_rows)
    nodes = cut_lineage(slices.groupBy("_key", "_slice").applyInArrow(_summary(gap), NODE))
    count = nodes.agg(F.max("first")).first()[0] or 0
    written, links, level = [slices, nodes], [], 0
    while fan_in**level <= count:
        level += 1
        grouped = nodes.withColumn("_group", F.floor(F.col("first") / fan_in**level).cast("long"))
        small = grouped.groupBy("_key", "_group").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("hi")).alias("_p")).filter((F.col("_n") > 1) & (F.col("_p") <= slice_rows))
        marked = cut_lineage(grouped.join(small, ["_key", "_group"], "left"))
        written.append(marked)
        below = marked.filter(F.col("_n").isNotNull()).drop("_n", "_p")
        joined = cut_lineage(below.groupBy("_key", "_group").applyInArrow(_joined(level, gap), NODE))
        written.append(joined)
        links.append((level, below))
        nodes = joined.unionByName(marked.filter(F.col("_n").isNull()).select(joined.columns))
    # What is left of a key is entered in order, its n-th node in round n.
    turn = nodes.withColumn("_turn", F.row_number().over(Window.partitionBy("_key").orderBy("first")))
    turn = cut_lineage(turn)
    written.append(turn)
    start = F.lit(-(1 << 62))
    state = turn.select("_key").distinct().withColumn("carry", start)
    if seed is not None:
        before = seed.select(name.alias("_key"), F.unix_micros(F.col("last_logged").cast("timestamp")).alias("_seed")).groupBy("_key").agg(F.max("_seed").alias("_seed"))
        state = state.join(before, "_key", "left").select("_key", F.coalesce("_seed", "carry").alias("carry"))
    rounds = turn.agg(F.max("_turn")).first()[0] or 0
    if not rounds:
        discard(*written)
        return denials.select(*keys, ts).limit(0)
    folder = f"{shared_root(spark)}/caretrace/{uuid.uuid4().hex}"
    passed = "_key string, first long, level int, carry long, after long"
    for k in range(1, rounds + 1):
        here = turn.filter(F.col("_turn") == k).join(state, "_key")
        at = F.array_position(F.transform("hi", lambda h: h >= F.col("carry") + gap), True)
        after = F.when(at > 0, F.get("exits", (at - 1).cast("int"))).otherwise(F.col("carry")).alias("after")
        here.select("_key", "first", "level", "carry", after).write.parquet(f"{folder}/round={k}")
        state = spark.read.schema(passed).parquet(f"{folder}/round={k}").select("_key", F.col("after").alias("carry"))
    entered = spark.read.schema(passed).parquet(folder).select("_key", "first", "level", "carry")
    for made_at, below in reversed(links):
        parents = entered.filter(F.col("level") == made_at).select("_key", F.floor(F.col("first") / fan_in**made_at).cast("long").alias("_group"), "carry")
        down = below.join(parents, ["_key", "_group"]).groupBy("_key", "_group").applyInArrow(_handed_down(gap), "_key string, first long, level int, carry long")
        entered = entered.filter(F.col("level") != made_at).unionByName(down)

    def walk(group: pa.Table) -> pa.Table:
        t = np.sort(group["_t"].to_numpy())
        i, logged = int(np.searchsorted(t, group["carry"][0].as_py() + gap)), []
        while i < len(t):
            logged.append(i)
            i = int(np.searchsorted(t, t[i] + gap))
        return pa.table({"_key": pa.array([group["_key"][0].as_py()] * len(logged), pa.string()), "_t": t[logged]})

    starts = entered.select("_key", F.col("first").alias("_slice"), "carry")
    logged = slices.join(starts, ["_key", "_slice"]).groupBy("_key", "_slice").applyInArrow(walk, "_key string, _t long")
    out = cut_lineage(logged)
    discard(*written)
    discard_path(spark, folder)
    parts = F.from_json("_key", ", ".join(f"`{k}` {kinds[k]}" for k in keys))
    return out.withColumn("_k", parts).select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.timestamp_micros("_t").cast(kinds[ts]).alias(ts))
