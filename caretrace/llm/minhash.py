"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.common import LOWER_BYTES, staged
from caretrace.llm.components import components

#: Sketch coordinates are BANDS x ROWS. A pair at 0.85 misses every band with odds of (1 - 0.85^6)^40 = 6e-9.
BANDS, ROWS = 40, 6
SHINGLE_WORDS = 5
#: Members of one verification block, and columns of one dense slice of its document x shingle matrix.
BLOCK, SLICE = 256, 16384
#: Shingles that one vectorised sketching step holds.
CHUNK = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_ids(text: str | None) -> np.ndarray:
    """Sorted 64-bit ids of a text's distinct word shingles; of a shorter text, one id of all its words."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(ids) - SHINGLE_WORDS + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(SHINGLE_WORDS):
        rolled = mix64(rolled + ids[i : i + n] * _MIX[0] + np.uint64(i))
    return np.unique(rolled)


def fast_sketch(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates per set (none empty): fast similarity sketching.

    Each round hashes every element to one bin and a value. Rounds 0 to size - 1 pick the bin by the hash, round size + b
    throws all elements into bin b, so that after 2 x size rounds every bin is filled, whatever the set. A bin keeps the
    smallest (round, value). Sets whose bins are all filled leave; a set of n elements needs about size ln(size) / n rounds.
    """
    lengths = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(len(sets) * size, empty)
    for r in range(2 * size):
        h = mix64(elements ^ mix64(np.array([r + 1], np.uint64) * _MIX[3]))
        place = (h >> np.uint64(44)) % np.uint64(size) if r < size else np.full(len(h), r - size, np.uint64)
        value = (np.uint64(r) << np.uint64(44)) | (h & np.uint64((1 << 44) - 1))
        np.minimum.at(bins, owner * size + place.astype(np.int64), value)
        open_sets = (bins.reshape(-1, size) == empty).any(axis=1)
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return bins.reshape(-1, size)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketches.shape[1] // bands
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[4], (len(sketches), 1))
    for i in range(rows):
        key = mix64(key * _MIX[0] + parts[:, :, i])
    return key.view(np.int64)


def _signature(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.tobytes(), digest_size=16).digest()


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at = batch.column(1), 0
        while at < batch.num_rows:
            sets, held, start = [], 0, at
            while at < batch.num_rows and held < CHUNK:
                sets.append(shingle_ids(texts[at].as_py()))
                held += len(sets[-1])
                at += 1
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(fast_sketch([sets[i] for i in full])) if full else np.zeros((0, BANDS), np.int64)
            ends = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, at - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                ],
                ["id", "n", "sig", "bands"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            sigs = batch.column(0).slice(at, BLOCK).to_pylist()
            sets = [shingle_ids(t) for t in batch.column(1).slice(at, BLOCK).to_pylist()]
            rows = [(sig, len(s), s.tobytes()) for sig, s in zip(sigs, sets, strict=True) if len(s) and _signature(s) == sig]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["sig", "n", "ids"]
            )


def _linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int):
    return 100 * common >= percent * (n + m - common)


def _pair_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    keep.append(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block, as matrix products over slices of the shingles that two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    slot = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], slot[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(column, [first, first + SLICE])
        dense = np.zeros((len(sets), SLICE), np.float32)
        dense[owner[lo:hi], column[lo:hi] - first] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


def joining_links(sigs: list, comps: list, pairs: Iterator[tuple[int, int]], test=None) -> list[tuple]:
    """Of the given pairs those that join two groups still apart, one per join; ``test`` confirms a pair when it is its turn."""
    parent = {c: c for c in comps}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for x, y in pairs:
        p, q = find(comps[x]), find(comps[y])
        if p != q and (test is None or test(x, y)):
            parent[p] = q
            found.append((sigs[x], sigs[y]))
    return found


def block_parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The blocks of one task with more than one group, in a fixed order, repeated rows left out."""
    pdf = pdf.drop_duplicates(["part", "sig"]).sort_values(["part", "sig"], ignore_index=True)
    edges = np.flatnonzero(np.diff(pdf["part"].to_numpy(np.int64), prepend=pdf["part"].iloc[0] - 1, append=pdf["part"].iloc[-1] + 1))
    comps = pdf["comp"].tolist()
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo > 1 and any(c != comps[lo] for c in comps[lo:hi]):
            yield pdf.iloc[lo:hi]


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for part in block_parts(pdf):
            sets = [np.frombuffer(x, np.uint64) for x in part["ids"]]
            n = np.array([len(s) for s in sets])
            i, j = np.nonzero(np.triu(_linked(common_counts(sets), n[:, None], n[None, :], percent), 1))
            found += joining_links(part["sig"].tolist(), part["comp"].tolist(), zip(i.tolist(), j.tolist(), strict=True))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def unresolved_blocks(sets: DataFrame, clusters: DataFrame, comps: DataFrame, percent: int, content: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(task, part, sig, comp, content): the blocks (parts) that still have to be compared, several small ones to a task.

    Members of a candidate cluster fall into classes by set size, in which linked sets are at most one class apart, and
    into hash blocks of about BLOCK. The cluster's largest verified group is set apart: two of its blocks never meet.
    """
    members = (
        clusters.select(F.col("node").alias("sig"), F.col("root").alias("cluster"))
        .join(comps.select(F.col("node").alias("sig"), F.col("root").alias("comp")), "sig", "left")
        .join(sets.select("sig", "n"), "sig")
        .withColumn("comp", F.coalesce("comp", "sig"))
    )
    most = clusters.count()
    members = staged(members, most)
    per_comp = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = staged(
        per_comp.groupBy("cluster")
        .agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("k").alias("members"))
        .where("groups > 1"),
        most,
    )
    class_of = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + 1e-9)
    placed = members.join(mixed, "cluster").select(
        "cluster", "sig", "comp",
        F.when(F.col("members") <= BLOCK, F.lit(0)).otherwise(class_of).cast("long").alias("cls"),
        ((F.col("comp") == F.col("main")) & (F.col("members") > BLOCK)).alias("main_side"),
    )
    placed = staged(placed, most)
    block = ["cluster", "cls", "main_side"]
    sizes = staged(placed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")), most)
    left = sizes.select("cluster", F.col("cls").alias("l_cls"), F.col("main_side").alias("l_main"), F.col("blocks").alias("l_blocks"), F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("r_cls"))
    right = sizes.select("cluster", F.col("cls").alias("r_cls"), F.col("main_side").alias("r_main"), F.col("blocks").alias("r_blocks"))
    tasks = (
        left.join(right, ["cluster", "r_cls"])
        .where("not (l_main and r_main) and not (l_cls = r_cls and l_main and not r_main)")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_blocks") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_blocks") - 1)))
        .where("not (l_cls = r_cls and l_main = r_main) or i <= j")
        .withColumn("part", F.xxhash64("cluster", "l_cls", "l_main", "i", "r_cls", "r_main", "j"))
    )
    sides = F.explode(F.array(F.struct(F.col("l_cls").alias("cls"), F.col("l_main").alias("main_side"), F.col("i").alias("sub")), F.struct(F.col("r_cls").alias("cls"), F.col("r_main").alias("main_side"), F.col("j").alias("sub"))))
    needed = staged(tasks.select("cluster", "part", sides.alias("s")).select("cluster", "part", "s.*").distinct())
    small = mixed.where(F.col("members") <= BLOCK)
    tasks_for_small = max(1, -(-(small.agg(F.sum("members")).first()[0] or 0) // (8 * BLOCK)))
    gathered = placed.join(small.select("cluster", F.lit(True).alias("is_small")), "cluster", "left")
    task = F.when(F.col("is_small"), F.pmod(F.xxhash64("cluster"), F.lit(tasks_for_small))).otherwise(F.col("part"))
    dealt = gathered.join(sizes, block).withColumn("sub", F.pmod(F.xxhash64("sig"), F.col("blocks"))).drop("blocks")
    return dealt.join(needed, [*block, "sub"]).select(task.alias("task"), "part", "sig", "comp").join(sets.select("sig", *content), "sig")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of its group), kept (id = component_id).

    Two documents are linked when 100 x common >= ``percent`` x united distinct five-word shingles (A-Z lower-cased); groups
    are what links connect.

    1. Equal shingle sets collapse to one class by a partial aggregate, so exact copies cost one row.
    2. Classes meet in the buckets of their sketch's bands. Every class is verified on full sets against the smallest class
       of its buckets, and these links are joined to groups.
    3. What shares buckets but is still apart is compared completely, in blocks of a few hundred classes of like size; a
       block returns only links that join groups. No partner is left out, and pairs are never written out.

    * null, empty and wordless texts have n_shingles 0 and are linked with nothing; long texts are used whole
    * rows without an id take no part: component_id null, kept true
    * rows that repeat an id and a text are marked alike; other columns are ignored; an empty table gives an empty result
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = staged(plain.mapInArrow(_sketch_batches, "id long, n long, sig binary, bands array<long>"))
    classes = staged(
        sketches.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    )
    most = classes.count()
    banded = classes.select("sig", F.explode("bands").alias("bucket"))
    # Lookups are written, not only grouped: a join of two tables that are both dealt anew can be split where a key is hot.
    leaders = staged(banded.groupBy("bucket").agg(F.min("sig").alias("leader"), F.max("sig").alias("last")).where("leader <> last").drop("last"))
    stars = staged(banded.join(leaders, "bucket").where("sig <> leader").select(F.col("sig").alias("a"), F.col("leader").alias("b")).distinct())
    clusters = staged(components(stars), most)
    wanted = clusters.select(F.col("node").alias("sig")).join(classes.select("sig", "rep"), "sig")
    sets = staged(plain.join(wanted, F.col("id") == F.col("rep")).select("sig", "text").mapInArrow(_set_batches, "sig binary, n long, ids binary"))
    if sets.count() > clusters.count():  # rows that repeat id and text
        sets = staged(sets.dropDuplicates(["sig"]))
    pivots = stars.groupBy("a").agg(F.min("b").alias("b"))
    pairs = pivots.join(sets.select(F.col("sig").alias("a"), F.col("ids").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("ids").alias("y")), "b")
    first = staged(pairs.select("a", "b", "x", "y").mapInArrow(_pair_batches(percent), "a binary, b binary"))
    comps = staged(components(first), most)
    blocks = unresolved_blocks(sets, clusters, comps, percent)
    second = staged(blocks.groupBy("task").applyInPandas(_block_links(percent), "a binary, b binary"))
    groups = staged(components(first.unionByName(second)), most)
    smallest = groups.join(classes.select(F.col("sig").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    named = classes.select("sig", "rep").join(groups.join(smallest, "root").select(F.col("node").alias("sig"), "component"), "sig", "left")
    named = staged(named.select("sig", F.coalesce("component", "rep").alias("component")), most)
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return sketches.select("id", "n", "sig").join(named, "sig", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the ids of which no row is kept, all columns kept."""
    marks = near_duplicates(docs, percent, id_col, text_col)
    gone = marks.groupBy(id_col).agg(F.max("kept").alias("stays")).where("not stays").select(F.col(id_col).alias("__ct_gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__ct_gone"), "left_anti")
