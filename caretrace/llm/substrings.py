"""Suffix-array dedup of bytes: transforms of shards, merged, give the repeated intervals of ``limit`` bytes.

The suffixes are dealt out by content before anything is sorted. Each window of ``limit`` bytes belongs to the gram in it
with the smallest hash, so equal windows belong to equal grams. Neighbouring windows of one gram form a stretch.

1. Pages of some megabytes of text tell, by bucket of gram hashes, which grams they have; the answer is one bit per gram:
   whether it occurs again anywhere. Windows of other grams cannot repeat.
2. Stretches of repeated grams are grouped by gram and digest; all but the first of equal stretches repeat whole.
3. Where a gram has several different stretches, one text of each goes to the gram's bucket. The bucket's strings are split
   into shards, each gets its transform, and the transforms are merged by refining their interleave. Rows with a common
   prefix of ``limit`` bytes are one repeated interval; ties stand in order of occurrence, so all rows but an interval's
   first are repeats.
4. A gram with more different stretches than a task should merge is dealt out by its windows' digests instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.bwt import repeated_starts
from caretrace.llm.common import staged, unstage
from caretrace.llm.tokens import chunks

LIMIT = 100
#: Bytes of a gram; a window of LIMIT bytes has LIMIT - GRAM + 1 of them.
GRAM = 40
#: Text of a page, of a bucket of grams, of a merge and of a shard. A merge holds about 50 bytes for each of its text.
PAGE_BYTES, BUCKET_BYTES, MERGE_BYTES, SHARD_BYTES = 4 << 20, 16 << 20, 2 << 20, 512 << 10
#: Text of a page that is cut into stretches at a time, with about 80 bytes for each of it.
SLICE_BYTES = 1 << 20
#: Different stretches of one gram that a merge takes; beyond that the gram's windows are dealt out one by one.
MOST_STRETCHES = 8192
BASE = 0x9E3779B97F4A7C15
PLACE = ["no_id", "id", "text_key", "page", "doc", "start"]
U8 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * U8(pow(base, m, 1 << 64))
        m += k
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(31))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(29))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(32))


class Stretches:
    """Cuts a buffer of documents into stretches of windows that belong to the same gram."""

    def __init__(self, limit: int = LIMIT, gram: int = GRAM, slice_bytes: int = SLICE_BYTES):
        self.limit, self.gram, self.slice = limit, gram, slice_bytes
        self.up = _powers(BASE, slice_bytes + limit + 1)
        self.down = _powers(pow(BASE, -1, 1 << 64), slice_bytes + limit + 1)

    def of(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of windows, gram hash, digest) of every stretch; ``ends`` are the documents' ends in ``data``."""
        parts = [self._slice(data, ends, a) for a in range(0, max(len(data) - self.limit + 1, 0), self.slice)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, d) for k, d in enumerate((np.int64, np.int64, np.uint64, np.uint64)))

    def _slice(self, data: bytes, ends: np.ndarray, base: int):
        """The stretches whose windows start in one slice; a digest and an owner depend on the window's bytes only."""
        buf = np.frombuffer(data, np.uint8)[base : base + self.slice + self.limit - 1]
        n, windows = len(buf), len(buf) - self.limit + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + U8(1)) * self.up[:n], out=sums[1:])
        grams = n - self.gram + 1
        h = _stir((sums[self.gram :] - sums[:grams]) * self.down[:grams])
        # smallest hash of each window, the leftmost of equal ones: place in the low bits
        low = U8((1 << int(n).bit_length()) - 1)
        best, width, have = (h & ~low) | np.arange(grams, dtype=np.uint64), self.limit - self.gram + 1, 1
        while have * 2 <= width:
            best, have = np.minimum(best[:-have], best[have:]), have * 2
        if have < width:
            best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
        owner = (best & low).astype(np.int64)
        # windows that lie in one document
        starts = np.concatenate([[0], ends[:-1]])
        whole = ends - starts >= self.limit
        inside = np.zeros(windows + 1, np.int64)
        np.add.at(inside, np.clip(starts[whole] - base, 0, windows), 1)
        np.add.at(inside, np.clip(ends[whole] - self.limit + 1 - base, 0, windows), -1)
        owner[np.cumsum(inside[:-1]) == 0] = -1
        # a stretch never crosses documents
        cut = np.zeros(windows, bool)
        cut[0] = True
        cut[1:] = owner[1:] != owner[:-1]
        first = starts[(starts > base) & (starts < base + windows)] - base
        cut[first] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], windows)
        keep = owner[a] >= 0
        a, b = a[keep], b[keep]
        digest = _stir((sums[b + self.limit - 1] - sums[a]) * self.down[a] ^ (b - a).astype(np.uint64))
        return a + base, b - a, h[owner[a]], digest


def _page_rows(docs: DataFrame, id_col: str, text_col: str, page_bytes: int) -> DataFrame:
    """(page, ids, sizes, texts, n_bytes): documents by pages of about ``page_bytes``, their texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, list[bytes], int]] = []

        def page() -> pa.RecordBatch:
            texts = [t for _, part, _ in held for t in part]
            ids = pa.concat_arrays([i for i, _, _ in held])
            one = pa.array([0, len(texts)], pa.int32())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | n], pa.int64()), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, sizes), pa.array([packed], pa.binary()), pa.array([sum(sizes.to_pylist())], pa.int64())],
                ["page", "ids", "sizes", "texts", "n_bytes"],
            )

        for part, texts in chunks(batches, 1, page_bytes):
            held.append((part.column(0), texts, sum(map(len, texts))))
            if sum(h[2] for h in held) >= page_bytes * 3 // 4:
                yield page()
                n += 1
        if held:
            yield page()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "page long, ids array<long>, sizes array<long>, texts binary, n_bytes long")


def _open(page: dict) -> tuple[bytes, np.ndarray]:
    ends = np.cumsum(np.array(page["sizes"], np.int64))
    return zstandard.ZstdDecompressor().decompress(page["texts"], max_output_size=max(int(page["n_bytes"]), 1)) if page["n_bytes"] else b"", ends


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U8(20)) % U8(buckets)).astype(np.int64)


def _repeated_stretches(pages: DataFrame, buckets: int, limit: int, gram: int) -> DataFrame:
    """(place, n, h, digest) of the stretches whose gram occurs again in the corpus."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Stretches(limit, gram)
        for batch in batches:
            for page in batch.to_pylist():
                h = np.unique(cutter.of(*_open(page))[2])
                order, b = np.argsort(_bucket_of(h, buckets), kind="stable"), np.sort(_bucket_of(h, buckets))
                h, cuts = h[order], np.searchsorted(b, np.arange(buckets + 1))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), page["page"])), pa.array([h[cuts[k] : cuts[k + 1]].tobytes() for k in full.tolist()], pa.binary())], ["bucket", "page", "grams"]
                )

    def answer(asked: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in asked["grams"].to_pylist()]
        every, n = np.unique(np.concatenate(lists), return_counts=True)
        again = every[n > 1]
        marks = [np.packbits(np.isin(x, again, assume_unique=True)).tobytes() for x in lists]
        return pa.table({"bucket": asked["bucket"], "page": asked["page"], "marks": pa.array(marks, pa.binary())})

    def pick(page: pa.Table, answers: pa.Table) -> pa.Table:
        cutter, out = Stretches(limit, gram), []
        said = dict(zip(answers["bucket"].to_pylist(), answers["marks"].to_pylist(), strict=True))
        for p in page.to_pylist():
            data, ends = _open(p)
            start, n, h, digest = cutter.of(data, ends)
            own, back, count = np.unique(h, return_inverse=True, return_counts=True)
            bucket = _bucket_of(own, buckets)
            order = np.argsort(bucket, kind="stable")
            again = np.zeros(len(own), bool)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                mine = order[cuts[k] : cuts[k + 1]]
                again[mine] = np.unpackbits(np.frombuffer(said[k], np.uint8), count=len(mine)).astype(bool)
            keep = (again | (count > 1))[back]
            start, n, h, digest = start[keep], n[keep], h[keep], digest[keep]
            doc = np.searchsorted(ends, start, side="right")
            begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            key = np.zeros(len(ends), np.int64)
            for k in np.unique(doc).tolist():
                key[k] = xxhash.xxh3_64_intdigest(data[begin[k] : ends[k]]) >> 1
            ids = pa.array(p["ids"], pa.int64()).take(pa.array(doc))
            out.append(
                pa.table(
                    {"no_id": ids.is_null(), "id": ids.fill_null(0), "text_key": key[doc], "page": np.full(len(doc), p["page"]), "doc": doc.astype(np.int32), "start": start - begin[doc], "n": n.astype(np.int32), "h": h.view(np.int64), "digest": digest.view(np.int64)}
                )
            )
        return pa.concat_tables(out)

    answers = pages.select("page", "ids", "sizes", "texts", "n_bytes").mapInArrow(ask, "bucket long, page long, grams binary").groupBy("bucket").applyInArrow(answer, "bucket long, page long, marks binary")
    return pages.groupBy("page").cogroup(answers.groupBy("page")).applyInArrow(
        pick, "no_id boolean, id long, text_key long, page long, doc int, start long, n int, h long, digest long"
    )


def _texts_of(pages: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """``wanted`` (place, n, h, kinds) with the bytes of each stretch."""

    def fetch(page: pa.Table, asked: pa.Table) -> pa.Table:
        if not page.num_rows or not asked.num_rows:
            return asked.append_column("bytes", pa.array([b""] * asked.num_rows, pa.binary())).slice(0, 0)
        data, ends = _open(page.to_pylist()[0])
        begin = np.concatenate([[0], ends[:-1]])[asked["doc"].to_numpy()] + asked["start"].to_numpy()
        stop = begin + asked["n"].to_numpy() + limit - 1
        return asked.append_column("bytes", pa.array([data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return pages.groupBy("page").cogroup(wanted.groupBy("page")).applyInArrow(fetch, f"{kinds}, bytes binary")


def _ranges(strings: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, a, b) of the runs of neighbouring offsets, given in order."""
    cut = np.ones(len(strings), bool)
    cut[1:] = (strings[1:] != strings[:-1]) | (offsets[1:] != offsets[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(strings)) - 1
    return strings[first], offsets[first], offsets[last] + 1


def _merged_repeats(texts: DataFrame, buckets: int, limit: int, shard_bytes: int) -> DataFrame:
    """(page, doc, a, b): window starts of first stretches that repeat a window of another stretch of the gram."""

    def merge(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in PLACE])
        repeats = repeated_starts(rows["bytes"].to_pylist(), limit, shard_bytes)
        at, a, b = _ranges(repeats[:, 0], repeats[:, 1])
        start = rows["start"].to_numpy()[at]
        return pa.table({"page": rows["page"].take(pa.array(at)), "doc": rows["doc"].take(pa.array(at)), "a": start + a, "b": start + b})

    bucketed = texts.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(merge, "page long, doc int, a long, b long")


def _dealt_repeats(texts: DataFrame, limit: int) -> DataFrame:
    """The same for grams with very many stretches: every window by its digest, the first place by a partial aggregate."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, text = batch.slice(row, 1), batch.column(batch.schema.get_field_index("bytes"))[row].as_py()
                n = len(text) - limit + 1
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k : k + limit]) for k in range(n)), np.int64).reshape(-1, 2)
                same = pa.array(np.zeros(n, np.int32))
                columns = [one.column(one.schema.get_field_index(c)).take(same) for c in PLACE[:-1]]
                start = one.column(one.schema.get_field_index("start"))[0].as_py() + np.arange(n)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(start), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], [*PLACE, "w1", "w2"])

    rows = staged(texts.mapInArrow(windows, "no_id boolean, id long, text_key long, page long, doc int, start long, w1 long, w2 long"))
    first = staged(rows.groupBy("w1", "w2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(first, ["w1", "w2"]).where(F.struct(*PLACE) != F.col("first")).select("page", "doc", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))


def repeated_bytes(docs: DataFrame, limit: int = LIMIT, gram: int = GRAM, most_stretches: int = MOST_STRETCHES, page_bytes: int = PAGE_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (maximal removed ranges [start, end) in bytes), kept (the rest).

    A byte goes when a string of ``limit`` bytes over it also starts earlier: in a document with a smaller id, or earlier in
    the same one. Strings are judged on the input, matches never cross documents, overlaps count.

    * null text counts as empty; texts shorter than ``limit`` stay whole, long ones are used whole
    * documents without an id come after all others; rows that repeat an id are documents of their own, in the order of a
      hash of their texts, so of rows that repeat an id and a text one stays
    * an empty table gives an empty result; other columns are ignored
    """
    pages = staged(_page_rows(docs, id_col, text_col, page_bytes))
    total = pages.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    found = staged(_repeated_stretches(pages, max(1, -(-total // BUCKET_BYTES)), limit, gram))
    first = F.min(F.struct(*PLACE, "n")).alias("first")
    kinds = staged(found.groupBy("h", "digest").agg(first))
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = staged(kinds.join(several, "h").select("h", "kinds", "first.*"))
    size = wanted.where(F.col("kinds") <= most_stretches).agg(F.coalesce(F.sum(F.col("n") + limit), F.lit(0)), F.count(F.lit(1))).first()[0]
    texts = staged(_texts_of(pages, wanted, limit))
    parts = _merged_repeats(texts.where(F.col("kinds") <= most_stretches), max(1, -(-size // MERGE_BYTES)), limit, shard_bytes)
    parts = parts.unionByName(_dealt_repeats(texts.where(F.col("kinds") > most_stretches), limit))
    whole = found.join(kinds.select("h", "digest", "first"), ["h", "digest"]).where(F.struct(*PLACE, "n") != F.col("first"))
    parts = staged(parts.unionByName(whole.select("page", "doc", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))))
    for used in (found, kinds, wanted, texts):
        unstage(used)

    def cut(page: pa.Table, repeats: pa.Table) -> pa.Table:
        if not page.num_rows:
            return OUT.empty_table()
        p = page.to_pylist()[0]
        data, ends = _open(p)
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        doc = repeats["doc"].to_numpy()
        base = begin[doc] if len(doc) else np.zeros(0, np.int64)
        delta = np.zeros(len(data) + 1, np.int64)
        np.add.at(delta, base + repeats["a"].to_numpy(), 1)
        np.add.at(delta, base + repeats["b"].to_numpy() + limit - 1, -1)
        gone = np.cumsum(delta[:-1]) > 0
        buf, spans, kept = np.frombuffer(data, np.uint8), [], []
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            kept.append(buf[a:b][~mine].tobytes() if len(edges) else data[a:b])
        return pa.table([pa.array(p["ids"], pa.int64()), pa.array(p["sizes"], pa.int64()), pa.array(spans, OUT.field("spans").type), pa.array(kept, pa.binary())], schema=OUT)

    out = pages.groupBy("page").cogroup(parts.groupBy("page")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
