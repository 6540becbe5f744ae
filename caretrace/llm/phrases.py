"""Phrase collocations: frequent phrases by a sample and its negative border, scored by their weakest cut.

Toivonen's scheme. The sample proposes words and phrases. A full pass counts all words, and of longer phrases those whose
two shorter parts are proposed: the proposed ones and their negative border, exactly. Where something turns out frequent
that the sample did not propose, a further pass counts what that failure adds, until nothing new turns up (one pass per
phrase length at most). The proposals travel as a bit table of a stated size: a chance hit there means one phrase more is
counted, never one less, and a full table means that all phrases are counted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caretrace.llm.common import LOWER_BYTES, staged, unstage
from caretrace.llm.tokens import byte_class, text_bytes, words_and_gaps

#: What ends a piece, and what stands between words of a piece.
PIECE_END = byte_class(b".,;:!?\n\x0b\x0c\r")
GAP = PIECE_END | byte_class(b" \t")
#: Bits of a table of proposals: 4 MB for the words and 4 MB for each phrase length below the longest, at every size of the corpus.
TABLE_BITS = 1 << 25
#: 64-bit words of a table that are packed into one row.
BLOCK_SLOTS = 1024
#: Text that a task holds before it hands on its counts.
HELD_BYTES = 6 << 20
FOLD = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(len(table) * 8 - 1)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def phrase_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    """One hash per word; a phrase's hash folds those of its words together."""
    return np.array([xxhash.xxh3_64_intdigest(lang + b"\0" + w) for w in words], np.uint64)


def fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _stir(left * FOLD + right)


def phrase_counts(lang: bytes, data: bytes, most: int, now: list[np.ndarray] | None, before: list[np.ndarray] | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(number of words, phrases, occurrences) in ``data`` (lower-case, a piece end at both ends).

    ``now``: tables of the proposed words and phrases by length; phrases whose two shorter parts are both in them are
    counted, but not those that ``before`` let through already. None: nothing is left out.
    """
    number, words, gap, gaps, _ = words_and_gaps(data, GAP)
    if not len(number):
        return
    ends = np.array([bool(PIECE_END[np.frombuffer(g, np.uint8)].any()) for g in gaps.to_pylist()])
    breaks = ends[gap][1:-1]  # a piece ends between word i and the next
    if before is None:
        yield 1, words, np.bincount(number, minlength=len(words))
    word_hashes = phrase_hashes(lang, words.to_pylist())
    hashes, follows = word_hashes[number], np.append(~breaks, False)  # of the phrase at each place; whether the piece goes on
    fits = np.ones(len(number), bool)
    for size in range(2, most + 1):
        ahead = follows[size - 2 :]
        fits[: len(ahead)] &= ahead
        fits[len(ahead) :] = False
        at = np.flatnonzero(fits)
        left, right = hashes[at], hashes[at + 1]
        if now is not None:
            wanted = _has(now[size - 2], left) & _has(now[size - 2], right)
            fresh = wanted if before is None else wanted & ~(_has(before[size - 2], left) & _has(before[size - 2], right))
            at = at[fresh]
        keys, n = _distinct([number[at + k] for k in range(size)], len(words))
        if len(n):
            yield size, pc.binary_join_element_wise(*(words.take(pa.array(k)) for k in keys), pa.scalar(b" ", words.type)), n
        if size < most:
            last = max(len(number) - size + 1, 0)
            hashes[:last] = fold(hashes[:last], word_hashes[number[size - 1 :]])


def _distinct(parts: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns of numbers below ``base``, and how often each occurs."""
    if not len(parts[0]):
        return parts, np.zeros(0, np.int64)
    if base ** len(parts) >= 1 << 63:  # too wide for one number: the columns but the last are numbered first
        known, numbers = np.unique(np.stack(parts[:-1], axis=1), axis=0, return_inverse=True)
        keys, n = _distinct([numbers.ravel(), parts[-1]], max(len(known), base))
        return [*known[keys[0]].T, keys[1]], n
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = key * base + p
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    key, out = key[first], []
    for _ in parts:
        out.insert(0, key % base)
        key = key // base
    return out, n


def _counted(docs: DataFrame, most: int, now: list | None, before: list | None) -> DataFrame:
    """(lang, size, phrase, f) summed over ``docs`` (lang, text); size 0: all words of a language."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, old = shared.value
        held: dict[bytes, list[bytes]] = defaultdict(list)
        size = 0

        def flush():
            for lang, texts in held.items():
                data = (b"\n" + b"\n".join(texts) + b"\n").translate(LOWER_BYTES)
                for words, phrases, n in phrase_counts(lang, data, most, tables, old):
                    yield _rows(lang, words, phrases, n)
                    if words == 1:
                        yield _rows(lang, 0, pa.array([b""], pa.binary()), np.array([n.sum()]))
            held.clear()

        for batch in batches:
            for lang, text in zip(text_bytes(batch.column(0)), text_bytes(batch.column(1)), strict=True):
                held[lang].append(text)
                size += len(text)
                if size > HELD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang binary, size int, phrase binary, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _rows(lang: bytes, words: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    k = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang], pa.binary()).take(pa.array(np.zeros(k, np.int32))), pa.array(np.full(k, words, np.int32)), phrases.cast(pa.binary()), pa.array(n.astype(np.int64))],
        ["lang", "size", "phrase", "f"],
    )


def _tables(frequent: DataFrame, most: int, bits: int) -> list[np.ndarray]:
    """A bit table for each phrase length below the longest: joined and packed on the executors, ``bits`` / 8 bytes per
    length reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            h = np.zeros(len(langs), np.uint64)
            for k, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
                parts = phrase_hashes(lang, phrase.split(b" "))
                x = parts[:1]
                for p in parts[1:]:
                    x = fold(x, p)
                h[k] = x[0]
            bit = h & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((bit & np.uint64(63)).astype(np.int32))], ["size", "slot", "bit"])

    marks = frequent.where(F.col("size").between(1, most - 1)).select("lang", "size", "phrase").mapInArrow(place, "size int, slot long, bit int")
    slots = marks.groupBy("size", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    width = min(BLOCK_SLOTS, bits // 64)

    def pack(key: tuple, words: pa.Table) -> pa.Table:
        block = np.zeros(width, np.int64)
        block[words["slot"].to_numpy() % width] = words["word"].to_numpy()
        return pa.table({"size": key[:1], "block": key[1:], "bits": pa.array([block.tobytes()], pa.binary())})

    blocks = slots.groupBy("size", (F.col("slot") / width).cast("long").alias("block")).applyInArrow(pack, "size int, block long, bits binary").toArrow()
    out = [np.zeros(bits // 8, np.uint8) for _ in range(1, most)]
    for size, block, held in zip(*(blocks[c].to_pylist() for c in ("size", "block", "bits")), strict=True):
        out[size - 1][block * width * 8 : (block + 1) * width * 8] = np.frombuffer(held, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = 10, most: int = 3, rate: float = 0.05, lowered: int = 2, bits: int = TABLE_BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): every word and phrase of up to ``most`` words with at least ``min_count`` occurrences, and a
    row of size 0 per language with the number of all its words. ``lang`` and ``phrase`` are UTF-8 bytes.

    A share ``rate`` of the documents, drawn by a hash of the id, proposes what occurs there ``lowered`` times; neither
    the sample nor the tables' size change the result, only the number of passes and what is counted in vain. Rules for
    nulls and odd rows: see :func:`collocations`.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(rate * 1_000_000))
    sample = drawn.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    proposed = _counted(sample, max(most - 1, 1), None, None).where((F.col("size") > 0) & (F.col("f") >= lowered))
    now, before, frequent = _tables(proposed, most, bits), None, None
    while True:
        counts = staged(_counted(rows, most, now, before).where((F.col("size") == 0) | (F.col("f") >= min_count)))
        both = counts if frequent is None else staged(frequent.unionByName(counts))
        if frequent is not None:
            unstage(frequent)
            unstage(counts)
        frequent = both
        failed = [a | b for a, b in zip(now, _tables(frequent, most, bits), strict=True)]
        if all((a == b).all() for a, b in zip(now, failed, strict=True)):
            return frequent
        now, before = failed, now


def collocations(docs: DataFrame, min_count: int = 10, most: int = 3, cover_percent: int = 50, top: int = 2000, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``most`` words by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. a, l
    and r count the occurrences of the phrase and of its two parts at the cut with the lowest score
    floor(10^6 a^2 / (l r)), ties to the shorter first part; n all words of the language. Phrases inside a longer frequent
    phrase with at least ``cover_percent`` of their occurrences are left out. Order: score, a (both falling), phrase (by
    bytes). Arithmetic is decimal, exact while a is below 10^15.

    * null text counts as empty; null lang is ``und``; empty texts and languages without words give no rows
    * repeated rows and ids, null ids: every row is counted; long texts are used whole
    * ties are broken by the phrase's bytes; an empty table gives an empty result; other columns are ignored
    """
    frequent = frequent_phrases(docs, min_count, most, rate, id_col=id_col, text_col=text_col, lang_col=lang_col)
    counts = frequent.where("size > 0").select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "f")
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS head, array_join(slice(w, k + 1, size), ' ') AS tail))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST((CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    inside = phrases.where("size > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(F.expr("array_distinct(flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' ')))))")).alias("phrase"),
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {int(cover_percent)}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = frequent.where("size = 0").groupBy("lang").agg(F.max("f").alias("n"))
    # The bare number is what Spark can bound before the exchange: a language sends ``top`` rows per task.
    first = left.withColumn("rank", place).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return first.join(totals, "lang").select(F.col("lang").cast("string").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
