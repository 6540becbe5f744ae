"""Substring dedup: sliding runs of several sentences and long single ones, joined over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.common import LOWER_BYTES, staged

#: A run takes at least so many sentences and words; a sentence of LONG_WORDS is a run of its own.
MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 16, 30
SENTENCE = re.compile(r"[^.!?。！？｡\n]+[.!?。！？｡]*")
#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han): two of their characters count as a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, words in lower-case A-Z, number of words) of each sentence that has a word.

    A sentence ends with a run of ``.!?``, of their full-width forms, or at a line end; offsets are code points and leave
    outer white space out.
    """
    out = []
    for m in SENTENCE.finditer(text):
        words = m[0].encode().translate(LOWER_BYTES).split()
        if words:
            lead = len(m[0]) - len(m[0].lstrip())
            more = 0 if m[0].isascii() else len(UNSPACED.findall(m[0])) // 2
            out.append((m.start() + lead, m.start() + len(m[0].rstrip()), b" ".join(words), len(words) + more))
    return out


def sentence_runs(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit digest) of the run that starts at each sentence, where there is one."""
    parts = sentences(text)
    out, end, words = [], 0, 0
    for start in range(len(parts)):
        while end < len(parts) and (end - start < min_sentences or words < min_words):
            words += parts[end][3]
            end += 1
        if end - start < min_sentences or words < min_words:
            break
        out.append((start, end, xxhash.xxh3_128_digest(b"\n".join(p[2] for p in parts[start:end]))))
        words -= parts[start][3]
    return out


def passage_runs(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit digest): the shortest run that starts and the shortest that ends at
    each sentence, and each long sentence alone.

    A passage of whole sentences with enough sentences and words is covered by runs inside it: where the run that starts
    at a sentence reaches beyond the passage, the run that ends with the passage holds that sentence.
    """
    parts = sentences(text)
    out = {(a, b): digest for a, b, digest in sentence_runs(text, min_sentences, min_words)}
    start, words = 0, 0
    for end in range(1, len(parts) + 1):
        words += parts[end - 1][3]
        while end - start > min_sentences and words - parts[start][3] >= min_words:
            words -= parts[start][3]
            start += 1
        if end - start >= min_sentences and words >= min_words and (start, end) not in out:
            out[start, end] = xxhash.xxh3_128_digest(b"\n".join(p[2] for p in parts[start:end]))
    for k, p in enumerate(parts):
        if p[3] >= long_words:
            out.setdefault((k, k + 1), xxhash.xxh3_128_digest(p[2]))
    return [(a, b, digest) for (a, b), digest in sorted(out.items())]


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, sentence_runs, first_ids) of every document with a sentence in a repeated run that is not its first.

    ``sentence_runs`` are the sentences to remove as [a, b), touching ones joined; ``first_ids`` the documents
    in which the repeated runs stand first. The first occurrence of a run is the one with the smallest (id, text, position).
    A run shared by a third of all documents is counted by a partial aggregate and joined back by a join that adaptive
    execution can split; only what one document holds is ever gathered.

    * null, empty and short texts have no runs; long texts are used whole; repeats within a document count
    * documents without an id come after all others; rows that repeat an id and a text are one occurrence
    * documents without a repeat have no row; an empty table gives an empty result; other columns are ignored
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passage_runs(t.as_py() or "", min_sentences, min_words) for t in batch.column(2)]
            offsets = pa.array(np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32))
            flat = [x for r in rows for x in r]
            halves = np.frombuffer(b"".join(x[2] for x in flat), np.int64).reshape(-1, 2)
            columns = [pa.array(np.array([x[k] for x in flat], np.int32)) for k in (0, 1)] + [pa.array(halves[:, k].copy()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], ["id", "text_key", "a", "b", "h1", "h2"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    runs = rows.mapInArrow(run, "id long, text_key long, a array<int>, b array<int>, h1 array<long>, h2 array<long>")
    runs = staged(runs.select("id", "text_key", F.explode(F.arrays_zip("a", "b", "h1", "h2")).alias("r")).select("id", "text_key", "r.*"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "a")
    # Written, not only grouped: a join of two tables that are both dealt anew can be split where one run is everywhere.
    first = staged(
        runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        .select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"), F.col("first.a").alias("first_a"))
    )
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")) & (F.col("a") == F.col("first_a"))
    again = runs.join(first, ["h1", "h2"]).where(~is_first).select("id", "text_key", "a", "b", "first_id")
    return again.groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"), F.sort_array(F.collect_set("first_id")).alias("first_ids")
    ).select(F.col("id").alias(id_col), "text_key", _merged("runs").alias("sentence_runs"), "first_ids")


def _merged(runs: str):
    """Sorted [a, b) ranges with those that touch or overlap joined."""
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return F.aggregate(
        runs,
        empty,
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1)))["b"] >= r["a"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, F.greatest(F.size(done), F.lit(1)))["a"].alias("a"), F.greatest(F.element_at(done, F.greatest(F.size(done), F.lit(1)))["b"], r["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )


def remove_spans(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the sentences of ``repeats`` (from :func:`repeated_spans`) cut out of their texts; all rows and columns kept."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    marks = repeats.select(F.col(id_col).alias("__ct_id"), F.col("text_key").alias("__ct_key"), F.col("sentence_runs").alias("__ct_runs"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(marks, F.col(id_col).cast("long").eqNullSafe(F.col("__ct_id")) & (key == F.col("__ct_key")), "left").drop("__ct_id", "__ct_key")
    return joined.mapInArrow(run, docs.schema)


def cut(text: str | None, runs: list[dict] | None) -> str | None:
    """``text`` without the sentences of ``runs``."""
    if not text or not runs:
        return text
    parts = sentences(text)
    out, at = [], 0
    for r in runs:
        out.append(text[at : parts[r["a"]][0]])
        at = parts[r["b"] - 1][1]
    return "".join([*out, text[at:]])
