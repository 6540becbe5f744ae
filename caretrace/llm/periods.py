"""Periodic runs of words: seeds on diagonals, extended both ways.

A run with period q and at least ``exponent`` periods repeats itself at lag q over at least (exponent - 1) q words. For the
lags of an octave [2^j, 2^(j+1)) the least guaranteed overlap is a gram of (exponent - 1) 2^j words, longer than the lag.
Grams of that length are indexed; as they are longer than the period, the next occurrence of a gram inside a run lies
exactly one period on. So the pairs of neighbouring occurrences hold a seed of every run, and a table of the furthest
covered word of each lag keeps a run from being extended again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.llm.tokens import BLANK, chunks, words_and_gaps

MIN_LENGTH, EXPONENT = 6, 4


def _grouped(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key occurs again, their dense ranks, and the lag to the key's next occurrence (0: none); by position."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)]) if len(key) else []
    lag = np.zeros(len(key), np.int64)
    lag[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
    return at[again], rank[again], lag[again]


def _longer(at: np.ndarray, rank: np.ndarray, shift: int, other_at: np.ndarray, other_rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams at ``at`` joined with the grams ``shift`` words on: those that occur again, as in :func:`_grouped`."""
    there = np.full(n + shift + 1, -1, np.int64)
    there[other_at] = other_rank
    right = there[at + shift]
    both = right >= 0
    at, rank, right = at[both], rank[both], right[both]
    return _grouped(rank * (int(right.max(initial=0)) + 1) + right, at)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, step, most = 0, 64, min(len(a), len(b))
    while n < most:
        differ = a[n : min(n + step, most)] != b[n : min(n + step, most)]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + step, step * 2
    return most


def runs_of(words: np.ndarray, docs: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by start, then period.

    ``words`` are word numbers of several texts one after the other, ``docs`` the number of the text of each; runs stay
    within a text.
    """
    n = len(words)
    if n < min_length:
        return []
    wall = np.flatnonzero(docs[1:] != docs[:-1]) + 1
    # one wall word between texts, different from every other word
    seq = np.insert(words.astype(np.int64), wall, int(words.max(initial=0)) + 1 + np.arange(len(wall)))
    doc = np.insert(docs.astype(np.int64), wall, -1 - np.arange(len(wall)))
    total = len(seq)
    place = np.arange(total)
    # the grams of ``low_size`` words that occur again
    low_size, at, rank = 1, place, seq
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}
    back = seq[::-1]
    octave = 0
    while len(at):
        need = _overlap(octave, min_length, exponent)
        while low_size * 2 <= need:
            at, rank, _ = _longer(at, rank, low_size, at, rank, total)
            low_size *= 2
        here, _, lag = _longer(at, rank, need - low_size, at, rank, total)
        seed = (lag >= 1 << octave) & (lag < 2 << octave)
        seed &= doc[here + lag] == doc[here]
        for i, q in zip(here[seed].tolist(), lag[seed].tolist(), strict=True):
            if covered.get(q, -1) > i:
                continue
            right = _equal(seq[i:], seq[i + q :])
            left = _equal(back[total - i :], back[total - i - q :])
            covered[q] = i + right
            if left + right + q >= max(min_length, exponent * q):
                found.append((i - left, left + right + q, q))
        octave += 1
    # walls before a place: back to the numbering of ``words``
    walls = np.concatenate([[0], np.cumsum(doc < 0)])
    return sorted((s - int(walls[s]), length, q) for s, length, q in found)


def _overlap(octave: int, min_length: int, exponent: int) -> int:
    """Least number of words that a run of this or a later octave has in common with itself one period on."""
    least = []
    while True:
        turn = min(max(1 << octave, min_length // exponent), (2 << octave) - 1)  # up to here min_length counts, then the periods
        least += [max(min_length, exponent * q) - q for q in {1 << octave, turn, min(turn + 1, (2 << octave) - 1)}]
        if exponent << octave >= min_length:
            return min(least)
        octave += 1


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    exponent: int = EXPONENT,
    rewrite: Callable[[object, int], np.ndarray | None] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period; in words, from 0), collapsed.

    A run is a maximal stretch of consecutive words with smallest period q, at least ``min_length`` words and
    ``exponent`` periods long; ``collapsed`` are the words that no run contains after its first q words, joined by one
    space; ``exponent`` is 3 or more. Words are separated by the six ASCII white-space characters and compared as they are. ``rewrite`` may give,
    for an id and a number of words, the word that stands at each place instead (as old word numbers).

    Documents never leave their row: no shuffle, memory is bounded by a chunk of some megabytes or the longest text.

    * null text counts as empty: no runs, collapsed empty; blank and short texts alike
    * repeated rows and ids, null ids: each row is answered by itself; other columns are ignored, whatever their names
    * an empty table gives an empty result; long texts are used whole
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 1):
            data = b" " + b" ".join(texts) + b" "
            number, distinct, _, _, starts = words_and_gaps(data, BLANK)
            sizes = np.array([len(t) + 1 for t in texts])
            doc = np.searchsorted(np.cumsum(sizes), starts - 1, side="right")
            n_words = np.bincount(doc, minlength=len(texts))
            base = np.concatenate([[0], np.cumsum(n_words)])
            if rewrite:
                for k, i in enumerate(batch.column(0).to_pylist()):
                    order = rewrite(i, int(n_words[k]))
                    if order is not None:
                        number[base[k] : base[k + 1]] = number[base[k] : base[k + 1]][order]
            found = runs_of(number, doc, min_length, exponent)
            drop = np.zeros(len(number) + 1, np.int64)
            each: list[list[dict]] = [[] for _ in texts]
            for s, length, q in found:
                drop[s + q] += 1
                drop[s + length] -= 1
                k = int(doc[s])
                each[k].append({"start": s - int(base[k]), "length": length, "period": q})
            kept = np.cumsum(drop[:-1]) == 0
            left = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(texts)))]).astype(np.int32)),
                distinct.cast(pa.binary()).take(pa.array(number[kept])),
            )
            collapsed = pa.compute.binary_join(left, pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(each, RUNS), collapsed.cast(pa.string())], ["id", "n_words", "runs", "collapsed"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
