"""Quality classifier: a generalised additive model with pairwise interactions over plain text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows the model is fitted on at most, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "letters", "upper_of_letters", "digits", "spaces", "punctuation",
    "symbols", "not_ascii", "byte_entropy", "distinct_words", "top_word", "adjacent_repeats", "short_words", "ended_words",
    "words_without_letters", "mixed_words", "line_words", "distinct_lines", "sentence_ends", "mean_sentence",
)
MAIN_BINS, PAIR_BINS = 64, 16
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, LEAVES, RIDGE = 0.1, 3, 1.0

_BYTE = np.arange(256)
_IS_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_IS_LETTER = _IS_UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_IS_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_IS_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_IS_PUNCTUATION = np.isin(_BYTE, [ord(c) for c in ".,;:!?'\"()-"])
_IS_SYMBOL = (_BYTE > 32) & (_BYTE < 127) & ~_IS_LETTER & ~_IS_DIGIT & ~_IS_PUNCTUATION
_CONTINUED = (_BYTE >= 128) & (_BYTE < 192)
_LETTERS = bytes(b for b in range(256) if _IS_LETTER[b])
_NOT_LETTERS = bytes(b for b in range(256) if not _IS_LETTER[b])


def text_features(text: str | None) -> list[float]:
    """The FEATURES of one whole text; an empty text gives zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(FEATURES) - 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, chars = len(data), max(1, len(data) - int(hist[_CONTINUED].sum()))
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    k = len(words)
    counts = Counter(words)
    share = hist[hist > 0] / n
    letters = int(hist[_IS_LETTER].sum())
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(w[-1] in b".,;:!?" for w in words)
    bare = [len(w.translate(None, _NOT_LETTERS)) for w in words]
    lines = data.split(b"\n")
    ends = int(hist[[46, 33, 63]].sum())
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(lengths.mean()), float(lengths.std()), letters / n,
        float(hist[_IS_UPPER].sum()) / max(1, letters), float(hist[_IS_DIGIT].sum()) / n, float(hist[_IS_SPACE].sum()) / n,
        float(hist[_IS_PUNCTUATION].sum()) / n, float(hist[_IS_SYMBOL].sum()) / n, float(hist[_BYTE >= 128].sum()) / n,
        float(-(share * np.log2(share)).sum()), len(counts) / k, max(counts.values()) / k, repeats / k,
        float((lengths <= 3).sum()) / k, ended / k, sum(b == 0 for b in bare) / k,
        sum(0 < b < len(w.rstrip(b".,;:!?")) for b, w in zip(bare, words, strict=True)) / k, k / len(lines), len(set(lines)) / len(lines), ends / chars, k / (ends + 1),
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of one table entry per feature + one per feature pair)."""

    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, cut in enumerate(self.cuts):
            total += self.tables[j][np.searchsorted(cut, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(cut, x[:, j], side="right") for j, cut in enumerate(self.pair_cuts)]
            for t, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
                total += t[coarse[a], coarse[b]]
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Value per bin of a tree with at most ``leaves`` leaves, grown best-first on the bins' gradient sums."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for span in spans:
            lo, hi = span
            if hi - lo < 2:
                continue
            mid = np.arange(lo + 1, hi)
            won = _gain(cg[mid] - cg[lo], ch[mid] - ch[lo]) + _gain(cg[hi] - cg[mid], ch[hi] - ch[mid]) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
            at = int(np.argmax(won))
            if won[at] > best[0]:
                best = (won[at], span, int(mid[at]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + RIDGE)
    return out


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value per cell) of the best four-quadrant tree on a two-way table of gradient sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (top_g - a, top_h - b), (left_g - a, left_h - b), (tg - top_g - left_g + a, th - top_h - left_h + b)]
    gains = sum(_gain(q, w) for q, w in quads) - _gain(tg, th)
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [float(q[r, c] / (w[r, c] + RIDGE)) for q, w in quads]
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = values
    return float(gains[r, c]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: in each round every feature adds one shallow tree to its table, then the strongest pairs do.

    Without rows, or with one label only, the model is a constant: the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    m = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(base, [np.zeros(0)] * m, np.zeros((m, 1)))
    cuts = [_cut_points(x[:, j], MAIN_BINS) for j in range(m)]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = np.zeros((m, MAIN_BINS + 1))
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(m):
            p = _sigmoid(total)
            width = len(cuts[j]) + 1
            step = RATE * shallow_tree(np.bincount(bins[j], y - p, width), np.bincount(bins[j], p * (1 - p), width))
            tables[j, :width] += step
            total += step[bins[j]]
    pair_cuts = [_cut_points(x[:, j], PAIR_BINS) for j in range(m)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]
    side = PAIR_BINS + 1

    def two_way(a: int, b: int) -> tuple[float, np.ndarray]:
        p = _sigmoid(total)
        cell = coarse[a] * side + coarse[b]
        g, h = (np.bincount(cell, w, side * side).reshape(side, side) for w in (y - p, p * (1 - p)))
        return shallow_pair_tree(g, h)

    ranked = sorted(((two_way(a, b)[0], a, b) for a, b in combinations(range(m), 2)), key=lambda t: (-t[0], t[1:]))
    pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    pair_tables = np.zeros((len(pairs), side, side))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * two_way(a, b)[1]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return AdditiveModel(base, cuts, tables, pair_cuts, pairs, pair_tables)


def held_out(id_col: str) -> Column:
    """crc32(id as text) mod 5 is 0; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [text_features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled documents that are not held out, those with the smallest hash of their id.

    Only ids and labels choose and label the rows; what the model sees are statistics of the whole texts. An id with several
    labels counts as 1 where at least half are; of documents that repeat an id, the smallest feature row is used.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("_label_id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.join(F.broadcast(picked), F.col("id") == F.col("_label_id"), "left_semi")  # at most sample_rows ids
    features = chosen.mapInArrow(_feature_rows, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    found = features.join(F.broadcast(picked), F.col("id") == F.col("_label_id")).select("id", "x", "y").toPandas().sort_values("id")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; one pass, no shuffle. Null and empty texts are scored as a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(1)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns kept, rows scored where they stand."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            x = np.array([text_features(t.as_py()) for t in texts], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
