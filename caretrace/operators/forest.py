"""Honest forest of treatment effects over orthogonal moments.

Treatment and outcome are first cleared of the confounders (:func:`~caretrace.operators.causal.residuals`). A node's
effect is sum(rt ry) / sum(rt^2) over its rows, so everything a split or a leaf needs are sums of rt^2, rt ry and counts.
Where the bins of all modifiers together make few cells, one pass sums moments per (tree, cell) and whole trees grow from
them on the executors; else all trees grow together, one level per pass, from moments per (tree, node, modifier, bin). What
reaches the driver are the splits and the leaves. Which rows a tree splits on and which it estimates from is a hash of the
row and the tree, so nothing is stored per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrace.functions.columns import nan_to_null
from caretrace.operators.causal import CausalSpec, residuals

#: Most cells of all modifiers together that trees grow from in one pass, and that effects are kept for in a table.
MOST_CELLS, MOST_EFFECTS = 4096, 1 << 16
#: Rows that are handled at once.
ROWS_AT_ONCE = 50_000


@dataclass(frozen=True)
class ForestSpec:
    """Trees come in bags that share a half-sample of the rows: the spread between bags is the sampling error.

    ``rows_per_tree`` bounds the expected rows of a tree, whatever the table's size. ``honest`` False lets one set of all
    rows split and estimate (no sampling, no error).
    """

    n_trees: int = 400
    depth: int = 5
    bag: int = 4
    bins: int = 32
    min_leaf: int = 10
    rows_per_tree: int = 200_000
    honest: bool = True
    seed: int = 42


@dataclass(frozen=True)
class EffectForest:
    """Heaps of tests (modifier, cut; -1: none, all go left) with the moments of the estimation rows in each leaf."""

    modifiers: tuple[str, ...]
    feature: np.ndarray  # trees x tests
    cut: np.ndarray
    a: np.ndarray  # trees x leaves: mean of rt^2
    b: np.ndarray  # mean of rt ry
    bag: int

    @property
    def depth(self) -> int:
        return int(self.a.shape[1]).bit_length() - 1

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect, standard error) per row: ratio of the trees' mean moments, error from the spread between bags."""
        trees = len(self.a)
        effect, error = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for start in range(0, len(x), 2048):
            part = x[start : start + 2048]
            leaf = np.stack([_leaf(self.feature[t], self.cut[t], part, self.depth) for t in range(trees)], axis=1)
            a, b = self.a[np.arange(trees), leaf], self.b[np.arange(trees), leaf]
            whole = a.sum(axis=1)
            theta = b.sum(axis=1) / np.where(whole > 0, whole, np.nan)
            effect[start : start + len(part)] = theta
            bags = trees // self.bag
            if bags > 1 and self.bag > 1:
                psi = ((b - theta[:, None] * a) / (whole / trees)[:, None])[:, : bags * self.bag].reshape(len(part), bags, self.bag)
                mean = psi.mean(axis=2)
                between = mean.var(axis=1)
                within = ((psi - mean[:, :, None]) ** 2).sum(axis=2).mean(axis=1) / (self.bag - 1) / self.bag
                error[start : start + len(part)] = np.sqrt(np.maximum(between - within, between / bags))
        return effect, error


def _leaf(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    """Leaf (or node of a level, from its left end) that each row comes to in one tree."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(levels):
        f = feature[at]
        at = 2 * at + 1 + ((f >= 0) & (x[rows, f] > cut[at]))
    return at - ((1 << levels) - 1)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers of 53 bits from row hashes and a salt."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z


def _under(share: float) -> np.uint64:
    """The bound that a share of the numbers of 53 bits lies under."""
    return np.uint64(ceil(share * (1 << 53)))


def _roles(h: np.ndarray, trees: int, share: float, spec: ForestSpec) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, rows that it splits on, rows it estimates from) of all trees; trees of a bag share their half of the rows."""
    everyone, half = np.arange(len(h)), _under(0.5)
    for tree in range(trees):
        if not spec.honest:
            yield tree, everyone, everyone
            continue
        if tree % spec.bag == 0:
            mine = np.flatnonzero(_mixed(h, 2 * (spec.seed * 1_000_003 + tree // spec.bag)) < half)
            own = h[mine]
        u = _mixed(own, 2 * (spec.seed * 1_000_003 + tree) + 1)
        drawn = np.flatnonzero(u < _under(share))
        splits = u[drawn] < _under(share / 2)
        yield tree, mine[drawn[splits]], mine[drawn[~splits]]


def _batch(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rt, ry, modifiers) of a batch with the columns _h, _rt, _ry, m0, m1, ..."""
    get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
    return get(0).astype(np.int64).view(np.uint64), get(1), get(2), np.stack([get(3 + k) for k in range(width)], axis=1) if width else np.zeros((batch.num_rows, 0))


def _picked(sums: Sequence[np.ndarray], nodes: int, spec: ForestSpec) -> list[tuple[int, int] | None]:
    """(modifier, edge) of the best split of each node; ``sums`` are, per modifier, (a, b, n) by node and bin."""
    best, pick = np.full(nodes, 1e-12), [None] * nodes
    for k, (a, b, n) in enumerate(sums):
        la, lb, ln = (np.cumsum(v, axis=1)[:, :-1] for v in (a, b, n))
        ta, tb, tn = (v.sum(axis=1, keepdims=True) for v in (a, b, n))
        fit = lambda q, p: np.divide(q**2, p, out=np.zeros_like(q), where=p > 1e-12)
        worth = np.where((ln >= spec.min_leaf) & (tn - ln >= spec.min_leaf), fit(lb, la) + fit(tb - lb, ta - la) - fit(tb, ta), 0.0)
        if not worth.shape[1]:
            continue
        top = worth.argmax(axis=1)
        for node in np.flatnonzero(worth[np.arange(nodes), top] > best).tolist():
            best[node], pick[node] = worth[node, top[node]], (k, int(top[node]))
    return pick


def _grow_from_cells(rows: DataFrame, edges: list[np.ndarray], share: float, spec: ForestSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, leaf moments as of :func:`_leaf_moments`) of whole trees from one pass over the rows.

    A row counts in a tree by its cell between the edges of all modifiers: tasks sum moments per (tree, role, cell), and each
    tree grows where its sums meet.
    """
    trees, width, tests, leaves = spec.n_trees, len(edges), (1 << spec.depth) - 1, 1 << spec.depth
    sizes = [len(e) + 1 for e in edges]
    cells = int(np.prod(sizes))
    places, rest = np.zeros((cells, width), np.int64), np.arange(cells)
    for k in range(width - 1, -1, -1):
        rest, places[:, k] = np.divmod(rest, sizes[k])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 3, 2 * cells))
        for batch in _together(batches):
            h, rt, ry, x = _batch(batch, width)
            cell = np.zeros(len(h), np.int64)
            for e, size, v in zip(edges, sizes, x.T, strict=True):
                cell = cell * size + np.searchsorted(e, v, side="left")
            a, b = rt**2, rt * ry
            for tree, splits, estimates in _roles(h, trees, share, spec):
                at = np.concatenate([splits, estimates])
                key = np.concatenate([cell[splits], cells + cell[estimates]])
                for k, v in enumerate((a[at], b[at], None)):
                    total[tree, k] += np.bincount(key, v, 2 * cells)
        for tree in range(trees):
            at = np.flatnonzero(total[tree, 2])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[tree][:, at].tobytes()], pa.binary())], ["tree", "at", "moments"])

    def grown(key: tuple, parts: pa.Table) -> pa.Table:
        held = np.zeros((3, 2 * cells))
        for at, sums in zip(parts["at"].to_pylist(), parts["moments"].to_pylist(), strict=True):
            held[:, np.frombuffer(at, np.int32)] += np.frombuffer(sums, float).reshape(3, -1)
        splits = np.full((tests, 2), -1, np.int64)
        node = np.zeros(cells, np.int64)
        for level in range(spec.depth):
            nodes, first = 1 << level, (1 << level) - 1
            by = lambda k, v: np.bincount((node - first) * sizes[k] + places[:, k], v, nodes * sizes[k]).reshape(nodes, sizes[k])  # noqa: B023, E731
            for n, found in enumerate(_picked([np.stack([by(k, v[:cells]) for v in held]) for k in range(width)], nodes, spec)):
                if found:
                    splits[first + n] = found
            k, edge = splits[node, 0], splits[node, 1]
            node = 2 * node + 1 + ((k >= 0) & (places[np.arange(cells), k] > edge))
        ends = np.stack([np.bincount(node - tests, v[cells:], leaves) for v in held])
        return pa.table({"tree": key[:1], "splits": pa.array([splits.tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary())})

    feature, cut, out = np.full((trees, tests), -1, np.int64), np.full((trees, tests), np.inf), np.zeros((3, trees, leaves))
    for row in rows.mapInArrow(moments, "tree int, at binary, moments binary").groupBy("tree").applyInArrow(grown, "tree int, splits binary, ends binary").collect():
        splits = np.frombuffer(row["splits"], np.int64).reshape(tests, 2)
        feature[row["tree"]], out[:, row["tree"]] = splits[:, 0], np.frombuffer(row["ends"], float).reshape(3, leaves)
        for at in np.flatnonzero(splits[:, 0] >= 0):
            cut[row["tree"], at] = edges[splits[at, 0]][splits[at, 1]]
    return feature, cut, out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about :data:`ROWS_AT_ONCE` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _grow_level(rows: DataFrame, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, level: int, share: float, spec: ForestSpec) -> list:
    """(tree, node, modifier, edge) of the splits of one level: one pass over the rows for all trees."""
    trees, nodes, width = len(feature), 1 << level, len(edges)
    sizes = [len(e) + 1 for e in edges]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cells = int(starts[-1])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 3, nodes * cells))
        for batch in batches:
            h, rt, ry, x = _batch(batch, width)
            codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) + starts[:-1]
            for tree, rows_of, _ in _roles(h, trees, share, spec):
                key = (_leaf(feature[tree], cut[tree], x[rows_of], level)[:, None] * cells + codes[rows_of]).ravel()
                for k, v in enumerate((rt[rows_of] ** 2, rt[rows_of] * ry[rows_of], np.ones(len(rows_of)))):
                    total[tree, k] += np.bincount(key, np.repeat(v, width), nodes * cells)
        for tree in range(trees):
            if total[tree, 2].any():
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([total[tree].tobytes()], pa.binary())], ["tree", "moments"])

    def choose(key: tuple, parts: pa.Table) -> pa.Table:
        held = sum((np.frombuffer(p, float) for p in parts["moments"].to_pylist()), np.zeros(3 * nodes * cells)).reshape(3, nodes, cells)
        pick = _picked([held[:, :, starts[k] : starts[k + 1]] for k in range(width)], nodes, spec)
        found = [(key[0].as_py(), node, *p) for node, p in enumerate(pick) if p]
        return pa.table({n: pa.array([f[i] for f in found], pa.int32()) for i, n in enumerate(("tree", "node", "modifier", "edge"))})

    return rows.mapInArrow(moments, "tree int, moments binary").groupBy("tree").applyInArrow(choose, "tree int, node int, modifier int, edge int").collect()


def _leaf_moments(rows: DataFrame, feature: np.ndarray, cut: np.ndarray, width: int, share: float, spec: ForestSpec) -> np.ndarray:
    """3 x trees x leaves: sums of rt^2, rt ry and counts of the estimation rows."""
    trees, leaves = len(feature), 1 << spec.depth

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 3, leaves))
        for batch in batches:
            h, rt, ry, x = _batch(batch, width)
            for tree, _, rows_of in _roles(h, trees, share, spec):
                key = _leaf(feature[tree], cut[tree], x[rows_of], spec.depth)
                for k, v in enumerate((rt[rows_of] ** 2, rt[rows_of] * ry[rows_of], np.ones(len(rows_of)))):
                    total[tree, k] += np.bincount(key, v, leaves)
        at = np.argwhere(total[:, 2] > 0)
        t, leaf = at[:, 0], at[:, 1]
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), *(pa.array(total[t, k, leaf]) for k in range(3))], ["tree", "leaf", "a", "b", "n"])

    sums = rows.mapInArrow(moments, "tree int, leaf int, a double, b double, n double").groupBy("tree", "leaf").agg(*[F.sum(c).alias(c) for c in "abn"]).toArrow()
    out = np.zeros((3, trees, leaves))
    for k, c in enumerate("abn"):
        out[k, sums["tree"].to_numpy(), sums["leaf"].to_numpy()] = sums[c].to_numpy()
    return out


def fit_forest(df: DataFrame, spec: CausalSpec, forest: ForestSpec = ForestSpec()) -> EffectForest:
    """Forest of the effect of ``spec.treatment`` on ``spec.outcome`` over the modifiers.

    Passes over the rows: the residual fits, one for the bin edges, and one, or, where the bins make more than
    :data:`MOST_CELLS` cells, one per level and one for the leaves. A leaf with fewer
    than ``min_leaf`` estimation rows takes the moments of the nearest ancestor that has them. Rows without treatment or
    outcome do not count; missing confounders and modifiers count as 0.
    """
    mods = list(spec.modifiers or spec.confounders)
    known = df.filter(nan_to_null(spec.treatment).isNotNull() & nan_to_null(spec.outcome).isNotNull())
    filled = [F.coalesce(nan_to_null(m), F.lit(0.0)).cast("double").alias(f"m{k}") for k, m in enumerate(mods)]
    rows = residuals(known, spec).select(F.xxhash64(spec.row_id).alias("_h"), F.col("_rt").cast("double"), F.col("_ry").cast("double"), *filled)
    probs = [k / forest.bins for k in range(1, forest.bins)]
    cuts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f"m{k}", probs, 10_000).alias(f"e{k}") for k in range(len(mods))]).first()
    edges = [np.unique(np.array(cuts[f"e{k}"] or [], float)) for k in range(len(mods))]
    share = min(1.0, 2.0 * forest.rows_per_tree / max(cuts["n"], 1))
    tests = (1 << forest.depth) - 1
    feature, cut = np.full((forest.n_trees, tests), -1, np.int64), np.full((forest.n_trees, tests), np.inf)
    cells = np.prod([len(e) + 1 for e in edges], dtype=float)
    if cells <= MOST_CELLS:
        feature, cut, sums = _grow_from_cells(rows, edges, share, forest)
    for level in range(forest.depth if mods and cells > MOST_CELLS else 0):
        splits = _grow_level(rows, edges, feature, cut, level, share, forest)
        feature, cut = feature.copy(), cut.copy()
        for tree, node, k, edge in splits:
            at = (1 << level) - 1 + node
            feature[tree, at], cut[tree, at] = k, edges[k][edge]
        if not splits:
            break
    a, b, n = sums if cells <= MOST_CELLS else _leaf_moments(rows, feature, cut, len(mods), share, forest)
    leaves = np.arange(1 << forest.depth)
    done = n >= forest.min_leaf
    ma, mb = np.where(done, a, 0.0), np.where(done, b, 0.0)
    count = np.where(done, n, 0.0)
    for up in range(1, forest.depth + 1):
        group = leaves >> up
        sums = [np.stack([np.bincount(group, row, len(leaves)) for row in v]) if len(v) else v for v in (a, b, n)]
        ready = ~done & ((sums[2][:, group] >= forest.min_leaf) | (up == forest.depth))
        ma, mb, count = (np.where(ready, s[:, group], v) for s, v in zip(sums, (ma, mb, count), strict=True))
        done |= ready
    count = np.maximum(count, 1.0)
    return EffectForest(tuple(mods), feature, cut, ma / count, mb / count, forest.bag if forest.honest else 1)


@dataclass(frozen=True)
class EffectTable:
    """Effects and errors by cell between all cuts of a forest: rows of a cell come to the same leaves."""

    edges: tuple[np.ndarray, ...]
    results: tuple[np.ndarray, np.ndarray]

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(x), np.int64)
        for k, e in enumerate(self.edges):
            at = at * (len(e) + 1) + np.searchsorted(e, x[:, k], side="left")
        return self.results[0][at], self.results[1][at]


def _effects_by_cell(forest: EffectForest) -> EffectTable | None:
    """The forest as a table, None where it has more than :data:`MOST_EFFECTS` cells."""
    edges = tuple(np.unique(forest.cut[forest.feature == k]) for k in range(len(forest.modifiers)))
    cells = np.prod([len(e) + 1 for e in edges], dtype=float)
    if cells > MOST_EFFECTS:
        return None
    rest, points = np.arange(int(cells)), np.zeros((int(cells), len(edges)))
    for k in range(len(edges) - 1, -1, -1):
        rest, place = np.divmod(rest, len(edges[k]) + 1)
        points[:, k] = np.append(edges[k], np.inf)[place]
    return EffectTable(edges, forest.effects(points))


def forest_effects(df: DataFrame, forest: EffectForest, *, out: str = "effect", error: str = "effect_se") -> DataFrame:
    """``df`` with each row's effect and its standard error; rows stay where they are, other columns pass as they are."""
    shared = df.sparkSession.sparkContext.broadcast(_effects_by_cell(forest) or forest)
    columns = [F.coalesce(nan_to_null(m), F.lit(0.0)).cast("double").alias(f"_ef_{k}") for k, m in enumerate(forest.modifiers)]
    staged = df.select("*", *columns)
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - width
            x = np.stack([batch.column(own + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1) if width else np.zeros((batch.num_rows, 0))
            effect, se = shared.value.effects(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(effect, from_pandas=True), pa.array(se, from_pandas=True)], names)

    names = [*df.columns, out, error]
    return staged.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(error, T.DoubleType())]))


def effect_interval(effects: DataFrame, *, effect: str = "effect", error: str = "effect_se", z: float = 1.959964) -> DataFrame:
    """Adds ``lower`` and ``upper`` of each row's effect at the normal quantile ``z``."""
    return effects.withColumns({"lower": F.col(effect) - z * F.col(error), "upper": F.col(effect) + z * F.col(error)})


def modifier_use(forest: EffectForest) -> Sequence[tuple[str, float]]:
    """(modifier, weight), most first: its share of the splits of each level, levels weighing 1, 1/4, 1/9, ..."""
    weight = np.zeros(len(forest.modifiers))
    for level in range(forest.depth):
        used = forest.feature[:, (1 << level) - 1 : (2 << level) - 1]
        if (used >= 0).any():
            weight += np.bincount(used[used >= 0], minlength=len(weight)) / (used >= 0).sum() / (level + 1) ** 2
    whole = max(float(weight.sum()), 1e-12)
    return sorted(((m, float(w) / whole) for m, w in zip(forest.modifiers, weight, strict=True)), key=lambda p: (-p[1], p[0]))
