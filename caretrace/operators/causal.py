"""Effect estimates of a continuous treatment, their checks, policies and scenarios.

The estimator is a cross-fitted partially linear model with an effect linear in the modifiers. Every
fit is one grouped pass of sums of products; only p x p matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace.functions.columns import guarded_ratio
from caretrace.functions.matrices import moments
from caretrace.functions.quantiles import exact_medians, exact_quantiles_of
from caretrace.functions.tables import with_stats
from caretrace.operators.model import LinearModel, filled
from caretrace.session import cut_lineage, discard


@dataclass(frozen=True)
class CausalSpec:
    treatment: str
    outcome: str
    confounders: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    folds: int = 1
    row_id: str = "row_id"


@dataclass(frozen=True)
class Effect:
    """effect(x) = theta[0] + sum theta[j] * (x_j - center_j)"""

    modifiers: tuple[str, ...]
    theta: tuple[float, ...]
    centers: tuple[float, ...]

    def column(self) -> Column:
        terms = (F.lit(b) * (filled(m) - F.lit(c)) for m, b, c in zip(self.modifiers, self.theta[1:], self.centers))
        return sum(terms, F.lit(self.theta[0]))


def _moments(df: DataFrame, cols: Sequence[Column], group: Column | None = None) -> list[tuple[np.ndarray, float]]:
    """Sums of products (and row counts) of the given columns, per group; one pass."""
    p = len(cols)
    named = df.select((group if group is not None else F.lit(0)).alias("_g"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    out = []
    for row in named.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("_g").collect():
        m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], dtype=float)
        out.append((m, float(row["n"])))
    return out


def _means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(filled(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [float(v or 0.0) for v in row]


def residuals(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """Rows with ``_rt`` and ``_ry``: treatment and outcome less their linear fit on the confounders.

    With folds > 1 a row's fit comes from the other folds; the fold is a hash of the row id.
    """
    w = list(spec.confounders)
    cols = [*w, spec.treatment, spec.outcome]
    center = _means(df, cols)
    shifted = [F.lit(1.0), *[filled(c) - F.lit(m) for c, m in zip(cols, center)]]
    fold = F.pmod(F.xxhash64(spec.row_id), F.lit(spec.folds)) if spec.folds > 1 else F.lit(0)
    q = 1 + len(w)
    parts = [m for m, _ in _moments(df, shifted, fold)] or [np.zeros((q + 2, q + 2))]
    total = sum(parts)
    rt = ry = None
    for k, part in enumerate(parts):
        gram = total - part if spec.folds > 1 else total
        bt = np.linalg.lstsq(gram[:q, :q], gram[:q, q], rcond=None)[0]
        by = np.linalg.lstsq(gram[:q, :q], gram[:q, q + 1], rcond=None)[0]
        fit_t = sum((F.lit(float(b)) * x for b, x in zip(bt, shifted)), F.lit(0.0))
        fit_y = sum((F.lit(float(b)) * x for b, x in zip(by, shifted)), F.lit(0.0))
        et, ey = shifted[q] - fit_t, shifted[q + 1] - fit_y
        rt = et if rt is None else F.when(fold == k, et).otherwise(rt)
        ry = ey if ry is None else F.when(fold == k, ey).otherwise(ry)
    return df.withColumn("_rt", rt).withColumn("_ry", ry)


def fit_effect(df: DataFrame, spec: CausalSpec) -> Effect:
    mods = list(spec.modifiers or spec.confounders)
    centers = _means(df, mods) if mods else []
    z = [F.col("_rt"), *[F.col("_rt") * (filled(m) - F.lit(c)) for m, c in zip(mods, centers)]]
    gram, _ = _moments(residuals(df, spec), [*z, F.col("_ry")])[0]
    q = len(z)
    theta = np.linalg.lstsq(gram[:q, :q], gram[:q, q], rcond=None)[0]
    return Effect(tuple(mods), tuple(map(float, theta)), tuple(centers))


def dml_effects(df: DataFrame, spec: CausalSpec, *, out: str = "effect") -> DataFrame:
    return df.withColumn(out, fit_effect(df, spec).column())


def effect_summary(effects: DataFrame, *, effect: str = "effect") -> DataFrame:
    """ate, std, p50, p75, p90 of the effect column."""
    from caretrace.operators.model import basic_summary

    return basic_summary(effects, effect).withColumnRenamed("mean", "ate")


def balance_smd(df: DataFrame, *, treatment: str, confounders: Sequence[str]) -> DataFrame:
    """(confounder, smd): standardised mean difference across the median split of the treatment."""
    cut = with_stats(df, exact_medians(df, {"m": filled(treatment)}), "_t")
    high = filled(treatment) > F.col("_t.m")
    aggs = []
    for i, c in enumerate(confounders):
        for side, cond in (("a", high), ("b", ~high)):
            v = F.when(cond, filled(c))
            aggs += [F.avg(v).alias(f"m{side}{i}"), F.var_pop(v).alias(f"v{side}{i}")]
    row = cut.agg(*aggs)
    smd = lambda i: F.coalesce(
        guarded_ratio(F.col(f"ma{i}") - F.col(f"mb{i}"), F.sqrt(F.lit(0.5) * (F.col(f"va{i}") + F.col(f"vb{i}")))), F.lit(0.0)
    )
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("confounder"), smd(i).alias("smd")) for i, c in enumerate(confounders)])))


def placebo_effect(df: DataFrame, spec: CausalSpec, *, baseline: str) -> DataFrame:
    """Mean effect on the baseline value, which the treatment cannot have changed."""
    eff = fit_effect(df, CausalSpec(spec.treatment, baseline, spec.confounders, spec.modifiers, spec.folds, spec.row_id))
    return df.agg(F.avg(eff.column()).alias("placebo_ate"))


# Cumulative Poisson(1) probabilities of 0..6.
POISSON_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def _uniform(*keys: Column) -> Column:
    """Repeatable uniform in [0, 1) from a hash; does not depend on partitions or retries."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _poisson(h: np.ndarray, first: int, n: int, seed: int) -> np.ndarray:
    """rows x n Poisson(1) weights from row hashes, for replicates ``first`` and on."""
    salt = (np.arange(first, first + n, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    z = h[:, None] + salt[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(np.array(POISSON_CUTS), u, side="right").astype(float)


def bootstrap_ates(df: DataFrame, spec: CausalSpec, *, n: int, seed: int = 42) -> np.ndarray:
    """Mean effect of each of ``n`` Poisson-weighted replicates.

    A row's weights in all replicates are one vector, drawn from its hash where the row is; a task's sums of products of
    all replicates are one matrix product, so no row is ever copied. What is added up per replicate are q^2 numbers.
    """
    mods = list(spec.modifiers or spec.confounders)
    centers = _means(df, mods) if mods else []
    shift = [filled(m) - F.lit(c) for m, c in zip(mods, centers)]
    q = 1 + len(mods)
    rows = residuals(df, spec).select(F.xxhash64(spec.row_id, spec.treatment, spec.outcome).alias("h"), F.col("_rt").cast("double"), F.col("_ry").cast("double"), *[d.cast("double").alias(f"d{i}") for i, d in enumerate(shift)])
    width = (q + 1) * (q + 2) // 2 + q

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for batch in batches:
            get = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            h, rt, ry, d = get[0].astype(np.int64).view(np.uint64), get[1], get[2], get[3:]
            z = [rt, *(rt * x for x in d), ry]
            products = np.stack([z[i] * z[j] for i in range(q + 1) for j in range(i, q + 1)] + [np.ones(len(h)), *d], axis=1)
            for start in range(0, len(h), 2048):
                for rep in range(0, n, 256):
                    w = _poisson(h[start : start + 2048], rep, min(256, n - rep), seed)
                    total[rep : rep + w.shape[1]] += w.T @ products[start : start + 2048]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(width))], ["rep", *(f"s{k}" for k in range(width))])

    kind = "rep int, " + ", ".join(f"s{k} double" for k in range(width))
    added = rows.mapInArrow(sums, kind).groupBy("rep").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).orderBy("rep").toPandas()
    ates = []
    upper = np.triu_indices(q + 1)
    for s in added[[f"s{k}" for k in range(width)]].to_numpy():
        if s[len(upper[0])] <= 0:
            continue
        gram = np.zeros((q + 1, q + 1))
        gram[upper] = s[: len(upper[0])]
        gram = gram + gram.T - np.diag(np.diag(gram))
        theta = np.linalg.lstsq(gram[:q, :q], gram[:q, q], rcond=None)[0]
        ates.append(float(theta[0] + theta[1:] @ s[len(upper[0]) + 1 :] / s[len(upper[0])]))
    return np.array(ates)


def bootstrap_ci(df: DataFrame, spec: CausalSpec, *, n: int, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(lower, upper, n_boot): percentile interval of the mean effect over Poisson-weighted replicates, all refitted from one
    pass. The replicates depend on the rows only, not on their order or partitions."""
    if n < 10:
        raise ValueError("at least 10 replicates")
    ates = bootstrap_ates(df, spec, n=n, seed=seed)
    bounds = tuple(float(v) for v in np.percentile(ates, [100 * alpha / 2, 100 * (1 - alpha / 2)])) if len(ates) >= 10 else (None, None)
    return df.sparkSession.createDataFrame([(bounds[0], bounds[1], len(ates))], "lower double, upper double, n_boot long")


def e_value_columns(effect: Column, sd: Column) -> tuple[Column, Column]:
    """(rr_equivalent, e_value); NULL when the outcome does not vary."""
    raw = F.exp(F.lit(0.91) * effect / sd)
    rr = F.when(sd > 0, F.when(raw >= 1.0, raw).otherwise(F.lit(1.0) / F.greatest(raw, F.lit(1e-9))))
    return rr, rr + F.sqrt(rr * (rr - 1.0))


def e_value(summary: DataFrame, *, ate: str = "ate", sd: str = "sd_y", lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Adds the E-value and, given an interval, that of the bound nearer to 0."""
    rr, e = e_value_columns(F.col(ate), F.col(sd))
    out = summary.withColumn("rr_equivalent", rr).withColumn("e_value", e)
    if lower and upper:
        bound = F.when(F.abs(F.col(lower)) < F.abs(F.col(upper)), F.col(lower)).otherwise(F.col(upper))
        rr_b, e_b = e_value_columns(bound, F.col(sd))
        out = out.withColumn("rr_equivalent_ci_bound", rr_b).withColumn("e_value_ci_bound", e_b)
    return out


def effect_drivers(df: DataFrame, effect: Effect, *, top: int | None = 10) -> DataFrame:
    """(feature, mean_abs): modifiers by mean absolute contribution to the effect."""
    parts = [F.avg(F.abs(F.lit(b) * (filled(m) - F.lit(c)))).alias(f"a{i}") for i, (m, b, c) in enumerate(zip(effect.modifiers, effect.theta[1:], effect.centers))]
    row = df.agg(*parts)
    pairs = F.array(*[F.struct(F.lit(m).alias("feature"), F.col(f"a{i}").alias("mean_abs")) for i, m in enumerate(effect.modifiers)])
    ranked = row.select(F.inline(pairs)).orderBy(F.col("mean_abs").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


# --- policies --------------------------------------------------------------------------------


def policy_labels(effects: DataFrame, *, treatment: str, effect: str = "effect", low_q: float = 0.25, high_q: float = 0.75, threshold: float = 0.0) -> DataFrame:
    """Rows with the two treatment levels, the benefit of moving between them and the label."""
    q = exact_quantiles_of(effects, [("low", treatment, low_q), ("high", treatment, high_q)])
    out = with_stats(effects, q, "_q").withColumn("treatment_low", F.col("_q.low")).withColumn("treatment_high", F.col("_q.high")).drop("_q")
    return out.withColumn("benefit", F.col(effect) * (F.col("treatment_high") - F.col("treatment_low"))).withColumn(
        "policy_label", (F.col("benefit") > F.lit(float(threshold))).cast("int")
    )


def learn_policy(labelled: DataFrame, *, features: Sequence[str], depth: int = 3, min_leaf: int = 50):
    """(rows with ``policy_recommend_high``, rule text): a shallow decision tree over the labels."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.withColumns({f"_f_{f}": filled(f) for f in features})
    rows = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x").transform(rows)
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="policy_label", maxDepth=depth, minInstancesPerNode=min_leaf, seed=42)
    model = tree.fit(rows)
    rule = model.toDebugString
    for i, f in enumerate(features):
        rule = rule.replace(f"feature {i} ", f"{f} ")
    decided = model.transform(rows).withColumn("policy_recommend_high", F.col("prediction").cast("int"))
    return decided.drop("_x", "rawPrediction", "probability", "prediction", *[f"_f_{f}" for f in features]), rule


def policy_value(decided: DataFrame, *, decision: str = "policy_recommend_high") -> DataFrame:
    return decided.agg(F.avg(F.col(decision).cast("double")).alias("recommended_rate"), F.avg(F.col("benefit") * F.col(decision)).alias("mean_gain"))


def policy_robustness(decided: DataFrame, *, decision: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """E-value of the mean gain and the adjusted effect of the decision on the outcome."""
    from caretrace.operators.model import fit_linear

    model = fit_linear(decided, [decision, *confounders], outcome)
    row = decided.agg(F.avg(F.col("benefit") * F.col(decision)).alias("mean_gain"), F.stddev_pop(outcome).alias("sd_y"))
    return e_value(row, ate="mean_gain").withColumn("policy_ate", F.lit(model.coefs[0]))


def mean_effect(df: DataFrame, spec: CausalSpec) -> float:
    """Mean of the fitted effect over all rows."""
    return df.agg(F.avg(fit_effect(df, spec).column())).first()[0]


def refute_effect(df: DataFrame, spec: CausalSpec, *, method: str, seed: int = 7, fraction: float = 0.8, bucket_rows: int = 4096, base: float | None = None) -> DataFrame:
    """(method, baseline_ate, refuted_ate) under a random common cause, a permuted treatment or a subset."""
    base = mean_effect(df, spec) if base is None else base
    noise = _uniform(F.col(spec.row_id), F.lit(seed))
    used = spec
    if method == "random_common_cause":
        changed = df.withColumn("_noise", noise)
        used = CausalSpec(spec.treatment, spec.outcome, (*spec.confounders, "_noise"), spec.modifiers or spec.confounders, spec.folds, spec.row_id)
    elif method == "data_subset":
        changed = df.filter(noise < fraction)
    elif method == "placebo_treatment":
        # Two orders of the same hash bucket, joined by position: a permutation without a global sort. Buckets hold
        # about bucket_rows rows, whatever the size of the table.
        buckets = max(1, -(-df.count() // bucket_rows))
        read = dict.fromkeys([spec.row_id, spec.treatment, spec.outcome, *spec.confounders, *spec.modifiers])
        keyed = df.select(*[c for c in read if c in df.columns]).withColumn("_b", F.pmod(F.xxhash64(spec.row_id, F.lit(seed)), F.lit(buckets)))
        by = lambda salt: Window.partitionBy("_b").orderBy(F.xxhash64(spec.row_id, F.lit(seed + salt)), spec.row_id, *[F.col(c) for c in (spec.treatment, spec.outcome)])
        left = keyed.withColumn("_pos", F.row_number().over(by(1))).drop(spec.treatment)
        right = keyed.select("_b", F.row_number().over(by(2)).alias("_pos"), F.col(spec.treatment))
        # The fit passes over the rows several times: they are dealt out once and written.
        changed = cut_lineage(left.join(right, ["_b", "_pos"]).drop("_b", "_pos"))
    else:
        raise ValueError(f"unknown refuter {method}")
    after = mean_effect(changed, used)
    if method == "placebo_treatment":
        discard(changed)
    return df.sparkSession.createDataFrame([(method, float(base), float(after))], "method string, baseline_ate double, refuted_ate double")


# --- graphs ----------------------------------------------------------------------------------


def dag_sanity(confounders: DataFrame, edges: DataFrame) -> DataFrame:
    """(spec_id, confounder) pairs without an edge into the treatment or the outcome.

    ``confounders`` is (spec_id, confounder, treatment, outcome), ``edges`` (spec_id, src, dst).
    """
    ends = confounders.select("spec_id", F.explode(F.array("treatment", "outcome")).alias("dst")).distinct()
    linked = edges.join(ends, ["spec_id", "dst"], "left_semi").select("spec_id", F.col("src").alias("confounder")).distinct()
    return confounders.select("spec_id", "confounder").join(linked, ["spec_id", "confounder"], "left_anti")


def _correlation_matrix(df: DataFrame, variables: Sequence[str]) -> tuple[int, np.ndarray]:
    n, _, cov = moments(df, variables)
    sd = np.sqrt(np.diag(cov))
    both = np.outer(sd, sd)
    corr = np.divide(cov, both, out=np.zeros_like(cov), where=both > 0)
    np.fill_diagonal(corr, 1.0)
    return n, corr


def correlations(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(n, a, b, r) for every pair of variables from one pass over the rows without a missing value; constant variables
    correlate 0. What comes to the driver is the matrix, not the rows."""
    variables = list(variables)
    n, corr = _correlation_matrix(df, variables)
    rows = [(n, variables[i], variables[j], float(corr[i, j])) for i, j in combinations(range(len(variables)), 2)]
    return df.sparkSession.createDataFrame(rows, "n long, a string, b string, r double")


def fisher_p(r: float, n: int, k: int = 0) -> float:
    r = max(min(r, 0.999999), -0.999999)
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - k - 3, 1))
    return min(max(math.erfc(abs(z) / math.sqrt(2.0)), 0.0), 1.0)


def _partial(corr: np.ndarray, a: int, b: int, sets: np.ndarray) -> np.ndarray:
    """Partial correlations of a and b given each row of ``sets``: from the inverse of each small matrix."""
    idx = np.concatenate([np.broadcast_to([a, b], (len(sets), 2)), sets], axis=1)
    inverse = np.linalg.pinv(corr[idx[:, :, None], idx[:, None, :]], hermitian=True)
    scale = inverse[:, 0, 0] * inverse[:, 1, 1]
    return np.divide(-inverse[:, 0, 1], np.sqrt(np.maximum(scale, 0.0)), out=np.zeros(len(sets)), where=scale > 0)


def _separations(df: DataFrame, corr: np.ndarray, n: int, near: np.ndarray, size: int, alpha: float) -> dict[tuple[int, int], tuple[int, ...]]:
    """Edges that some set of ``size`` neighbours separates, each with the set of the smallest partial correlation.

    The edges of a level are a table and are tested on executors; neighbourhoods are those at the start of the level, so
    no edge's fate depends on when another one was looked at.
    """
    spark = df.sparkSession
    edges = [(int(a), int(b)) for a, b in np.argwhere(np.triu(near))]
    if not edges:
        return {}
    held = spark.sparkContext.broadcast((corr, near))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corr, near = held.value
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                sides = ([v for v in np.flatnonzero(near[x]) if v != y] for x, y in ((a, b), (b, a)))
                sets = sorted({s for side in sides for s in combinations([int(v) for v in side], size)})
                best = None
                for start in range(0, len(sets), 4096):
                    part = sets[start : start + 4096]
                    r = np.abs(_partial(corr, a, b, np.array(part, np.int64).reshape(len(part), size)))
                    k = int(r.argmin())
                    if best is None or r[k] < best[0]:
                        best = (float(r[k]), part[k])
                if best and (n < max(10, 3 + size) or fisher_p(best[0], n, size) > alpha):
                    out.append((a, b, list(best[1])))
            yield pd.DataFrame(out, columns=["a", "b", "given"])

    table = spark.createDataFrame(edges, "a int, b int").repartition(min(len(edges), 64))
    return {(r["a"], r["b"]): tuple(r["given"]) for r in table.mapInPandas(test, "a int, b int, given array<int>").collect()}


def discover_dag(df: DataFrame, variables: Sequence[str], *, alpha: float = 0.05, max_cond: int = 2, forbid: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(src, dst, directed) edges: skeleton by partial correlations, v-structures, two orientation rules.

    One pass over the rows makes the correlation matrix. Edges are tested level by level (size of the set), removals of a
    level take effect together, and orientations of a round too; an edge that is forced both ways stays undirected. So the
    result does not depend on the order or the names of the variables.
    """
    variables = list(variables)
    if len(variables) < 3:
        raise ValueError("at least 3 variables")
    n, corr = _correlation_matrix(df, variables)
    at = {v: i for i, v in enumerate(variables)}
    near = ~np.eye(len(variables), dtype=bool)
    separated: dict[frozenset, set] = {}
    for a, b in forbid:
        if a in at and b in at:
            near[at[a], at[b]] = near[at[b], at[a]] = False
            separated[frozenset((at[a], at[b]))] = set()
    for size in range(max_cond + 1):
        for (a, b), given in _separations(df, corr, n, near, size, alpha).items():
            near[a, b] = near[b, a] = False
            separated[frozenset((a, b))] = set(given)
    wanted = np.zeros_like(near)
    for c in range(len(variables)):
        for a, b in combinations(np.flatnonzero(near[c]).tolist(), 2):
            if not near[a, b] and c not in separated.get(frozenset((a, b)), set()):
                wanted[a, c] = wanted[b, c] = True
    arrow = wanted & ~wanted.T
    loose = near & ~arrow & ~arrow.T
    while True:
        # x -> y where a -> x, x - y and a, y are not joined; where x -> c -> y and x - y
        forced = np.zeros_like(near)
        for x, y in np.argwhere(loose):
            sources = np.flatnonzero(arrow[:, x])
            forced[x, y] = any(not near[a, y] and a != y for a in sources) or bool((arrow[x] & arrow[:, y]).any())
        new = forced & ~forced.T
        if not new.any():
            break
        arrow |= new
        loose &= ~(new | new.T)
    name = lambda i: variables[int(i)]
    out = sorted((name(a), name(b), True) for a, b in np.argwhere(arrow))
    out += sorted((*sorted((name(a), name(b))), False) for a, b in np.argwhere(np.triu(loose)))
    return df.sparkSession.createDataFrame(out, "src string, dst string, directed boolean")


# --- scenarios -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    name: str
    set_values: tuple[tuple[str, float], ...] = ()
    delta_values: tuple[tuple[str, float], ...] = ()

    def value(self, column: str) -> Column:
        out = filled(column)
        for c, d in self.delta_values:
            out = out + F.lit(float(d)) if c == column else out
        for c, v in self.set_values:
            out = F.lit(float(v)) if c == column else out
        return out


def what_if(df: DataFrame, *, treatment: str, effect: Effect, model: LinearModel, q_hat: float, scenarios: Sequence[Scenario]) -> DataFrame:
    """(scenario, ate_delta, base and counterfactual prediction means, interval): one pass, no row copies."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.avg(model.predict()).alias("y_base")]
    for i, s in enumerate(scenarios):
        aggs.append(F.avg(effect.column() * (s.value(treatment) - filled(treatment))).alias(f"e{i}"))
        aggs.append(F.avg(model.predict({f: s.value(f) for f in model.features})).alias(f"p{i}"))
    row = df.agg(*aggs)
    items = [
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.col(f"e{i}").alias("ate_delta_outcome"),
            F.col(f"p{i}").alias("y_pred_cf_mean"),
            (F.col(f"p{i}") - q_hat).alias("lower"),
            (F.col(f"p{i}") + q_hat).alias("upper"),
        )
        for i, s in enumerate(scenarios)
    ]
    return row.select("n_rows", F.col("y_base").alias("y_pred_base_mean"), F.inline(F.array(*items)))
