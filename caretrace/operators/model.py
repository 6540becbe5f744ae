"""Outcome model jobs: training, metrics, calibration, attribution, evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import compact, is_blank, nan_to_null, string_array, tag_if
from caretrace.functions.quantiles import exact_medians, exact_quantiles_of
from caretrace.functions.tables import settled, with_stats

NO_TEXT = "array<string>"


# --- linear model ----------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefs: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]

    def predict(self, replace: dict[str, Column] | None = None) -> Column:
        """Prediction; ``replace`` swaps columns for other expressions."""
        replace = replace or {}
        terms = (F.lit(b) * replace.get(f, filled(f)) for f, b in zip(self.features, self.coefs))
        return sum(terms, F.lit(self.intercept))

    def attribution(self) -> dict[str, Column]:
        """Interventional attribution of a linear model: beta * (x - background mean)."""
        return {f: F.lit(b) * (filled(f) - F.lit(m)) for f, b, m in zip(self.features, self.coefs, self.means)}


def filled(c: str) -> Column:
    """Missing values enter a model as 0."""
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def fit_linear(df: DataFrame, features: Sequence[str], target: str, *, weight: Column | None = None) -> LinearModel:
    """Least squares from one pass of means and covariances; only a p x p matrix reaches the driver."""
    features = list(features)
    x = df.select(*[filled(f).alias(f) for f in features], nan_to_null(target).alias("_y")).filter(F.col("_y").isNotNull())
    cols = [*features, "_y"]
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    row = x.agg(*aggs).first()
    p = len(features)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p + 1)] for i in range(p + 1)], dtype=float)
    means = [row[f"m{i}"] or 0.0 for i in range(p + 1)]
    beta = np.linalg.lstsq(cov[:p, :p], cov[:p, p], rcond=None)[0]
    return LinearModel(tuple(features), tuple(map(float, beta)), float(means[p] - beta @ np.array(means[:p])), tuple(map(float, means[:p])))


# --- tree model ------------------------------------------------------------------------------


def is_training_row(row_id: str) -> Column:
    """Stable 80/20 split by hash: independent of partitioning and of retries."""
    return F.pmod(F.xxhash64(row_id), F.lit(10)) < 8


def train_outcome_model(
    df: DataFrame,
    *,
    features: Sequence[str],
    target: str,
    row_id: str,
    n_trees: int = 600,
    learning_rate: float = 0.03,
    depth: int = 5,
    subsample: float = 0.9,
    seed: int = 42,
):
    """(fitted model, hold-out rows with ``prediction``). Absent feature columns count as 0."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    have = set(df.columns)
    cols = [filled(f).alias(f) if f in have else F.lit(0.0).alias(f) for f in features]
    rows = df.select(F.col(row_id), *cols, nan_to_null(target).alias(target)).filter(F.col(target).isNotNull())
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    gbt = GBTRegressor(
        featuresCol="_x", labelCol=target, maxIter=n_trees, stepSize=learning_rate, maxDepth=depth, subsamplingRate=subsample, seed=seed
    )
    model = gbt.fit(rows.filter(is_training_row(row_id)))
    return model, model.transform(rows.filter(~is_training_row(row_id))).drop("_x")


def regression_metrics(predicted: DataFrame, *, target: str, prediction: str = "prediction", n_features: int = 0) -> DataFrame:
    err = F.col(prediction) - F.col(target)
    return predicted.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_features).cast("long").alias("n_features"),
    )


def conformal_q_hat(residuals: DataFrame, *, residual: Column | str, alpha: float = 0.05) -> DataFrame:
    """One row (q_hat, calibration_size): the k-th smallest absolute residual, NULL for 5 rows or fewer."""
    r = F.abs(F.col(residual) if isinstance(residual, str) else residual)

    def rank(_: float, n: int) -> float:
        return max(min(math.ceil((n + 1) * (1.0 - alpha)), n), 1) - 1

    rows = residuals.select(r.alias("_r"))
    order = exact_quantiles_of(rows, [("q", "_r", 1.0 - alpha)], rank_of=rank)
    n = rows.agg(F.count("_r").alias("calibration_size"))
    return n.withColumn("_q", order.scalar()).select(F.when(F.col("calibration_size") > 5, F.col("_q")).alias("q_hat"), "calibration_size")


def conformal_interval(df: DataFrame, *, prediction: str, q_hat: Column) -> DataFrame:
    return df.withColumn("lower", F.col(prediction) - q_hat).withColumn("upper", F.col(prediction) + q_hat)


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): one aggregate, then long."""
    row = df.agg(*[f(filled(c)).alias(f"{n}{i}") for i, c in enumerate(features) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(features)]))
    )


def group_attribution(df: DataFrame, model: LinearModel, *, governed: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """Adds prediction, governed_sum and one ``group_<name>`` per group; absent columns count 0."""
    phi = model.attribution()
    total = lambda names: sum((phi[c] for c in names if c in phi), F.lit(0.0))
    return df.withColumns(
        {"prediction": model.predict(), "governed_sum": total(governed), **{f"group_{g}": total(cols) for g, cols in groups.items()}}
    )


# --- tree attribution ------------------------------------------------------------------------


def _leaves(node, bounds: dict[int, tuple[float, float]], scale: float, out: list) -> None:
    if node.subtreeDepth() == 0:
        out.append((bounds, scale * node.prediction()))
        return
    split = node.split()
    f, cut = split.featureIndex(), split.threshold()
    low, high = bounds.get(f, (-np.inf, np.inf))
    _leaves(node.leftChild(), {**bounds, f: (low, min(high, cut))}, scale, out)
    _leaves(node.rightChild(), {**bounds, f: (max(low, cut), high)}, scale, out)


def _pattern(x: np.ndarray, bounds: dict[int, tuple[float, float]]) -> np.ndarray:
    """Number whose bits say which of a leaf's feature intervals each row satisfies."""
    feats = sorted(bounds)
    inside = np.column_stack([(x[:, f] > bounds[f][0]) & (x[:, f] <= bounds[f][1]) for f in feats])
    return inside @ (1 << np.arange(len(feats)))


def leaf_shares(rows: DataFrame, leaves: list, features: Sequence[str]) -> list[np.ndarray]:
    """Per leaf the share of each of its 2^k patterns among all ``rows``: counted on the executors, one sum per pattern."""
    bounds = [b for b, _ in leaves]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.zeros(1 << len(b), np.int64) for b in bounds]
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            for total, b in zip(seen, bounds, strict=True):
                total += np.bincount(_pattern(x, b), minlength=len(total)) if b else len(x)
        yield pd.DataFrame([(i, p, int(k)) for i, total in enumerate(seen) for p, k in enumerate(total) if k], columns=["leaf", "pattern", "k"])

    shares = [np.zeros(1 << len(b)) for b in bounds]
    for row in rows.select(*features).mapInPandas(count, "leaf int, pattern int, k long").groupBy("leaf", "pattern").agg(F.sum("k").alias("k")).collect():
        shares[row["leaf"]][row["pattern"]] = row["k"]
    return [s / max(s.sum(), 1) for s in shares]


def leaf_tables(leaves: list, shares: list[np.ndarray]) -> tuple[list, float]:
    """Per leaf: its feature intervals and, per pattern of satisfied intervals, the attribution vector.

    With k features on a leaf path a row falls into one of 2^k patterns, and so does every background
    row; Shapley weights depend only on the two patterns, so the shares of the patterns are all that is
    needed of the background.
    """
    from math import factorial

    tables, expected = [], 0.0
    for (bounds, value), share in zip(leaves, shares, strict=True):
        feats = sorted(bounds)
        k = len(feats)
        if k == 0:
            expected += value
            continue
        expected += value * share[-1]
        table = np.zeros((1 << k, k))
        for px in range(1 << k):
            for pz in range(1 << k):
                if share[pz] == 0 or (px | pz) != (1 << k) - 1:
                    continue
                only_x = [i for i in range(k) if px >> i & 1 and not pz >> i & 1]
                only_z = [i for i in range(k) if pz >> i & 1 and not px >> i & 1]
                u, v = len(only_x), len(only_z)
                for i in only_x:
                    table[px, i] += share[pz] * value * factorial(u - 1) * factorial(v) / factorial(u + v)
                for i in only_z:
                    table[px, i] -= share[pz] * value * factorial(u) * factorial(v - 1) / factorial(u + v)
        tables.append((feats, bounds, table))
    return tables, expected


def tree_attribution(df: DataFrame, model, *, features: Sequence[str], row_id: str, background: DataFrame | None = None) -> DataFrame:
    """(row_id, phi_<feature>..., expected, prediction): exact interventional attribution of a tree ensemble.

    All rows of ``background`` (``df`` itself by default) are the background. Rows stay where they are (no shuffle).
    """
    features = list(features)
    leaves: list = []
    for tree, w in zip(model.trees, model.treeWeights):
        _leaves(tree._call_java("rootNode"), {}, float(w), leaves)
    rows = df.select(row_id, *[filled(f).alias(f) for f in features])
    base = rows if background is None else background.select(*[filled(f).alias(f) for f in features])
    tables, expected = leaf_tables(leaves, leaf_shares(base, leaves, features))
    constant = float(sum(value for bounds, value in leaves if not bounds))
    whole = [(bounds, value) for bounds, value in leaves if bounds]
    schema = f"{row_id} {dict(df.dtypes)[row_id]}, " + ", ".join(f"phi_{f} double" for f in features) + ", expected double, prediction double"

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            phi, said = np.zeros_like(x), np.full(len(x), constant)
            for (feats, bounds, table), (_, value) in zip(tables, whole, strict=True):
                pattern = _pattern(x, bounds)
                phi[:, feats] += table[pattern]
                said += np.where(pattern == len(table) - 1, value, 0.0)
            out = pd.DataFrame(phi, columns=[f"phi_{f}" for f in features])
            out.insert(0, row_id, batch[row_id].to_numpy())
            yield out.assign(expected=expected, prediction=said)

    return rows.mapInPandas(attribute, schema)


# --- summaries and baselines -----------------------------------------------------------------


def basic_summary(df: DataFrame, value: Column | str) -> DataFrame:
    """n, mean, population std, p50, p75, p90 of one column."""
    v = df.select(nan_to_null(value).alias("_v")).filter(F.col("_v").isNotNull())
    q = exact_quantiles_of(v, [("p50", "_v", 0.5), ("p75", "_v", 0.75), ("p90", "_v", 0.9)])
    head = v.agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    return with_stats(head, q, "_q").select("n", "mean", "std", *[F.col(f"_q.{p}").alias(p) for p in ("p50", "p75", "p90")])


def baseline_prediction(df: DataFrame, model: LinearModel, *, governed: Sequence[str], reference: DataFrame, out: str = "baseline") -> DataFrame:
    """Prediction with the governed columns at their reference medians."""
    cols = [c for c in governed if c in model.features]
    med = settled(exact_medians(reference, {c: c for c in cols}))
    attached = with_stats(df, med, "_ref")
    return attached.withColumn(out, model.predict({c: F.coalesce(F.col(f"_ref.{c}"), F.lit(0.0)) for c in cols})).drop("_ref")


# --- evidence --------------------------------------------------------------------------------


def observed_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column) with at least one value that is neither NULL, NaN nor blank; one pass."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)

    def seen(c: str) -> Column:
        if kinds[c] == "string":
            return ~is_blank(c)
        return nan_to_null(c).isNotNull() if kinds[c] in ("double", "float") else F.col(c).isNotNull()

    row = df.agg(*[F.count_if(seen(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_observed")) for i, c in enumerate(columns)])
    return row.select(F.inline(pairs)).filter(F.col("n_observed") > 0)


def derive_case_mix(columns: DataFrame, *, dataset: str = "dataset_id", column: str = "column") -> DataFrame:
    """(dataset, domain, columns) from column names; datasets without all six domains give no rows."""
    name = F.lower(column)
    domains = [
        F.when(
            F.exists(string_array(words), lambda w: (name == w) | name.startswith(F.concat(w, F.lit("_")))), F.lit(d)
        )
        for d, words in C.CASE_MIX_COLUMNS.items()
    ]
    hits = columns.select(dataset, F.col(column).alias("_c"), F.explode(compact(*domains)).alias("domain")).distinct()
    found = hits.groupBy(dataset, "domain").agg(F.array_sort(F.collect_set("_c")).alias("columns"))
    complete = hits.groupBy(dataset).agg(F.count_distinct("domain").alias("_n")).filter(F.col("_n") == len(C.CASE_MIX_DOMAINS))
    return found.join(complete.select(dataset), dataset, "left_semi")


def case_mix_support(declared: DataFrame, observed: DataFrame, datasets: DataFrame, *, dataset: str = "dataset_id") -> DataFrame:
    """(dataset, warnings): domains without columns, declared columns that are not observed, conflicts.

    ``declared`` is (dataset, source, domain, column) with source 'domains' or 'variables'; the variables
    entry of a domain replaces the other one and is reported when it differs.
    """
    per = declared.groupBy(dataset, "domain", "source").agg(F.array_sort(F.collect_set("column")).alias("cols"))
    wide = per.groupBy(dataset, "domain").agg(
        F.max(F.when(F.col("source") == "domains", F.col("cols"))).alias("d"), F.max(F.when(F.col("source") == "variables", F.col("cols"))).alias("v")
    )
    chosen = wide.select(dataset, "domain", F.coalesce("v", "d").alias("cols"), (F.col("d") != F.col("v")).alias("clash"))
    conflicts = chosen.filter("clash").select(dataset, F.concat(F.lit("case_mix_domain_variable_conflict:"), "domain").alias("w"))
    wanted = datasets.select(dataset).distinct().select(dataset, F.explode(string_array(C.CASE_MIX_DOMAINS)).alias("domain"))
    empty = wanted.join(chosen.select(dataset, "domain"), [dataset, "domain"], "left_anti").select(
        dataset, F.concat(F.lit("case_mix_domain_without_observed_columns:"), "domain").alias("w")
    )
    flat = chosen.filter(F.col("domain").isin(list(C.CASE_MIX_DOMAINS))).select(dataset, "domain", F.explode("cols").alias("column"))
    gone = (
        flat.join(observed.select(dataset, "column"), [dataset, "column"], "left_anti")
        .groupBy(dataset, "domain")
        .agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("c"))
        .select(dataset, F.concat(F.lit("case_mix_columns_missing_or_empty:"), "domain", F.lit(":"), "c").alias("w"))
    )
    found = conflicts.unionByName(empty).unionByName(gone).groupBy(dataset).agg(F.array_sort(F.collect_list("w")).alias("warnings"))
    return datasets.select(dataset).distinct().join(found, dataset, "left").withColumn("warnings", F.coalesce("warnings", F.array().cast(NO_TEXT)))


def outcome_comparability(rows: DataFrame, *, keys: Sequence[str], target: str) -> DataFrame:
    """Per dataset: status, warnings, distinct horizons and versions, invalid outcome windows.

    Columns: temporal_spec_version (NULL = no specification), outcome_window_start / _end, outcome_definition.
    """
    has = F.col("has_spec")
    start, end = F.col("outcome_window_start"), F.col("outcome_window_end")
    valid = has & F.coalesce(end > start, F.lit(False))
    seconds = F.when(valid, F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(has).alias("temporal_spec_row_count"),
        F.count_if(has & ~valid).alias("invalid_outcome_window_count"),
        F.count_distinct(seconds).alias("n_horizons"),
        F.min(seconds / 3.6e9).alias("_h"),
        F.count_distinct(F.when(has, F.col("temporal_spec_version"))).alias("n_versions"),
        F.count_distinct(F.when(has, F.col("outcome_definition"))).alias("_defs"),
        F.min(F.when(has, F.col("outcome_definition"))).alias("_def"),
    )
    ununique = (F.col("temporal_spec_row_count") != F.col("_rows")) | (F.col("invalid_outcome_window_count") > 0) | (F.col("n_horizons") > 1)
    other = (F.col("n_versions") > 1) | (F.col("_defs") > 1) | ((F.col("_defs") == 1) & (F.col("_def") != target))
    warnings = compact(
        tag_if(F.col("n_horizons") > 1, "mixed_outcome_horizons"),
        tag_if(F.col("n_versions") > 1, "mixed_temporal_spec_versions"),
        tag_if(other, "outcome_definition_not_comparable"),
        tag_if(ununique, "outcome_window_not_unique"),
    )
    return g.withColumn("warnings", warnings).select(
        *keys,
        F.when(F.size("warnings") == 0, F.lit("comparable")).otherwise(F.lit("not_comparable")).alias("status"),
        "warnings",
        "n_horizons",
        F.when(F.col("n_horizons") == 1, F.col("_h")).alias("outcome_horizon_hours"),
        "n_versions",
        "temporal_spec_row_count",
        "invalid_outcome_window_count",
    )


def dataset_fingerprint(df: DataFrame, *, target: str, features: Sequence[str], grain: str) -> DataFrame:
    """One row: hash of the multiset of rows, independent of order and partitioning."""
    cols = sorted(df.columns)
    row = F.xxhash64(*cols)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).select(
        F.sha2(F.concat_ws("|", F.lit(grain), F.lit(target), F.lit(",".join(features)), "n", "x", F.col("s").cast("string")), 256).alias("fingerprint"),
        F.col("n").alias("n_rows"),
    )


def training_evidence(
    df: DataFrame, *, features: Sequence[str], target: str, grain: str, metrics: DataFrame, calibration: DataFrame, comparability: DataFrame, guard_status: str
) -> DataFrame:
    """One evidence row of a training run, assembled from one-row inputs by scalar subqueries."""
    have = [f for f in features if f in df.columns]
    seen = observed_columns(df, have).agg(F.array_sort(F.collect_list("column")).alias("c"))
    finger = dataset_fingerprint(df, target=target, features=features, grain=grain)
    row = with_stats(with_stats(with_stats(metrics, calibration, "_cal"), comparability, "_cmp"), finger, "_fp").withColumn("_seen", seen.scalar())
    cal = F.col("_cal.calibration_size")
    usable = F.col("_cal.q_hat").isNotNull() & (cal > 0)
    rest = F.col("n_rows") - cal
    absent = string_array(sorted(set(features) - set(df.columns)))
    names = string_array(features)
    unseen = F.array_sort(F.array_except(names, F.col("_seen")))
    empty = F.array_except(unseen, absent)
    return row.select(
        F.col("_fp.fingerprint").alias("dataset_fingerprint"),
        F.when(usable, F.when(rest >= 0, rest)).otherwise(F.col("n_rows")).alias("training_row_count"),
        F.when(usable, cal).alias("validation_row_count"),
        names.alias("feature_names"),
        F.col("_seen").alias("observed_feature_columns"),
        absent.alias("declared_features_missing_from_payload"),
        unseen.alias("features_without_observed_training_values"),
        compact(
            tag_if(F.size(absent) > 0, "declared_feature_missing_from_payload"), tag_if(F.size(empty) > 0, "declared_feature_without_observed_values")
        ).alias("feature_warnings"),
        F.when(F.size(unseen) == 0, F.lit("supported")).otherwise(F.lit("incomplete")).alias("feature_support_status"),
        F.lit(guard_status).alias("temporal_guardrail_status"),
        F.col("_cmp.status").alias("outcome_comparability_status"),
        F.col("_cmp.warnings").alias("outcome_comparability_warnings"),
        F.lit(target).alias("outcome_definition"),
        F.lit(C.INTENDED_USE).alias("intended_use"),
        F.concat(string_array(C.MINIMUM_LIMITATIONS), compact(tag_if(~usable, "calibration_unavailable"))).alias("limitations"),
    )


def _empty(c: Column) -> Column:
    return F.coalesce(F.size(c) == 0, F.lit(True))


def evidence_gate(artifacts: DataFrame) -> DataFrame:
    """Adds missing_evidence, statuses and defensible to an artifact table (one typed column per field)."""
    t = F.col
    names, own = F.coalesce("feature_names", F.array().cast(NO_TEXT)), F.coalesce("features", F.array().cast(NO_TEXT))
    none = F.array().cast(NO_TEXT)
    guard = F.coalesce(F.trim("temporal_guardrail_status"), F.lit(""))
    passed, idle = guard.isin(list(C.GUARD_PASSED)), guard.isin(list(C.GUARD_NOT_EVALUATED))
    need_spec = idle | (guard == "insufficient_temporal_spec")
    extra, lacking = F.array_sort(F.array_except(names, own)), F.array_sort(F.array_except(own, names))
    mismatch = (F.size(names) > 0) & (names != own)
    name_notes = F.when(
        mismatch,
        compact(
            tag_if((F.size(extra) == 0) & (F.size(lacking) == 0), "feature_names_order_mismatch"),
            tag_if(F.size(extra) > 0, F.concat(F.lit("evidence_features_missing_from_artifact:"), F.array_join(extra, ","))),
            tag_if(F.size(lacking) > 0, F.concat(F.lit("artifact_features_missing_from_evidence:"), F.array_join(lacking, ","))),
        ),
    ).otherwise(none)
    support = F.coalesce("feature_support_status", F.lit(""))
    warned = F.array_sort(F.array_distinct(F.coalesce("feature_warnings", none)))
    unseen = F.array_sort(
        F.array_union(F.coalesce("features_without_observed_training_values", none), F.array_except(names, F.coalesce("observed_feature_columns", none)))
    )
    absent = (F.size(F.coalesce("declared_features_missing_from_payload", none)) > 0) | F.array_contains(warned, "declared_feature_missing_from_payload")
    feature_issues = F.concat(
        compact(
            tag_if(support == "", "feature_support_not_evaluated"),
            tag_if(~support.isin("", "supported"), F.concat(F.lit("feature_support_not_supported:"), support)),
            tag_if(absent, "declared_features_missing_from_payload"),
            tag_if(absent, "declared_feature_missing_from_payload"),
        ),
        F.array_intersect(warned, string_array(C.BLOCKING_FEATURE_WARNINGS)),
        compact(
            tag_if(F.size(unseen) > 0, "features_without_observed_training_values"),
            tag_if(F.size(unseen) > 0, F.concat(F.lit("features_without_observed_training_values:"), F.array_join(unseen, ","))),
        ),
    )
    comparable = F.array_sort(F.array_intersect(F.coalesce("outcome_comparability_warnings", none), string_array(C.OUTCOME_COMPARABILITY_WARNINGS)))
    incomparable = (F.coalesce("outcome_comparability_status", F.lit("")) == "not_comparable") | (F.size(comparable) > 0)
    limits = F.array_sort(F.array_except(string_array(C.REQUIRED_LIMITATIONS), F.coalesce("limitations", none)))
    domains = F.coalesce("case_mix_domains", none)
    thin_mix = F.size(F.array_except(string_array(C.CASE_MIX_DOMAINS), domains)) > 0
    gov = F.coalesce("governance_status", F.lit("candidate"))
    unusable = gov != "candidate"
    valid_n = F.coalesce(t("validation_row_count") > 0, F.lit(False))
    blank = lambda c: is_blank(c)
    fields = [
        ("model_id", blank("model_id")),
        ("artifact_created_at", t("created_at").isNull()),
        ("dataset_fingerprint", blank("dataset_fingerprint")),
        ("feature_names", F.size(names) == 0),
        ("temporal_spec_version", blank("temporal_spec_version")),
        ("temporal_guardrail_status", guard == ""),
        ("outcome_definition", blank("outcome_definition") & blank("target")),
        ("outcome_window", blank("outcome_window")),
        ("intended_use", blank("intended_use")),
        ("non_individual_use", t("non_individual_use").isNull()),
        ("shadow_mode", t("shadow_mode").isNull()),
        ("limitations", _empty(t("limitations"))),
        ("invalid_training_row_count", ~F.coalesce(t("training_row_count") > 0, F.lit(False))),
        ("invalid_validation_row_count", ~valid_n),
        ("validation_metrics_or_unavailable_reason", blank("validation_metrics") & blank("validation_unavailable_reason")),
        ("calibration_summary_or_unavailable_reason", blank("calibration_summary") & blank("calibration_unavailable_reason")),
        ("case_mix_spec_or_unavailable_reason", (F.size(domains) == 0) & blank("case_mix_unavailable_reason")),
        ("case_mix_spec_sufficient", thin_mix),
        ("feature_names_mismatch", mismatch),
        ("temporal_guardrail_not_evaluated", ~passed & idle),
        ("temporal_spec_required", ~passed & need_spec),
        ("provenance_or_source_commit_or_unavailable_reason", blank("provenance") & blank("source_commit") & blank("source_commit_unavailable_reason")),
        ("artifact_governance_status_usable", unusable),
        ("required_limitations", F.size(limits) > 0),
    ]
    missing = F.concat(
        compact(
            *[tag_if(cond, name) for name, cond in fields],
            tag_if(~passed & ~idle, F.concat(F.lit("temporal_guardrail_not_passed:"), guard)),
            tag_if(F.size(limits) > 0, F.concat(F.lit("missing_required_limitations:"), F.array_join(limits, ","))),
        ),
        name_notes,
        feature_issues,
        F.when(incomparable, F.when(F.size(comparable) > 0, comparable).otherwise(string_array(["outcome_definition_not_comparable"]))).otherwise(none),
    )
    with_missing = artifacts.withColumn("missing_evidence", F.array_sort(missing))
    statuses = F.concat(
        compact(
            tag_if(F.size("missing_evidence") > 0, "evidence_incomplete"),
            tag_if(~F.coalesce("non_individual_use", F.lit(False)), "individual_use_not_blocked"),
            tag_if(~F.coalesce("shadow_mode", F.lit(False)), "shadow_mode_missing"),
            tag_if(F.coalesce("intended_use", F.lit("")) != C.INTENDED_USE, "intended_use_not_shadow_aggregate_research"),
            tag_if(~passed & idle, "temporal_guardrail_not_evaluated"),
            tag_if(~passed & ~idle, "temporal_guardrail_not_passed"),
            tag_if(incomparable, "outcome_definition_not_comparable"),
            tag_if(F.size(limits) > 0, "limitations_incomplete"),
            tag_if(thin_mix, "case_mix_insufficient"),
            tag_if(mismatch, "feature_names_mismatch"),
            tag_if(F.size(feature_issues) > 0, "feature_support_incomplete"),
            tag_if(blank("calibration_summary"), "calibration_unavailable"),
            tag_if(blank("validation_metrics") | ~valid_n, "validation_unavailable"),
            tag_if(unusable, F.concat(F.lit("model_artifact_"), gov)),
        ),
        F.when(incomparable, comparable).otherwise(none),
        name_notes,
        F.when(F.size(feature_issues) > 0, warned).otherwise(none),
    )
    judged = with_missing.withColumn("_st", statuses).withColumn("defensible", (F.size("missing_evidence") == 0) & (F.size("_st") == 0))
    final = F.array_sort(F.array_distinct(F.concat(F.col("_st"), compact(tag_if(~F.col("defensible"), "model_not_defensible")))))
    return judged.withColumn("statuses", final).drop("_st")


def quarantine_artifacts(judged: DataFrame) -> DataFrame:
    """Artifacts that are not defensible lose their candidate status."""
    return judged.withColumn("governance_status", F.when(~F.col("defensible"), F.lit("quarantine")).otherwise(F.col("governance_status")))
