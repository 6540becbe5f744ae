"""Five-part composite score with explicit uncertainty."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import (
    as_col,
    bounded,
    clip,
    compact,
    is_blank,
    mean_of_present,
    nan_to_null,
    or_setting,
    sorted_unique,
    string_array,
    tag_if,
)
from caretrace.functions.quantiles import exact_medians
from caretrace.functions.tables import settled, with_stats

NO_TEXT = "array<string>"


@dataclass(frozen=True)
class ScoreSpec:
    """Settings of the score; a zero counts as "use the default"."""

    weights: dict[str, float] = field(default_factory=dict)
    mad_scale: float = 1.4826
    eps: float = 1e-6
    clip: float = 4.0
    min_reference_rows: int = 5
    attribution_epsilon: float = 1e-6
    min_causal_rows: int = 30
    min_quality_parts: int = 1
    uncertainty_weights: dict[str, float] = field(default_factory=lambda: dict(C.UNCERTAINTY_WEIGHTS))
    ood_z_threshold: float = 3.0
    min_training_rows: int = 100
    high_uncertainty: float = 0.60
    severity_clip: float = 2.0
    min_confidence: float = 0.05

    def weight(self, name: str) -> float:
        return float(self.weights.get(name, 0.0 if name == "intercept" else 1.0))


DEFAULT = ScoreSpec()


# --- outcome direction -----------------------------------------------------------------------


def infer_outcome_goal(name: Column | str, rules=C.OUTCOME_GOAL_RULES) -> Column:
    """Goal of the first rule with a token inside the outcome name."""
    text = F.lower(F.trim(F.coalesce(as_col(name), F.lit(""))))
    out = None
    for tokens, goal in rules:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | text.contains(token)
        out = F.when(hit, F.lit(goal)) if out is None else out.when(hit, F.lit(goal))
    return F.lit("higher_is_better") if out is None else out.otherwise(F.lit("higher_is_better"))


def utility(value: Column, goal: Column | str) -> Column:
    """Higher is always better afterwards."""
    better = F.lit(goal) if isinstance(goal, str) else goal
    return F.when(F.lower(F.trim(better)) == "higher_is_better", value).otherwise(-value)


# --- robust z --------------------------------------------------------------------------------


def robust_stats(reference: DataFrame, columns: Sequence[str], spec: ScoreSpec = DEFAULT) -> DataFrame:
    """One row: ``<c>_center`` and ``<c>_scale`` of every column over the reference rows.

    All columns share the two quantile passes, which run now.
    """
    eps = or_setting(spec.eps, 1e-6)
    clean = reference.select(*[nan_to_null(c).alias(c) for c in columns])
    med = settled(exact_medians(clean, {c: c for c in columns}))
    dev = with_stats(clean, med, "_m").select(*[F.abs(F.col(c) - F.col(f"_m.{c}")).alias(c) for c in columns])
    mad = settled(exact_medians(dev, {c: c for c in columns}))
    base = clean.agg(
        *[F.count(c).alias(f"{c}_n") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns]
    )
    row = with_stats(with_stats(base, med, "_med"), mad, "_mad")
    picked = []
    for c in columns:
        robust = F.col(f"_mad.{c}") * or_setting(spec.mad_scale, 1.4826)
        sd = F.col(f"{c}_sd")
        usable = (F.col(f"{c}_n") >= int(or_setting(spec.min_reference_rows, 5))) & (robust > eps)
        scale = F.when(usable, robust).when(sd > eps, sd).otherwise(F.lit(1.0))
        method = F.when(usable, F.lit("robust_z")).when(sd > eps, F.lit("std_z_fallback")).otherwise(F.lit("identity_fallback"))
        picked += [F.col(f"_med.{c}").alias(f"{c}_center"), scale.alias(f"{c}_scale"), method.alias(f"{c}_method")]
    return settled(row.select(*picked))


def z_from(stats: str, column: str, value: Column | None = None, spec: ScoreSpec = DEFAULT) -> Column:
    """Clipped z of a column from an attached ``robust_stats`` struct; NULL without reference values."""
    limit = or_setting(spec.clip, 4.0)
    v = nan_to_null(value if value is not None else F.col(column))
    return clip((v - F.col(f"{stats}.{column}_center")) / F.col(f"{stats}.{column}_scale"), -limit, limit)


def robust_z(values: DataFrame, reference: DataFrame, *, column: str, out: str = "z", spec: ScoreSpec = DEFAULT) -> DataFrame:
    """Adds the clipped robust z and the method used."""
    attached = with_stats(values, robust_stats(reference, [column], spec), "_z")
    return attached.withColumn(out, z_from("_z", column, spec=spec)).withColumn(f"{out}_method", F.col(f"_z.{column}_method")).drop("_z")


# --- components ------------------------------------------------------------------------------


def _flag(c: str) -> Column:
    # NaN sorts above every number, so it is taken out before the bounds are applied.
    return bounded(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 0.0, 1.0)


def missingness_burden(columns: Sequence[str]) -> Column | None:
    """Mean of all ``missing_*`` columns, NULL counting as 0; None when there are none."""
    cols = [c for c in columns if c.startswith("missing_")]
    return sum((_flag(c) for c in cols[1:]), _flag(cols[0])) / F.lit(float(len(cols))) if cols else None


def process_quality(columns: Sequence[str], spec: ScoreSpec = DEFAULT) -> tuple[Column | None, dict[str, Column]]:
    """(quality, parts): completeness, documentation ratio, timeliness."""
    parts: dict[str, Column] = {}
    burden = missingness_burden(columns)
    if burden is not None:
        parts["structured_completeness"] = bounded(F.lit(1.0) - burden, 0.0, 1.0)
    if "nurse_proc_count" in columns:
        # Without a deterministic count nothing is known to be documented.
        done = nan_to_null("nurse_proc_count_det") if "nurse_proc_count_det" in columns else F.lit(0.0)
        total = F.col("nurse_proc_count").cast("double")
        usable = (total > 0) & ~F.isnan(total) & done.isNotNull()
        parts["documentation_consistency"] = F.when(usable, bounded(done / total, 0.0, 1.0))
    timed = [c for c in columns if c.startswith("missing_loinc_") and c.endswith(("_t0", "_t1"))]
    if timed:
        mean = sum((_flag(c) for c in timed[1:]), _flag(timed[0])) / F.lit(float(len(timed)))
        parts["timeliness"] = bounded(F.lit(1.0) - mean, 0.0, 1.0)
    if not parts:
        return None, {}
    # Only the documentation ratio can be absent in a row; the other parts always exist.
    sure = [p for n, p in parts.items() if n != "documentation_consistency"]
    ratio = parts.get("documentation_consistency")
    need = int(or_setting(spec.min_quality_parts, 1))
    base = sum(sure, F.lit(0.0))
    without = base / F.lit(float(len(sure))) if sure and len(sure) >= need else F.lit(None).cast("double")
    if ratio is None:
        return without, parts
    with_ratio = (base + ratio) / F.lit(float(len(sure) + 1)) if len(sure) + 1 >= need else F.lit(None).cast("double")
    return F.coalesce(with_ratio, without), parts


def ood_burden(features: Sequence[str], stats: str, columns: Sequence[str], spec: ScoreSpec = DEFAULT) -> Column | None:
    """Mean over features of clip((|z| - t) / t, 0, 1); ``stats`` is an attached struct of <f>_mean, <f>_std."""
    distances = ood_distances(features, stats, columns)
    return ood_from_distances(list(distances.values()), spec) if distances else None


def ood_distances(features: Sequence[str], stats: str, columns: Sequence[str]) -> dict[str, Column]:
    """|z| per feature; NULL where the feature does not vary or the value is missing."""
    out = {}
    for f in features:
        if f in columns:
            sd = F.col(f"{stats}.{f}_std")
            out[f] = F.abs(nan_to_null(f) - F.coalesce(F.col(f"{stats}.{f}_mean"), F.lit(0.0))) / F.when(sd > 1e-9, sd)
    return out


def ood_from_distances(distances: Sequence[Column], spec: ScoreSpec = DEFAULT) -> Column:
    t = or_setting(spec.ood_z_threshold, 3.0)
    return mean_of_present([F.when(z.isNotNull(), bounded((z - t) / max(t, 1e-6), 0.0, 1.0)) for z in distances])


def conformal_burden(q_hat: Column, outcome_sd: Column) -> Column:
    scale = F.when(outcome_sd > 1e-6, outcome_sd).otherwise(F.lit(1.0))
    return F.when(q_hat.isNotNull(), F.least(F.abs(q_hat) * 2.0 / F.greatest(scale, F.lit(1e-6)), F.lit(1.0)))


def low_support_burden(train_rows: Column, causal_rows: Column | None = None, spec: ScoreSpec = DEFAULT) -> Column:
    need_t, need_c = or_setting(spec.min_training_rows, 100), or_setting(spec.min_causal_rows, 30)
    short = F.greatest(F.lit(0.0), (F.lit(need_t) - F.coalesce(train_rows, F.lit(0))) / need_t)
    if causal_rows is None:
        return short
    return F.greatest(short, F.coalesce(F.greatest(F.lit(0.0), (F.lit(need_c) - causal_rows) / need_c), F.lit(0.0)))


def combine_uncertainty(parts: dict[str, Column | None], spec: ScoreSpec = DEFAULT) -> Column | None:
    """Weighted mean of the burdens that exist; a part that is None for the batch is left out."""
    live = {n: c for n, c in parts.items() if c is not None}
    if not live:
        return None
    weights = {n: float(spec.uncertainty_weights.get(n, 0.0)) for n in live}
    total = sum(weights.values())
    if total <= 0:
        weights, total = {n: 1.0 for n in live}, float(len(live))
    return sum((clip(nan_to_null(c), 0.0, 1.0) * F.lit(weights[n]) for n, c in live.items()), F.lit(0.0)) / F.lit(total)


def uncertainty_warnings(parts: dict[str, Column | None]) -> list[str]:
    if all(c is None for c in parts.values()):
        return ["uncertainty_unavailable"]
    return [w for n, w in (("conformal_width", "conformal_unavailable"), ("ood", "ood_unavailable")) if parts.get(n) is None]


def severity_weight(
    values: DataFrame, reference: DataFrame, *, column: str, goal: str, out: str = "severity_weight", spec: ScoreSpec = DEFAULT
) -> DataFrame:
    """1 + clip(z of the expected outcome, worse is larger, 0, 2)."""
    sign = F.lit(-1.0 if goal.strip().lower() == "higher_is_better" else 1.0)
    ref = reference.select((nan_to_null(column) * sign).alias("_sev"))
    attached = with_stats(values.withColumn("_sev", nan_to_null(column) * sign), robust_stats(ref, ["_sev"], spec), "_z")
    z = clip(z_from("_z", "_sev", spec=spec), 0.0, or_setting(spec.severity_clip, 2.0))
    return attached.withColumn(out, F.lit(1.0) + z).drop("_z", "_sev")


def relative_attribution(contributions: dict[str, Column], governed: Sequence[str], epsilon: float = 1e-6) -> Column | None:
    """Governed share of the absolute attribution mass, signed."""
    cols = [c for c in governed if c in contributions]
    if not cols or not contributions:
        return None
    mass = sum((F.abs(c) for c in contributions.values()), F.lit(0.0))
    return sum((contributions[c] for c in cols), F.lit(0.0)) / (mass + F.lit(or_setting(epsilon, 1e-6)))


def benefit(outcome: Column, baseline: Column, goal: Column | str) -> Column:
    return utility(outcome, goal) - utility(baseline, goal)


# --- row score -------------------------------------------------------------------------------


def row_score(df: DataFrame, *, raw_uncertainty: str = "raw_uncertainty", spec: ScoreSpec = DEFAULT) -> DataFrame:
    """Adds status, provisional, raw_score, score, confidence, confidence_label, flags and warnings.

    Reads the five normalised component columns (NULL = unavailable) and the raw uncertainty.
    """
    u = F.coalesce(F.col(raw_uncertainty), F.lit(0.0))
    missing = [tag_if(F.col(c).isNull(), f"missing_required_component:{c}") for c in C.REQUIRED_COMPONENTS]
    blocked = F.lit(False)
    for c in C.REQUIRED_COMPONENTS:
        blocked = blocked | F.col(c).isNull()
    no_causal = F.col("causal").isNull()
    raw = (
        F.lit(spec.weight("intercept"))
        + F.lit(spec.weight("benefit")) * F.col("benefit")
        + F.lit(spec.weight("attribution")) * F.col("attribution")
        + F.lit(spec.weight("quality")) * F.col("quality")
        - F.lit(spec.weight("uncertainty")) * F.col("uncertainty")
        + F.lit(spec.weight("causal")) * F.coalesce(F.col("causal"), F.lit(0.0))
    )
    scored = df.withColumn("raw_score", F.when(~blocked, raw))
    high = u >= or_setting(spec.high_uncertainty, 0.60)
    low_support = (u >= 0.25) & F.col("uncertainty").isNotNull()
    provisional = ~blocked & no_causal
    return row_confidence(
        scored.withColumns(
            {
                "status": F.when(blocked, F.lit("insufficient_evidence")).when(no_causal, F.lit("provisional")).otherwise(F.lit("complete")),
                "provisional": provisional,
                "score": sigmoid100(F.col("raw_score")),
                "flag_causal_available": ~no_causal,
                "flag_low_support": low_support,
                "flag_high_uncertainty": high,
                "flag_missing_key_inputs": blocked,
                "warnings": F.sort_array(
                    compact(
                        *missing,
                        tag_if(provisional, "causal_unavailable_score_is_provisional"),
                        tag_if(high, "high_uncertainty"),
                        tag_if(low_support, "low_support"),
                    )
                ),
            }
        ),
        raw_uncertainty=raw_uncertainty,
        spec=spec,
    )


def sigmoid100(raw: Column) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + F.exp(-clip(raw, -20.0, 20.0)))


def row_confidence(df: DataFrame, *, raw_uncertainty: str = "raw_uncertainty", spec: ScoreSpec = DEFAULT) -> DataFrame:
    base = F.lit(1.0) - F.greatest(F.coalesce(F.col(raw_uncertainty), F.lit(0.0)), F.lit(0.0))
    base = base * F.when(F.col("provisional"), 0.85).otherwise(1.0)
    base = base * F.when(F.col("status") == "insufficient_evidence", 0.25).otherwise(1.0)
    return df.withColumn("confidence", clip(base, or_setting(spec.min_confidence, 0.05), 1.0)).withColumn(
        "confidence_label", F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.45, "medium").otherwise("low")
    )


def row_flags(df: DataFrame, *, low_support: str, ood: str) -> DataFrame:
    """Flags overwritten from the burdens; a warning given earlier stays."""
    low = F.coalesce(F.col(low_support), F.lit(0.0)) > 0
    far = F.coalesce(F.col(ood), F.lit(0.0)) > 0
    extra = compact(tag_if(low, "low_support"), tag_if(far, "ood_detected"))
    return df.withColumns(
        {
            "flag_low_support": low,
            "flag_ood_detected": far,
            "warnings": F.sort_array(F.array_distinct(F.concat(F.col("warnings"), extra))),
        }
    )


# --- cohort ----------------------------------------------------------------------------------


def select_cohort(
    rows: DataFrame,
    *,
    grain: str,
    episode_ids: Sequence[int] | None = None,
    unit_id: int | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(selected, reference): the same filters, the reference without the explicit ids."""
    low, high = ("admission", "admission") if grain == "episode" else ("start_dt", "end_dt")
    reference = rows
    if unit_id is not None:
        reference = reference.filter(F.col("unit_id") == unit_id)
    if date_from is not None:
        reference = reference.filter(F.col(low) >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        reference = reference.filter(F.col(high) <= F.lit(date_to).cast("timestamp_ntz"))
    selected = reference.filter(F.col("episode_id").isin(list(episode_ids))) if episode_ids else reference
    return selected, reference


def staff_shares(procedures: DataFrame, *, ids: Sequence[str]) -> DataFrame:
    """(ids, staff_shares MAP, staff_reliability): nursing procedures per identified actor over all of them."""
    ids = list(ids)
    actor = F.trim(F.coalesce("performer_actor_ref", F.lit("")))
    counts = procedures.filter("is_nursing").groupBy(*ids, actor.alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    named = F.col("_a") != ""
    sums = counts.groupBy(*ids).agg(
        F.sum("_n").alias("_all"),
        F.sum(F.when(named, F.col("_n")).otherwise(F.lit(0))).alias("_known"),
        F.array_sort(F.collect_list(F.when(named, F.struct("_a", "_n")))).alias("_p"),
    )
    share = F.map_from_entries(
        F.transform("_p", lambda p: F.struct(p["_a"].alias("key"), (p["_n"] / F.col("_all")).alias("value")))
    )
    return sums.select(*ids, share.alias("staff_shares"), (F.col("_known") / F.col("_all")).alias("staff_reliability"))


# --- external rows ---------------------------------------------------------------------------


def missingness_is_true(value: Column) -> Column:
    """Truth of a flag given as text: unknown words are true, NULL is false."""
    v = F.lower(F.trim(value))
    return F.when(value.isNull() | v.isin("", "0", "0.0", "false", "no", "n"), F.lit(False)).otherwise(F.lit(True))


def normalize_external_rows(rows: DataFrame, *, index: str) -> DataFrame:
    """Flat external rows: features plus ``missing_*`` 0/1 entries, defaulted ids and times.

    Columns: row_id, episode_id, window_id, patient_key, unit_id, start_dt, end_dt, clinical_timestamp,
    features MAP<STRING,DOUBLE>, missingness_flags MAP<STRING,STRING>, staff_shares MAP, staff_reliability.
    """
    flags = F.coalesce("missingness_flags", F.create_map().cast("map<string,string>"))
    named = F.transform(
        F.map_entries(flags),
        lambda e: F.struct(
            F.when(e["key"].startswith("missing_"), e["key"]).otherwise(F.concat(F.lit("missing_"), e["key"])).alias("key"),
            F.when(missingness_is_true(e["value"]), F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
        ),
    )
    features = F.coalesce("features", F.create_map().cast("map<string,double>"))
    # A plain and a prefixed key of one flag meet in one entry; the later one wins.
    names = F.transform("_named", lambda x: x["key"])
    last = F.filter("_named", lambda x, i: ~F.array_contains(F.slice(F.col("_names"), i + 2, F.lit(1 << 20)), x["key"]))
    kept = F.map_filter(features, lambda k, v: ~F.array_contains(F.col("_names"), k))
    positional = F.concat(F.lit("row:"), F.col(index))
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    staged = rows.withColumn("_named", named).withColumn("_names", names)
    return staged.withColumns(
        {
            "row_id": F.coalesce(text("row_id"), positional),
            "patient_key": F.coalesce(text("patient_key"), text("episode_id"), positional),
            "start_dt": F.coalesce("start_dt", "clinical_timestamp"),
            "end_dt": F.coalesce("end_dt", "clinical_timestamp"),
            "features": F.map_concat(kept, F.map_from_entries(last)),
            "staff_shares": F.coalesce("staff_shares", F.create_map().cast("map<string,double>")),
            "staff_reliability": F.coalesce("staff_reliability", F.lit(0.0)),
        }
    ).drop("_named", "_names")


@dataclass(frozen=True)
class FeatureContract:
    features: tuple[str, ...]
    contract_version: str
    source_repo: str
    grain: str
    required: tuple[str, ...] | None = None
    min_coverage: float | str | None = None
    role: str = "primary"

    def coverage_limit(self) -> tuple[float, bool]:
        """(least coverage, the setting is usable); without a usable setting the default holds."""
        if self.min_coverage is None:
            return DEFAULT_MIN_COVERAGE, True
        try:
            limit = float(self.min_coverage)
        except (TypeError, ValueError):
            return DEFAULT_MIN_COVERAGE, False
        return (limit, True) if math.isfinite(limit) else (DEFAULT_MIN_COVERAGE, False)


# Fixed value: coverage that a contract asks for when it names none.
DEFAULT_MIN_COVERAGE = 0.95
CONTRACT_RANK = {"low_feature_coverage": 1, "insufficient_evidence": 2, "contract_mismatch": 3, "blocked_by_reference_contract": 4}


def feature_contract(rows: DataFrame, contract: FeatureContract, *, index: str) -> DataFrame:
    """Issue rows (row_id, contract_status, contract_warnings, coverage, ...) of rows that break the contract.

    Where ``rows`` has a column row_is_object, rows for which it is false were no object when they were read: they are an
    issue of their own, with every feature missing.
    """
    limit, usable = contract.coverage_limit()
    expected = string_array(contract.features)
    required = contract.required if contract.required is not None else contract.features
    have = F.map_keys(F.col("features"))
    flags = F.coalesce("missingness_flags", F.create_map().cast("map<string,string>"))
    missing = F.array_sort(F.array_except(expected, have))
    coverage = F.size(F.array_intersect(expected, have)) / F.lit(float(len(contract.features) or 1))
    critical = F.array_sort(
        F.filter(
            string_array(required),
            lambda f: ~F.array_contains(have, f)
            | F.try_element_at("features", f).isNull()
            | missingness_is_true(F.try_element_at(flags, f))
            | missingness_is_true(F.try_element_at(flags, F.concat(F.lit("missing_"), f))),
        )
    )
    same = lambda c, want: F.coalesce(F.col(c) == want, F.lit(False))
    context = compact(
        tag_if(F.lit(not usable), "invalid_min_feature_coverage"),
        tag_if(~same("contract_version", contract.contract_version), "contract_version_mismatch"),
        tag_if(~same("source_repo", contract.source_repo), "source_repo_mismatch"),
        tag_if(~same("source_grain", contract.grain), "grain_mismatch"),
        tag_if(is_blank("clinical_timestamp") | is_blank("recorded_timestamp"), "temporal_context_missing"),
        tag_if(~(F.coalesce("shadow_mode", F.lit(False)) & F.coalesce("non_individual_use", F.lit(False))), "governance_flags_missing"),
    )
    narrow = F.col("coverage") < limit
    gaps, hard = F.size("missing_features") > 0, F.size("missing_critical") > 0
    broken = ~F.coalesce(F.col("row_is_object"), F.lit(False)) if "row_is_object" in rows.columns else F.lit(False)
    finding = (
        F.when(F.col("_broken"), F.struct(F.lit("contract_mismatch").alias("s"), string_array(["row_not_object"]).alias("w")))
        .when(F.size("_ctx") > 0, F.struct(F.lit("contract_mismatch").alias("s"), F.col("_ctx").alias("w")))
        .when(gaps & ~hard & narrow, F.struct(F.lit("low_feature_coverage").alias("s"), string_array(["low_feature_coverage"]).alias("w")))
        .when(gaps, F.struct(F.lit("contract_mismatch").alias("s"), string_array(["model_feature_space_mismatch"]).alias("w")))
        .when(narrow, F.struct(F.lit("low_feature_coverage").alias("s"), string_array(["low_feature_coverage"]).alias("w")))
        .when(hard, F.struct(F.lit("insufficient_evidence").alias("s"), string_array(["missing_critical_features"]).alias("w")))
    )
    number = F.concat(F.lit("row:"), F.col(index))
    row_id = F.when(broken, number).otherwise(F.coalesce(F.nullif(F.col("row_id").cast("string"), F.lit("")), number))
    checked = (
        rows.select(
            index,
            row_id.alias("row_id"),
            F.when(broken, expected).otherwise(missing).alias("missing_features"),
            F.when(broken, F.lit(0.0)).otherwise(coverage).alias("coverage"),
            F.when(broken, string_array(required)).otherwise(critical).alias("missing_critical"),
            context.alias("_ctx"),
            broken.alias("_broken"),
        )
        # Sound rows drop out after the explode: a filter below would work out every finding several times.
        .select("*", F.explode_outer(F.array(finding)).alias("_f"))
        .filter(F.col("_f").isNotNull())
    )
    status = F.col("_f.s")
    return checked.select(
        index,
        "row_id",
        status.alias("contract_status"),
        sorted_unique(F.col("_f.w")).alias("contract_warnings"),
        "coverage",
        "missing_features",
        "missing_critical",
        (((status == "insufficient_evidence") | (F.size("missing_critical") > 0)) & ~F.col("_broken")).alias("flag_insufficient_evidence"),
        ((F.size("missing_critical") > 0) & ~F.col("_broken")).alias("flag_missing_key_inputs"),
        F.lit(contract.role).alias("model_role"),
    )


def _rank(status: Column) -> Column:
    out = None
    for name, r in CONTRACT_RANK.items():
        out = F.when(status == name, r) if out is None else out.when(status == name, r)
    return out.otherwise(F.lit(0))


def merge_contract_issues(issues: DataFrame, *, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """One issue per row over all model roles: worst status, unions, minimum coverage, flags OR-ed."""
    keys = list(keys)
    union = lambda c: sorted_unique(F.flatten(F.collect_set(c)))
    return issues.groupBy(*keys).agg(
        F.max_by("contract_status", _rank(F.col("contract_status"))).alias("contract_status"),
        union("contract_warnings").alias("contract_warnings"),
        F.min("coverage").alias("coverage"),
        union("missing_features").alias("missing_features"),
        union("missing_critical").alias("missing_critical"),
        F.bool_or("flag_insufficient_evidence").alias("flag_insufficient_evidence"),
        F.bool_or("flag_missing_key_inputs").alias("flag_missing_key_inputs"),
        F.array_sort(F.collect_set("model_role")).alias("model_roles"),
    )


def block_by_reference_or_batch(rows: DataFrame, issues: DataFrame, reference_issues: DataFrame, *, index: str, keep_index: bool = False) -> DataFrame:
    """Status of every requested row when anything breaks the contract; no rows when nothing does.

    A row keeps its own finding; otherwise a reference finding blocks it, otherwise the worst finding of
    the batch does. The two global findings are one-row scalar subqueries.
    """
    own = merge_contract_issues(issues).select("row_id", "contract_status", "contract_warnings")
    ref = reference_issues.select(F.explode("contract_warnings").alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias("w"))
    worst = issues.agg(
        F.min_by("contract_warnings", F.struct(-_rank(F.col("contract_status")), F.col(index))).alias("w")
    )
    number = [F.col(index)] if keep_index else []
    keyed = rows.select(*number, F.coalesce(F.nullif(F.col("row_id").cast("string"), F.lit("")), F.concat(F.lit("row:"), F.col(index))).alias("row_id"))
    joined = keyed.join(own, "row_id", "left").withColumn("_ref", ref.scalar()).withColumn("_bat", worst.scalar())
    by_ref = F.size("_ref") > 0
    blocked = lambda extra, base: sorted_unique(F.concat(string_array(extra), base))
    return (
        joined.filter(by_ref | F.col("_bat").isNotNull())
        .select(
            *number,
            "row_id",
            F.coalesce("contract_status", F.when(by_ref, F.lit("blocked_by_reference_contract")).otherwise(F.lit("contract_mismatch"))).alias("status"),
            F.coalesce(
                "contract_warnings",
                F.when(by_ref, blocked(["blocked_by_reference_contract", "scoring_blocked_by_reference_rows_contract_failure"], F.col("_ref"))).otherwise(
                    blocked(["scoring_blocked_by_batch_contract_failure"], F.col("_bat"))
                ),
            ).alias("warnings"),
        )
    )


# --- summaries -------------------------------------------------------------------------------


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: requested, scored, status counts, component means over scored rows, warning union."""
    has = F.col("score").isNotNull()
    head = scored.agg(
        F.count(F.lit(1)).alias("rows_requested"),
        F.count("score").alias("rows_scored"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("complete", "provisional", "insufficient_evidence")],
        *[F.avg(F.when(has, F.col(c))).alias(f"mean_{c}") for c in C.COMPONENTS],
    )
    union = scored.select(F.explode("warnings").alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias("w"))
    return head.withColumn("warnings", union.scalar())


PUBLIC_IDS = ("row_id", "grain", "episode_id", "window_id", "unit_id", "start_dt", "end_dt")


def redact_rows(scored: DataFrame) -> DataFrame:
    """Public view: allow-listed identifiers, no numbers, boolean flags, warnings; applying it twice changes nothing."""
    kinds = dict(scored.dtypes)
    raw = F.col("raw_score").isNotNull() if "raw_score" in kinds else F.lit(False)
    had_number = F.col("score").isNotNull() | raw
    flags = [c for c, k in kinds.items() if c.startswith("flag_") and k == "boolean"]
    return scored.select(
        *[c for c in PUBLIC_IDS if c in kinds],
        F.when(had_number, F.lit("shadow_only")).otherwise(F.coalesce("status", F.lit("shadow_only"))).alias("status"),
        (F.coalesce("provisional", F.lit(False)) if "provisional" in kinds else F.lit(False)).alias("provisional"),
        F.lit(None).cast("double").alias("score"),
        F.lit(True).alias("score_suppressed"),
        F.coalesce("warnings", F.array().cast(NO_TEXT)).alias("warnings"),
        *flags,
        F.lit(True).alias("shadow_mode"),
        F.lit(True).alias("non_individual_use"),
        F.lit(C.INTENDED_USE).alias("intended_use"),
    )


def redact_summary(summary: DataFrame) -> DataFrame:
    """Counts and warnings of a summary; every mean is dropped."""
    counts = [c for c in summary.columns if c.startswith(("rows_", "n_"))]
    return summary.select(*counts, "warnings", F.lit(True).alias("summary_redacted"), F.lit("non_individual_shadow_mode").alias("redaction_reason"))
