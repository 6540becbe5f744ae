"""Registered queries of model jobs, cohort scoring and effect estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.tables import with_stats
from caretrace.operators import causal as X
from caretrace.operators import forest as E
from caretrace.operators import model as M

from caretrace.operators import score as K
from caretrace.operators import scoring as R
from caretrace.operators import trees as B
from caretrace.operators.cohort_score import score_cohort
from caretrace.operators.guards import spec_map
from caretrace.plans.adapter import Tables
from caretrace.plans.base import emit, query, rnd
from caretrace.session import cut_lineage
from caretrace.plans.score import BLOCK_SQL, BURDEN, FEATURES, PRIMARY, QUALITY, drift_stats, z_sql

PAIR = ["nurse_hppd", "nurse_skillmix"]

# Two-variable least squares in closed form.
LIN_SQL = """SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0, m1, m2 FROM (SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS b1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS b2 FROM
 (SELECT var_pop(nurse_hppd) AS v1, var_pop(nurse_skillmix) AS v2, covar_pop(nurse_hppd, nurse_skillmix) AS v12, covar_pop(nurse_hppd, delta_ri) AS c1, covar_pop(nurse_skillmix, delta_ri) AS c2,
  avg(nurse_hppd) AS m1, avg(nurse_skillmix) AS m2, avg(delta_ri) AS my FROM v_cohort))"""
PRED = "b0 + b1 * nurse_hppd + b2 * nurse_skillmix"


def linear(t: Tables) -> M.LinearModel:
    return M.fit_linear(t.cohort, PAIR, "delta_ri")


def predicted(t: Tables) -> DataFrame:
    return t.cohort.withColumn("prediction", linear(t).predict())


@query("train_outcome_model")
def _(t: Tables) -> DataFrame:
    _, held = M.train_outcome_model(t.feat, features=[*FEATURES, "absent"], target="delta_ri", row_id="row_id", n_trees=5, learning_rate=0.3, depth=4)
    return emit(M.regression_metrics(held, target="delta_ri", n_features=4))


@query(
    "regression_metrics",
    f"""WITH b AS ({LIN_SQL}) SELECT {rnd(f'sqrt(avg(pow({PRED} - delta_ri, 2)))', 'rmse', 5)}, {rnd(f'avg(abs({PRED} - delta_ri))', 'mae', 5)}, count(*) AS n_rows, 2 AS n_features FROM v_cohort, b""",
)
def _(t: Tables) -> DataFrame:
    return emit(M.regression_metrics(predicted(t), target="delta_ri", n_features=2), digits=5)


Q_SQL = f"""SELECT r AS q FROM (SELECT abs({PRED} - delta_ri) AS r, row_number() OVER (ORDER BY abs({PRED} - delta_ri)) AS k, count(*) OVER () AS n FROM v_cohort, b) WHERE k = least(ceil((n + 1) * 0.95), n)"""


@query("conformal_q_hat", f"WITH b AS ({LIN_SQL}) SELECT {rnd('q', 'q_hat', 5)}, (SELECT count(*) FROM v_cohort) AS calibration_size FROM ({Q_SQL})")
def _(t: Tables) -> DataFrame:
    return emit(M.conformal_q_hat(predicted(t), residual=F.col("prediction") - F.col("delta_ri")), digits=5)


@query(
    "conformal_interval",
    f"WITH b AS ({LIN_SQL}), q AS ({Q_SQL}) SELECT row_id, {rnd(f'{PRED}', 'prediction', 5)}, {rnd(f'{PRED} - q', 'lower', 5)}, {rnd(f'{PRED} + q', 'upper', 5)} FROM v_cohort, b, q",
)
def _(t: Tables) -> DataFrame:
    rows = predicted(t)
    q = M.conformal_q_hat(rows, residual=F.col("prediction") - F.col("delta_ri"))
    out = M.conformal_interval(with_stats(rows, q, "_q"), prediction="prediction", q_hat=F.col("_q.q_hat"))
    return emit(out.select("row_id", "prediction", "lower", "upper"), digits=5)


@query("feature_stats", " UNION ALL ".join(f"SELECT '{f}' AS feature, {rnd(f'avg(coalesce({f}, 0))', 'mean', 9)}, {rnd(f'stddev_pop(coalesce({f}, 0))', 'std', 9)} FROM v_feat" for f in [*FEATURES, "delta_ri"]))
def _(t: Tables) -> DataFrame:
    return emit(M.feature_stats(t.feat, [*FEATURES, "delta_ri"]), digits=9)


@query(
    "group_attribution",
    f"""WITH b AS ({LIN_SQL}) SELECT row_id, {rnd(PRED, 'prediction', 5)}, {rnd('b1 * (nurse_hppd - m1)', 'governed_sum', 5)}, {rnd('b1 * (nurse_hppd - m1) + b2 * (nurse_skillmix - m2)', 'group_nursing', 5)}, 0.0 AS group_other FROM v_cohort, b""",
)
def _(t: Tables) -> DataFrame:
    out = M.group_attribution(t.cohort, linear(t), governed=["nurse_hppd"], groups={"nursing": PAIR, "other": ["absent"]})
    return emit(out.select("row_id", "prediction", "governed_sum", "group_nursing", "group_other"), digits=5)


def boosted(t: Tables) -> B.TreeEnsemble:
    """The outcome model at full size: 600 trees of depth 5, fitted on rows outside the hold-out."""
    return B.boosted_model(t.feat.filter(M.is_training_row("row_id")), features=FEATURES, target="delta_ri", row_id="row_id")


@query("train_boosted_model")
def _(t: Tables) -> DataFrame:
    """Errors on the held-out rows of the boosted model and of the training mean."""
    model = boosted(t)
    held = t.feat.filter(~M.is_training_row("row_id")).filter(F.col("delta_ri").isNotNull())
    rows = B.predicted(held.select("row_id", *FEATURES, "delta_ri"), model)
    trained = M.regression_metrics(rows, target="delta_ri", n_features=3)
    plain = M.regression_metrics(rows.withColumn("prediction", F.lit(model.base)), target="delta_ri").select(F.col("rmse").alias("rmse_of_mean"))
    return emit(trained.withColumn("n_trees", F.lit(len(model.value))).withColumn("rmse_of_mean", plain.scalar()), digits=3)


@query("tree_attribution", "SELECT row_id, 0.0 AS gap, 0.0 AS expected_gap FROM v_feat")
def _(t: Tables) -> DataFrame:
    model = boosted(t)
    out = B.explained(t.feat.select("row_id", *FEATURES), B.Explainer.of(model, t.feat))
    expected = out.agg(F.avg("prediction").alias("m")).scalar()
    # The parts add up to the prediction's distance from the background's mean prediction, and that of a second walk.
    again = B.predicted(out, model, out="walked")
    parts = sum((F.col(f"phi_{f}") for f in model.features), F.lit(0.0))
    gaps = again.withColumn("_e", expected)
    return emit(gaps.select("row_id", (F.col("walked") - F.col("prediction")).alias("gap"), (parts + F.col("_e") - F.col("prediction")).alias("expected_gap")))


@query(
    "basic_summary",
    f"""SELECT count(o_totalprice) AS n, {rnd('avg(o_totalprice)', 'mean', 4)}, {rnd('stddev_pop(o_totalprice)', 'std', 4)}, {rnd('quantile_cont(o_totalprice, 0.5)', 'p50', 4)},
    {rnd('quantile_cont(o_totalprice, 0.75)', 'p75', 4)}, {rnd('quantile_cont(o_totalprice, 0.9)', 'p90', 4)} FROM orders""",
)
def _(t: Tables) -> DataFrame:
    return emit(M.basic_summary(t.raw("orders"), "o_totalprice"), digits=4)


@query(
    "baseline_prediction",
    f"WITH b AS ({LIN_SQL}), r AS (SELECT median(nurse_hppd) AS mh FROM v_cohort WHERE flag = 'R') SELECT row_id, {rnd('b0 + b1 * mh + b2 * nurse_skillmix', 'baseline', 5)} FROM v_cohort, b, r",
)
def _(t: Tables) -> DataFrame:
    out = M.baseline_prediction(t.cohort, linear(t), governed=["nurse_hppd"], reference=t.cohort.filter(F.col("flag") == "R"))
    return emit(out.select("row_id", "baseline"), digits=5)


@query(
    "observed_columns",
    """SELECT * FROM (SELECT 'delta_ri' AS "column", count(delta_ri) AS n_observed FROM v_feat UNION ALL SELECT 'missing_loinc_8867_4', count(missing_loinc_8867_4) FROM v_feat
    UNION ALL SELECT 'word', count(*) FILTER (WHERE episode_id % 2 = 0) FROM v_feat) WHERE n_observed > 0""",
)
def _(t: Tables) -> DataFrame:
    df = t.feat.select(
        "delta_ri", "missing_loinc_8867_4", F.when(F.col("episode_id") % 2 == 0, F.lit("x")).otherwise(F.lit("  ")).alias("word"),
        F.lit(" ").alias("blank"), F.lit(float("nan")).alias("nan"), F.lit(None).cast("int").alias("none"),
    )
    return M.observed_columns(df)


@query(
    "derive_case_mix",
    """SELECT s_suppkey AS dataset_id, d.domain, CASE WHEN d.domain = 'baseline_load' AND s_suppkey % 6 = 5 THEN 'BASELINE_LOAD|census_max' ELSE d.cols END AS columns FROM supplier,
    (VALUES ('age', 'age_years'), ('severity', 'ri_initial'), ('comorbidity', 'charlson'), ('fragility_or_dependency', 'frailty_x'), ('baseline_risk', 'ri_initial'), ('baseline_load', 'nurse_hppd')) d(domain, cols)
    WHERE s_suppkey % 6 IN (0, 5)""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 6
    names = ["age_years", "ri_initial", "charlson", "frailty_x", "nurse_hppd"]
    cols = F.array(*[F.when(k != i + 1, F.lit(n)) for i, n in enumerate(names)], F.when(k == 5, F.lit("census_max")), F.when(k == 5, F.lit("BASELINE_LOAD")), F.lit("other"))
    rows = t.raw("supplier").select(F.col("s_suppkey").alias("dataset_id"), F.explode(cols).alias("column")).filter(F.col("column").isNotNull())
    return emit(M.derive_case_mix(rows))


@query(
    "case_mix_support",
    """SELECT s_suppkey AS dataset_id, CASE s_suppkey % 4 WHEN 1 THEN 'case_mix_columns_missing_or_empty:age:c_age' WHEN 2 THEN 'case_mix_domain_without_observed_columns:comorbidity'
    WHEN 3 THEN 'case_mix_columns_missing_or_empty:severity:sev2|case_mix_domain_variable_conflict:severity' ELSE '' END AS warnings FROM supplier""",
)
def _(t: Tables) -> DataFrame:
    sets = t.raw("supplier").select(F.col("s_suppkey").alias("dataset_id"), (F.col("s_suppkey") % 4).alias("k"))
    spread = sets.select("dataset_id", "k", F.explode(F.array(*[F.lit(d) for d in C.CASE_MIX_DOMAINS])).alias("domain"))
    declared = spread.filter(~((F.col("k") == 2) & (F.col("domain") == "comorbidity"))).select(
        "dataset_id", F.lit("domains").alias("source"), "domain", F.concat(F.lit("c_"), "domain").alias("column")
    )
    extra = sets.filter("k = 3").select("dataset_id", F.lit("variables").alias("source"), F.lit("severity").alias("domain"), F.lit("sev2").alias("column"))
    observed = spread.filter(~((F.col("k") == 1) & (F.col("domain") == "age"))).select("dataset_id", F.concat(F.lit("c_"), "domain").alias("column"))
    return emit(M.case_mix_support(declared.unionByName(extra), observed, sets))


COMPARE_SQL = f"""
WITH x AS (SELECT o_custkey % 7 AS dataset_id, o_orderkey AS k, NOT (o_custkey % 7 = 5 AND o_orderkey % 3 = 0) AS has, NOT (o_custkey % 7 = 2 AND o_orderkey % 5 = 0) AS valid,
  CASE WHEN o_custkey % 7 = 1 AND o_orderkey % 2 = 0 THEN 48 ELSE 24 END AS h FROM orders)
SELECT dataset_id, CASE WHEN dataset_id IN (0, 6) THEN 'comparable' ELSE 'not_comparable' END AS status,
 CASE dataset_id WHEN 1 THEN 'mixed_outcome_horizons|outcome_window_not_unique' WHEN 2 THEN 'outcome_window_not_unique' WHEN 3 THEN 'mixed_temporal_spec_versions|outcome_definition_not_comparable'
  WHEN 4 THEN 'outcome_definition_not_comparable' WHEN 5 THEN 'outcome_window_not_unique' ELSE '' END AS warnings,
 count(DISTINCT CASE WHEN has AND valid THEN h END) AS n_horizons, CASE WHEN dataset_id <> 1 THEN 24.0 END AS outcome_horizon_hours, CASE WHEN dataset_id = 3 THEN 2 ELSE 1 END AS n_versions,
 count(*) FILTER (WHERE has) AS temporal_spec_row_count, count(*) FILTER (WHERE has AND NOT valid) AS invalid_outcome_window_count FROM x GROUP BY dataset_id"""


def specced(t: Tables) -> DataFrame:
    d, k = F.col("o_custkey") % 7, F.col("o_orderkey")
    hours = F.when((d == 1) & (k % 2 == 0), 48).when((d == 2) & (k % 5 == 0), 0).otherwise(24)
    return t.raw("orders").select(
        d.alias("dataset_id"),
        (~((d == 5) & (k % 3 == 0))).alias("has_spec"),
        F.when((d == 3) & (k % 2 == 0), F.lit("temporal_v0")).otherwise(F.lit("temporal_v1")).alias("temporal_spec_version"),
        F.when(d == 4, F.lit("other")).when(d == 6, F.lit("delta_ri")).alias("outcome_definition"),
        F.col("o_orderdate").alias("outcome_window_start"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours)).alias("outcome_window_end"),
    )


@query("outcome_comparability", COMPARE_SQL)
def _(t: Tables) -> DataFrame:
    return emit(M.outcome_comparability(specced(t), keys=["dataset_id"], target="delta_ri"))


@query("dataset_fingerprint")
def _(t: Tables) -> DataFrame:
    return M.dataset_fingerprint(t.feat, target="delta_ri", features=FEATURES, grain="window")


@query(
    "training_evidence",
    f"""SELECT (SELECT count(*) FROM v_cohort) - (SELECT count(*) FROM v_cohort WHERE flag = 'R') AS training_row_count, (SELECT count(*) FROM v_cohort WHERE flag = 'R') AS validation_row_count,
    'nurse_hppd|nurse_skillmix|absent' AS feature_names, 'nurse_hppd|nurse_skillmix' AS observed_feature_columns, 'absent' AS declared_features_missing_from_payload, 'absent' AS features_without_observed_training_values,
    'declared_feature_missing_from_payload' AS feature_warnings, 'incomplete' AS feature_support_status, 'passed' AS temporal_guardrail_status, 'not_comparable' AS outcome_comparability_status,
    'mixed_outcome_horizons|mixed_temporal_spec_versions|outcome_definition_not_comparable|outcome_window_not_unique' AS outcome_comparability_warnings, 'delta_ri' AS outcome_definition, 'shadow_aggregate_research' AS intended_use,
    '{"|".join(C.MINIMUM_LIMITATIONS)}' AS limitations""",
)
def _(t: Tables) -> DataFrame:
    rows = predicted(t)
    held = rows.filter(F.col("flag") == "R")
    out = M.training_evidence(
        t.cohort.drop("flag"),
        features=[*PAIR, "absent"],
        target="delta_ri",
        grain="window",
        metrics=M.regression_metrics(rows, target="delta_ri", n_features=3),
        calibration=M.conformal_q_hat(held, residual=F.col("prediction") - F.col("delta_ri")),
        comparability=M.outcome_comparability(specced(t).withColumn("all", F.lit(1)), keys=["all"], target="delta_ri").drop("all"),
        guard_status="passed",
    )
    return emit(out.drop("dataset_fingerprint"))


GATE_ROWS = [
    ("", ""),
    ("dataset_fingerprint", "evidence_incomplete|model_not_defensible"),
    ("invalid_training_row_count", "evidence_incomplete|model_not_defensible"),
    ("invalid_validation_row_count", "evidence_incomplete|model_not_defensible|validation_unavailable"),
    ("feature_names_mismatch|feature_names_order_mismatch", "evidence_incomplete|feature_names_mismatch|feature_names_order_mismatch|model_not_defensible"),
    ("evidence_features_missing_from_artifact:c|feature_names_mismatch", "evidence_features_missing_from_artifact:c|evidence_incomplete|feature_names_mismatch|model_not_defensible"),
    ("artifact_features_missing_from_evidence:d|feature_names_mismatch", "artifact_features_missing_from_evidence:d|evidence_incomplete|feature_names_mismatch|model_not_defensible"),
    ("feature_support_not_evaluated", "evidence_incomplete|feature_support_incomplete|model_not_defensible"),
    (
        "declared_feature_missing_from_payload|declared_feature_missing_from_payload|declared_features_missing_from_payload|feature_support_not_supported:incomplete",
        "declared_feature_missing_from_payload|evidence_incomplete|feature_support_incomplete|model_not_defensible",
    ),
    ("features_without_observed_training_values|features_without_observed_training_values:b", "evidence_incomplete|feature_support_incomplete|model_not_defensible"),
    ("temporal_guardrail_not_evaluated|temporal_spec_required", "evidence_incomplete|model_not_defensible|temporal_guardrail_not_evaluated"),
    ("temporal_guardrail_not_passed:temporal_leakage_blocked", "evidence_incomplete|model_not_defensible|temporal_guardrail_not_passed"),
    ("mixed_outcome_horizons", "evidence_incomplete|mixed_outcome_horizons|model_not_defensible|outcome_definition_not_comparable"),
    ("missing_required_limitations:not_mdr_production_ready|required_limitations", "evidence_incomplete|limitations_incomplete|model_not_defensible"),
    ("case_mix_spec_sufficient", "case_mix_insufficient|evidence_incomplete|model_not_defensible"),
    ("artifact_governance_status_usable", "evidence_incomplete|model_artifact_quarantine|model_not_defensible"),
    ("calibration_summary_or_unavailable_reason", "calibration_unavailable|evidence_incomplete|model_not_defensible"),
    ("", "model_not_defensible|shadow_mode_missing"),
    ("", "intended_use_not_shadow_aggregate_research|model_not_defensible"),
    ("", ""),
]


def artifacts(t: Tables, defect: int | None = None) -> DataFrame:
    """One artifact per supplier; ``supplier % 20`` picks the defect, or one is given."""
    k = F.col("s_suppkey") % 20 if defect is None else F.lit(defect)
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    unless = lambda n, v: F.when(k != n, F.lit(v))
    domains = F.filter(arr(*C.CASE_MIX_DOMAINS), lambda d: (d != "age") | (k != 14))
    return t.raw("supplier").select(
        F.concat(F.lit("m"), "s_suppkey").alias("model_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.when(k == 15, F.lit("quarantine")).otherwise(F.lit("candidate")).alias("governance_status"),
        F.lit("delta_ri").alias("target"),
        F.when(k == 6, arr("a", "b", "d")).otherwise(arr("a", "b")).alias("features"),
        F.when(k == 4, arr("b", "a")).when(k == 5, arr("a", "b", "c")).otherwise(arr("a", "b")).alias("feature_names"),
        F.when(k == 9, arr("a")).otherwise(arr("a", "b", "c")).alias("observed_feature_columns"),
        F.when(k == 8, arr("b")).otherwise(arr()).alias("declared_features_missing_from_payload"),
        arr().alias("features_without_observed_training_values"),
        F.when(k == 8, F.lit("incomplete")).when(k != 7, F.lit("supported")).alias("feature_support_status"),
        F.when(k == 8, arr("declared_feature_missing_from_payload")).otherwise(arr()).alias("feature_warnings"),
        unless(1, "f00d").alias("dataset_fingerprint"),
        F.when(k == 2, 0).otherwise(100).alias("training_row_count"),
        F.when(k != 3, F.lit(20)).alias("validation_row_count"),
        F.lit("temporal_v1").alias("temporal_spec_version"),
        F.when(k == 10, F.lit("unknown")).when(k == 11, F.lit("temporal_leakage_blocked")).otherwise(F.lit("passed")).alias("temporal_guardrail_status"),
        F.when(k == 12, F.lit("not_comparable")).otherwise(F.lit("comparable")).alias("outcome_comparability_status"),
        F.when(k == 12, arr("other", "mixed_outcome_horizons")).otherwise(arr()).alias("outcome_comparability_warnings"),
        F.lit("delta_ri").alias("outcome_definition"),
        F.lit("{}x").alias("outcome_window"),
        domains.alias("case_mix_domains"),
        F.lit(None).cast("string").alias("case_mix_unavailable_reason"),
        F.when(k == 18, F.lit("ranking")).otherwise(F.lit(C.INTENDED_USE)).alias("intended_use"),
        F.lit(True).alias("non_individual_use"),
        (k != 17).alias("shadow_mode"),
        F.when(k == 13, arr(*C.MINIMUM_LIMITATIONS[:2])).otherwise(arr(*C.MINIMUM_LIMITATIONS)).alias("limitations"),
        unless(16, "conformal").alias("calibration_summary"),
        F.lit(None).cast("string").alias("calibration_unavailable_reason"),
        F.lit("rmse").alias("validation_metrics"),
        F.lit(None).cast("string").alias("validation_unavailable_reason"),
        F.lit("lab").alias("provenance"),
        F.lit(None).cast("string").alias("source_commit"),
        F.lit(None).cast("string").alias("source_commit_unavailable_reason"),
    )


def gate_case(i: int) -> str:
    return "CASE s_suppkey % 20 " + " ".join(f"WHEN {n} THEN '{row[i]}'" for n, row in enumerate(GATE_ROWS)) + " END"


@query("evidence_gate", f"SELECT 'm' || CAST(s_suppkey AS STRING) AS model_id, {gate_case(0)} AS missing_evidence, {gate_case(1)} AS statuses, s_suppkey % 20 IN (0, 19) AS defensible FROM supplier")
def _(t: Tables) -> DataFrame:
    return emit(M.evidence_gate(artifacts(t)).select("model_id", "missing_evidence", "statuses", "defensible"))


@query("quarantine_artifacts", "SELECT 'm' || CAST(s_suppkey AS STRING) AS model_id, CASE WHEN s_suppkey % 20 IN (0, 19) THEN 'candidate' ELSE 'quarantine' END AS governance_status FROM supplier")
def _(t: Tables) -> DataFrame:
    return M.quarantine_artifacts(M.evidence_gate(artifacts(t))).select("model_id", "governance_status")


# --- cohort scoring --------------------------------------------------------------------------

COHORT_CAUSAL = X.CausalSpec("nurse_hppd", "delta_ri", ("ri_initial", "nurse_skillmix"), ("ri_initial",), 2)


def scored_cohort(t: Tables) -> DataFrame:
    rows = t.feat
    known = rows.filter(F.col("delta_ri").isNotNull())
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    training = known.filter(~held)
    model = M.fit_linear(training, FEATURES, "delta_ri")
    errors = known.filter(held).select((F.col("delta_ri") - model.predict()).alias("residual"))
    calibration = M.conformal_q_hat(errors, residual="residual").first()
    return score_cohort(
        rows, rows, model=model, governed=PAIR, target="delta_ri", drift=drift_stats(rows), q_hat=calibration["q_hat"], train_rows=training.count(), causal=COHORT_CAUSAL
    )


@query("score_cohort")
def _(t: Tables) -> DataFrame:
    cols = ["row_id", "status", "score", "benefit", "attribution", "causal", "quality", "uncertainty", "confidence", "severity_weight", "flag_ood_detected", "warnings"]
    return emit(scored_cohort(t).select(*cols), digits=4)


# --- whole requests --------------------------------------------------------------------------

REQUEST_Q, REQUEST_ROWS = 3.0, 80


def request_sql(rows: str, reference: str, tag: str) -> str:
    """CTEs that score ``rows`` against ``reference`` by the linear model, without effects; ends in r_<tag>."""
    raw = lambda src: f"""SELECT row_id, delta_ri, y - base AS benefit, p1 / (abs(p1) + abs(p2) + 1e-6) AS attribution, quality,
 least({REQUEST_Q} * 2 / sd, 1) * .35 + missing * .35 + ood * .2 + {(100 - REQUEST_ROWS) / 100} * .1 AS uncertainty, -base AS severity, ood FROM (
 SELECT f.row_id, f.delta_ri, f.delta_ri AS y, b0 + b1 * mh + b2 * nurse_skillmix AS base, b1 * (nurse_hppd - m1) AS p1, b2 * (nurse_skillmix - m2) AS p2, {QUALITY} AS quality, sd, {BURDEN} AS missing,
  ((least(greatest((abs(nurse_hppd - ah) / sh - 3) / 3, 0), 1)) + (least(greatest((abs(nurse_skillmix - ak) / sk - 3) / 3, 0), 1))) / 2 AS ood
 FROM {src} f, lin, (SELECT median(nurse_hppd) AS mh, stddev_pop(delta_ri) AS sd FROM {reference}), (SELECT avg(nurse_hppd) AS ah, stddev_pop(nurse_hppd) AS sh, avg(nurse_skillmix) AS ak, stddev_pop(nurse_skillmix) AS sk FROM v_feat))"""  # noqa: E731
    parts = ("benefit", "attribution", "quality", "uncertainty", "severity")
    z = ", ".join(f"z{tag}_{c} AS ({z_sql(c, f'raw{tag}_ref')})" for c in parts)
    norm = ", ".join(f"least(greatest((r.{c} - z{tag}_{c}.m) / z{tag}_{c}.s, -4), 4) AS z_{c}" for c in parts)
    return f"""raw{tag}_ref AS ({raw(reference)}), raw{tag} AS ({raw(rows)}), {z},
n{tag} AS (SELECT r.*, {norm} FROM raw{tag} r, {', '.join(f'z{tag}_{c}' for c in parts)}),
r_{tag} AS (SELECT *, z_benefit + z_attribution + z_quality - z_uncertainty AS raw_score FROM n{tag})"""


REQUEST_SQL = f"""
WITH lin AS ({LIN_SQL}), known AS (SELECT * FROM v_feat WHERE delta_ri IS NOT NULL), {request_sql('known', 'known', 'clean')}
SELECT 'clean' AS scenario, row_id, 'provisional' AS status, {rnd('100 / (1 + exp(-least(greatest(raw_score, -20), 20)))', 'score', 4)}, {rnd('benefit', 'raw_benefit', 4)},
 {rnd('1 + least(greatest(z_severity, 0), 2)', 'severity_weight', 4)},
 array_to_string(list_sort(list_filter(['causal_unavailable_score_is_provisional', CASE WHEN uncertainty >= 0.6 THEN 'high_uncertainty' END, 'low_support', CASE WHEN ood > 0 THEN 'ood_detected' END], lambda x: x IS NOT NULL)), '|') AS warnings FROM r_clean
UNION ALL SELECT 'batch', row_id, CASE WHEN delta_ri IS NULL THEN 'insufficient_outcome_evidence' ELSE 'temporal_leakage_blocked' END, NULL, NULL, NULL,
 CASE WHEN delta_ri IS NULL THEN 'missing_outcome_target' ELSE 'scoring_blocked_by_batch_temporal_failure' END FROM v_feat
UNION ALL SELECT 'reference', row_id, 'blocked_by_reference_temporal_spec', NULL, NULL, NULL, 'missing_outcome_target|scoring_blocked_by_reference_rows_temporal_failure' FROM known"""


def timed_rows(t: Tables) -> DataFrame:
    """Feature rows with a sound temporal specification; a row without an outcome is a finding."""
    iso = lambda n: F.date_format(F.col("start_dt") + F.make_dt_interval(hours=F.lit(n)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spec = spec_map(
        temporal_spec_version=F.lit(C.TEMPORAL_SPEC_VERSION), index_time=iso(0), feature_window_start=iso(0), feature_window_end=iso(12), outcome_window_start=iso(12), outcome_window_end=iso(24),
        censoring_reason=F.lit("not_censored"), outcome_status=F.lit(C.STATUS_DEFENSIBLE),
    )
    return t.feat.withColumn("temporal_spec", spec)


def sound_artifact(t: Tables, defect: int = 0) -> DataFrame:
    """The judged artifact of one supplier, without a defect or with the given one."""
    return M.evidence_gate(artifacts(t, defect).orderBy("model_id").limit(1))


def scored_request(t: Tables, request: R.Request, model, artifact: DataFrame | None = None) -> DataFrame:
    return R.score_request(
        request, artifact=sound_artifact(t) if artifact is None else artifact, model=model, governed=["nurse_hppd"], target="delta_ri", drift=drift_stats(t.feat), q_hat=REQUEST_Q, train_rows=REQUEST_ROWS
    )


@query("score_request", REQUEST_SQL)
def _(t: Tables) -> DataFrame:
    """The linear model on a clean cohort, on one with rows that break the temporal rules, and against such a reference."""
    rows, model = cut_lineage(timed_rows(t)), linear(t)  # five cohorts read the specifications
    known = rows.filter(F.col("delta_ri").isNotNull())
    asked = {"clean": R.Request(known), "batch": R.Request(rows, reference_rows=known), "reference": R.Request(known, reference_rows=rows)}
    out = None
    for name, request in asked.items():
        part = scored_request(t, request, model)
        shut = F.col("status").isin("temporal_leakage_blocked", "insufficient_outcome_evidence", "blocked_by_reference_temporal_spec")
        part = part.select(F.lit(name).alias("scenario"), "row_id", "status", "score", "raw_benefit", F.when(~shut, F.col("severity_weight")).alias("severity_weight"), "warnings")
        out = part if out is None else out.unionByName(part)
    return emit(out, digits=4)


@query(
    "score_request_external",
    f"""WITH blocked AS ({BLOCK_SQL}) SELECT mode, row_id, status, warnings, CAST(NULL AS DOUBLE) AS score FROM blocked WHERE mode = 'batch'
    UNION ALL SELECT mode, b.row_id, b.status, b.warnings, NULL FROM blocked b JOIN v_issue i ON i.row_id = b.row_id AND i.status IS NULL WHERE mode = 'reference'""",
)
def _(t: Tables) -> DataFrame:
    """Rows of an outside provider: a batch that breaks the contract, and a sound one with a broken reference."""
    model = M.LinearModel(("ri_initial", "nurse_hppd"), (2.0, 0.5), 1.0, (0.5, 4.5))
    sick = cut_lineage(K.feature_contract(t.external, PRIMARY, index="idx").select("idx"))
    sound = t.external.join(sick, "idx", "left_anti")
    broken = t.external.join(sick.filter(F.col("idx") % 2 == 0), "idx", "left_semi")
    asked = {"batch": R.Request(t.external, "episode", contracts=(PRIMARY,), temporal_spec=None), "reference": R.Request(sound, "episode", reference_rows=broken, contracts=(PRIMARY,), temporal_spec=None)}
    out = None
    for name, request in asked.items():
        part = R.score_request(
            request, artifact=sound_artifact(t), model=model, governed=["nurse_hppd"], target="nurse_skillmix",
            drift=t.feat.agg(*[F.lit(v).alias(n) for n, v in (("ri_initial_mean", 0.5), ("ri_initial_std", 0.3), ("nurse_hppd_mean", 4.5), ("nurse_hppd_std", 2.9))]), q_hat=None, train_rows=500,
        )
        part = part.select(F.lit(name).alias("mode"), "row_id", "status", "warnings", "score")
        out = part if out is None else out.unionByName(part)
    return emit(out)


@query(
    "score_request_outcome",
    """SELECT '' AS detail, count(*) AS rows_requested, count(*) AS rows_scored, 'causal_unavailable_score_is_provisional' AS first_warning FROM lineitem WHERE l_orderkey % 50 <> 0
    UNION ALL SELECT 'model_not_defensible', 0, 0, ''""",
)
def _(t: Tables) -> DataFrame:
    """What a request returns for a defensible artifact and for one without a fingerprint: only the first opens the rows."""
    known, model = timed_rows(t).filter(F.col("delta_ri").isNotNull()), linear(t)
    cases = None
    for defect in (0, 1):
        judged = cut_lineage(sound_artifact(t, defect))
        rows = cut_lineage(scored_request(t, R.Request(known), model, judged))
        out = R.request_outcome(rows, R.evidence_detail(judged))
        part = out.select(F.coalesce("detail", F.lit("")).alias("detail"), "rows_requested", "rows_scored", F.coalesce(F.try_element_at("warnings", F.lit(1)), F.lit("")).alias("first_warning"))
        cases = part if cases is None else cases.unionByName(part)
    return emit(cases)


@query("score_cohort_boosted")
def _(t: Tables) -> DataFrame:
    """The request's clean cohort scored by the boosted model."""
    known = timed_rows(t).filter(F.col("delta_ri").isNotNull())
    out = scored_request(t, R.Request(known), boosted(t))
    return emit(out.select("row_id", "status", "score", "prediction", "baseline", "governed_sum", "benefit", "attribution", "quality", "uncertainty", "severity_weight", "warnings"), digits=4)


# --- effects ---------------------------------------------------------------------------------

SPEC = X.CausalSpec("nurse_hppd", "delta_ri", ("nurse_skillmix", "ri_initial"), ("nurse_skillmix",))


def dml_sql(y: str = "delta_ri") -> str:
    """CTEs e_* ending in e_eff(row_id, eff)."""
    return f"""e_m AS (SELECT avg(nurse_hppd) AS mt, avg(nurse_skillmix) AS m1, avg(ri_initial) AS m2, avg({y}) AS my FROM v_cohort),
e_c AS (SELECT row_id, nurse_hppd, nurse_hppd - mt AS t, nurse_skillmix - m1 AS a, ri_initial - m2 AS b, {y} - my AS y FROM v_cohort, e_m),
e_s AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*t) AS ta, sum(b*t) AS tb, sum(a*y) AS ya, sum(b*y) AS yb FROM e_c),
e_k AS (SELECT (bb*ta-ab*tb)/(aa*bb-ab*ab) AS t1, (aa*tb-ab*ta)/(aa*bb-ab*ab) AS t2, (bb*ya-ab*yb)/(aa*bb-ab*ab) AS y1, (aa*yb-ab*ya)/(aa*bb-ab*ab) AS y2 FROM e_s),
e_r AS (SELECT row_id, a, t - t1*a - t2*b AS rt, y - y1*a - y2*b AS ry FROM e_c, e_k),
e_f AS (SELECT sum(rt*rt) AS p, sum(rt*rt*a) AS q, sum(rt*rt*a*a) AS w, sum(rt*ry) AS u, sum(rt*a*ry) AS v FROM e_r),
e_th AS (SELECT (w*u-q*v)/(p*w-q*q) AS h0, (p*v-q*u)/(p*w-q*q) AS h1 FROM e_f),
e_eff AS (SELECT row_id, nurse_hppd, a, h0 + h1*a AS eff FROM e_c, e_th)"""


@query("dml_effects", f"WITH {dml_sql()} SELECT row_id, {rnd('eff', 'effect')} FROM e_eff")
def _(t: Tables) -> DataFrame:
    return emit(X.dml_effects(t.cohort, SPEC).select("row_id", "effect"))


SPLIT_SQL = f"""WITH {dml_sql()},
f_x AS (SELECT row_id, nurse_skillmix AS x1, ri_initial AS x2, nurse_hppd - mt - t1 * (nurse_skillmix - m1) - t2 * (ri_initial - m2) AS rt, delta_ri - my - y1 * (nurse_skillmix - m1) - y2 * (ri_initial - m2) AS ry FROM v_cohort, e_m, e_k),
f_g AS (SELECT 1 AS f, x1 AS v, sum(rt*rt) AS a, sum(rt*ry) AS b, count(*) AS n FROM f_x GROUP BY x1 UNION ALL SELECT 2, x2, sum(rt*rt), sum(rt*ry), count(*) FROM f_x GROUP BY x2),
f_c AS (SELECT f, v, sum(a) OVER l AS la, sum(b) OVER l AS lb, sum(n) OVER l AS ln, sum(a) OVER w AS ta, sum(b) OVER w AS tb, sum(n) OVER w AS tn FROM f_g WINDOW l AS (PARTITION BY f ORDER BY v), w AS (PARTITION BY f)),
f_b AS (SELECT * FROM f_c WHERE ln >= 1000 AND tn - ln >= 1000 ORDER BY lb*lb/la + (tb-lb)*(tb-lb)/(ta-la) DESC, f, v LIMIT 1)"""


@query("forest_split", f"{SPLIT_SQL} SELECT row_id, {rnd('CASE WHEN CASE f WHEN 1 THEN x1 ELSE x2 END <= v THEN lb / la ELSE (tb - lb) / (ta - la) END', 'effect')} FROM f_x, f_b")
def _(t: Tables) -> DataFrame:
    """One tree of one level over all rows: the best split of the effect and the effect on either side."""
    spec = X.CausalSpec(SPEC.treatment, SPEC.outcome, SPEC.confounders, ("nurse_skillmix", "ri_initial"))
    forest = E.fit_forest(t.cohort, spec, E.ForestSpec(n_trees=1, depth=1, bins=64, min_leaf=1000, honest=False))
    return emit(E.forest_effects(t.cohort, forest).select("row_id", "effect"))


@query("forest_effects")
def _(t: Tables) -> DataFrame:
    """The forest at full size (400 trees) with the interval of each row's effect."""
    spec = X.CausalSpec(SPEC.treatment, SPEC.outcome, SPEC.confounders, ("nurse_skillmix", "ri_initial"), 5)
    forest = E.fit_forest(t.cohort, spec)
    return emit(E.effect_interval(E.forest_effects(t.cohort.select("row_id", *spec.modifiers), forest)).select("row_id", "effect", "lower", "upper"), digits=4)


@query("dml_effects_crossfit")
def _(t: Tables) -> DataFrame:
    spec = X.CausalSpec(SPEC.treatment, SPEC.outcome, SPEC.confounders, SPEC.modifiers, 5)
    return emit(X.effect_summary(X.dml_effects(t.cohort, spec)))


@query(
    "effect_summary",
    f"""WITH {dml_sql()} SELECT count(*) AS n, {rnd('avg(eff)', 'ate')}, {rnd('stddev_pop(eff)', 'std')}, {rnd('quantile_cont(eff, 0.5)', 'p50')}, {rnd('quantile_cont(eff, 0.75)', 'p75')}, {rnd('quantile_cont(eff, 0.9)', 'p90')} FROM e_eff""",
)
def _(t: Tables) -> DataFrame:
    return emit(X.effect_summary(X.dml_effects(t.cohort, SPEC)))


@query(
    "balance_smd",
    "WITH m AS (SELECT median(nurse_hppd) AS md FROM v_cohort) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS confounder, {rnd(f"(avg({c}) FILTER (WHERE nurse_hppd > md) - avg({c}) FILTER (WHERE nurse_hppd <= md)) / sqrt(0.5 * (var_pop({c}) FILTER (WHERE nurse_hppd > md) + var_pop({c}) FILTER (WHERE nurse_hppd <= md)))", 'smd')} FROM v_cohort, m"""
        for c in ("nurse_skillmix", "ri_initial")
    ),
)
def _(t: Tables) -> DataFrame:
    return emit(X.balance_smd(t.cohort, treatment="nurse_hppd", confounders=["nurse_skillmix", "ri_initial"]))


@query("placebo_effect", f"WITH {dml_sql('CAST(episode_id % 10 AS DOUBLE)')} SELECT {rnd('avg(eff)', 'placebo_ate')} FROM e_eff")
def _(t: Tables) -> DataFrame:
    rows = t.cohort.withColumn("baseline_value", (F.col("episode_id") % 10).cast("double"))
    return emit(X.placebo_effect(rows, SPEC, baseline="baseline_value"))


@query("bootstrap_ci")
def _(t: Tables) -> DataFrame:
    return emit(X.bootstrap_ci(t.cohort, SPEC, n=500))


E_SQL = "CASE WHEN exp(0.91 * {d}) >= 1 THEN exp(0.91 * {d}) ELSE 1 / exp(0.91 * {d}) END"


@query(
    "e_value",
    f"""WITH {dml_sql()}, s AS (SELECT avg(eff) AS ate, (SELECT stddev_pop(delta_ri) FROM v_cohort) AS sd FROM e_eff), r AS (SELECT *, {E_SQL.format(d='ate / sd')} AS rr, {E_SQL.format(d='(CASE WHEN abs(ate - 0.5) < abs(ate + 0.5) THEN ate - 0.5 ELSE ate + 0.5 END) / sd')} AS rb FROM s)
    SELECT {rnd('ate', 'ate')}, {rnd('sd', 'sd_y', 5)}, {rnd('rr', 'rr_equivalent')}, {rnd('rr + sqrt(rr * (rr - 1))', 'e_value')}, {rnd('rb', 'rr_equivalent_ci_bound')}, {rnd('rb + sqrt(rb * (rb - 1))', 'e_value_ci_bound')} FROM r""",
)
def _(t: Tables) -> DataFrame:
    eff = X.dml_effects(t.cohort, SPEC)
    row = eff.agg(F.avg("effect").alias("ate"), F.stddev_pop("delta_ri").alias("sd_y"))
    row = row.withColumn("lo", F.col("ate") - 0.5).withColumn("hi", F.col("ate") + 0.5)
    return emit(X.e_value(row, lower="lo", upper="hi").drop("lo", "hi"), sd_y=5)


@query("effect_drivers", f"WITH {dml_sql()} SELECT 'nurse_skillmix' AS feature, {rnd('avg(abs(h1 * a))', 'mean_abs')} FROM e_eff, e_th")
def _(t: Tables) -> DataFrame:
    return emit(X.effect_drivers(t.cohort, X.fit_effect(t.cohort, SPEC)))


POLICY_SQL = f"""{dml_sql()}, e_q AS (SELECT quantile_cont(nurse_hppd, 0.25) AS lo, quantile_cont(nurse_hppd, 0.75) AS hi, avg(eff) AS m FROM e_eff),
e_p AS (SELECT row_id, lo, hi, eff * (hi - lo) AS benefit, CAST(eff * (hi - lo) > 38 AS INTEGER) AS label FROM e_eff, e_q)"""


def labelled(t: Tables) -> DataFrame:
    return X.policy_labels(X.dml_effects(t.cohort, SPEC), treatment="nurse_hppd", threshold=38.0)


@query("policy_labels", f"WITH {POLICY_SQL} SELECT row_id, {rnd('lo', 'treatment_low')}, {rnd('hi', 'treatment_high')}, {rnd('benefit', 'benefit', 5)}, label AS policy_label FROM e_p")
def _(t: Tables) -> DataFrame:
    return emit(labelled(t).select("row_id", "treatment_low", "treatment_high", "benefit", "policy_label"), benefit=5)


@query("learn_policy")
def _(t: Tables) -> DataFrame:
    decided, rule = X.learn_policy(labelled(t), features=["nurse_skillmix", "ri_initial"])
    return emit(X.policy_value(decided).withColumn("rule_text", F.lit(rule)))


@query(
    "policy_robustness",
    f"""WITH {POLICY_SQL}, d AS (SELECT label, nurse_skillmix, delta_ri, benefit FROM (SELECT *, CAST(nurse_hppd > 30 AS DOUBLE) AS label, nurse_hppd / 2 AS benefit FROM v_cohort)),
    v AS (SELECT var_pop(label) AS v1, var_pop(nurse_skillmix) AS v2, covar_pop(label, nurse_skillmix) AS v12, covar_pop(label, delta_ri) AS c1, covar_pop(nurse_skillmix, delta_ri) AS c2, avg(benefit * label) AS g, stddev_pop(delta_ri) AS sd FROM d)
    SELECT {rnd('g', 'mean_gain', 5)}, {rnd('sd', 'sd_y', 5)}, {rnd(E_SQL.format(d='g / sd'), 'rr_equivalent', 5)}, {rnd(f"{E_SQL.format(d='g / sd')} + sqrt({E_SQL.format(d='g / sd')} * ({E_SQL.format(d='g / sd')} - 1))", 'e_value', 5)},
    {rnd('(v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12)', 'policy_ate', 5)} FROM v""".replace(f"WITH {POLICY_SQL}, d AS", "WITH d AS"),
)
def _(t: Tables) -> DataFrame:
    rows = t.cohort.withColumn("decision", (F.col("nurse_hppd") > 30).cast("double")).withColumn("benefit", F.col("nurse_hppd") / 2)
    return emit(X.policy_robustness(rows, decision="decision", outcome="delta_ri", confounders=["nurse_skillmix"]), digits=5)


@query("refute_effect")
def _(t: Tables) -> DataFrame:
    base = X.mean_effect(t.cohort, SPEC)
    parts = [X.refute_effect(t.cohort, SPEC, method=m, base=base) for m in ("random_common_cause", "placebo_treatment", "data_subset")]
    return emit(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "dag_sanity",
    """SELECT p_partkey AS spec_id, 'age' AS confounder FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'sev' FROM part WHERE p_partkey % 4 <> 1""",
)
def _(t: Tables) -> DataFrame:
    part, k = t.raw("part"), F.col("p_partkey")
    conf = part.select(k.alias("spec_id"), F.explode(F.array(F.lit("age"), F.lit("sev"))).alias("confounder"), F.lit("hppd").alias("treatment"), F.lit("delta").alias("outcome"))
    edge = lambda cond, a, b: part.filter(cond).select(k.alias("spec_id"), F.lit(a).alias("src"), F.lit(b).alias("dst"))
    edges = edge(k % 3 == 1, "age", "hppd").unionByName(edge(k % 3 == 2, "age", "delta")).unionByName(edge(k % 4 == 1, "sev", "delta")).unionByName(edge(k % 4 == 2, "sev", "age"))
    return X.dag_sanity(conf, edges)


VARS = [f"e{i}" for i in range(64)]


def vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(*[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(VARS)])


@query(
    "correlations",
    f"""WITH x AS (SELECT row_number() OVER () AS k, embedding AS v FROM embeddings), l AS (SELECT k, unnest(range(64)) AS i, unnest(list_transform(v, lambda x: CAST(x AS DOUBLE))) AS x FROM x)
    SELECT 'e' || CAST(a.i AS STRING) AS a, 'e' || CAST(b.i AS STRING) AS b, count(*) AS n, {rnd('corr(a.x, b.x)', 'r')} FROM l a JOIN l b ON a.k = b.k AND a.i < b.i GROUP BY a.i, b.i""",
)
def _(t: Tables) -> DataFrame:
    return emit(X.correlations(vectors(t), VARS))


@query("discover_dag")
def _(t: Tables) -> DataFrame:
    return X.discover_dag(vectors(t), VARS, alpha=0.05, forbid=[("e0", "e1")])


SCENARIOS = [
    X.Scenario("plus_one", delta_values=(("nurse_hppd", 1.0),)),
    X.Scenario("set_thirty", set_values=(("nurse_hppd", 30.0), ("nurse_skillmix", 0.05))),
]


@query(
    "what_if",
    f"""WITH {dml_sql()}, e_l AS ({LIN_SQL}), e_x AS (SELECT c.*, e.eff FROM (SELECT *, row_number() OVER (ORDER BY row_id, nurse_hppd, nurse_skillmix) AS rn FROM v_cohort) c JOIN
      (SELECT h0 + h1 * (nurse_skillmix - m1) AS eff, rn FROM (SELECT *, row_number() OVER (ORDER BY row_id, nurse_hppd, nurse_skillmix) AS rn FROM v_cohort), e_m, e_th) e USING (rn))
    SELECT 'plus_one' AS scenario, count(*) AS n_rows, {rnd(f'avg({PRED})', 'y_pred_base_mean', 5)}, {rnd('avg(eff)', 'ate_delta_outcome', 5)}, {rnd('avg(b0 + b1 * (nurse_hppd + 1) + b2 * nurse_skillmix)', 'y_pred_cf_mean', 5)},
     {rnd('avg(b0 + b1 * (nurse_hppd + 1) + b2 * nurse_skillmix) - 2.5', 'lower', 5)}, {rnd('avg(b0 + b1 * (nurse_hppd + 1) + b2 * nurse_skillmix) + 2.5', 'upper', 5)} FROM e_x, e_l
    UNION ALL SELECT 'set_thirty', count(*), {rnd(f'avg({PRED})', 'p', 5)}, {rnd('avg(eff * (30 - nurse_hppd))', 'e', 5)}, {rnd('avg(b0 + b1 * 30 + b2 * 0.05)', 'y', 5)}, {rnd('avg(b0 + b1 * 30 + b2 * 0.05) - 2.5', 'lo', 5)},
     {rnd('avg(b0 + b1 * 30 + b2 * 0.05) + 2.5', 'hi', 5)} FROM e_x, e_l""",
)
def _(t: Tables) -> DataFrame:
    out = X.what_if(t.cohort, treatment="nurse_hppd", effect=X.fit_effect(t.cohort, SPEC), model=linear(t), q_hat=2.5, scenarios=SCENARIOS)
    return emit(out, digits=5)
