"""Registered queries of the composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.tables import with_stats
from caretrace.operators import score as K
from caretrace.plans import windows as WP
from caretrace.plans.adapter import Tables
from caretrace.plans.base import emit, query, rnd, ts

FEATURES = ["nurse_hppd", "nurse_skillmix", "ri_initial"]

GOAL_SQL = "CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in C.OUTCOME_GOAL_RULES[0][0]) + " THEN 'higher_is_better' WHEN " + " OR ".join(
    f"contains(x, '{w}')" for w in C.OUTCOME_GOAL_RULES[1][0]
) + " THEN 'lower_is_better' ELSE 'higher_is_better' END"


@query(
    "infer_outcome_goal",
    f"""WITH n AS (SELECT p_partkey, lower(trim(CASE p_partkey % 6 WHEN 0 THEN ' Delta_RI ' WHEN 1 THEN 'Falls_' || p_name WHEN 2 THEN 'LOS ' || p_type WHEN 3 THEN 'recovery_infection' ELSE p_name END)) AS x FROM part)
    SELECT p_partkey, {GOAL_SQL} AS goal FROM n""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.lit(" Delta_RI "))
        .when(k == 1, F.concat(F.lit("Falls_"), "p_name"))
        .when(k == 2, F.concat(F.lit("LOS "), "p_type"))
        .when(k == 3, F.lit("recovery_infection"))
        .otherwise(F.col("p_name"))
    )
    return t.raw("part").select("p_partkey", K.infer_outcome_goal(name).alias("goal"))


@query(
    "utility",
    f"SELECT o_orderkey, {rnd('CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END', 'utility')} FROM orders",
)
def _(t: Tables) -> DataFrame:
    goal = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Higher_is_better ")).otherwise(F.lit("lower_is_better"))
    return emit(t.raw("orders").select("o_orderkey", K.utility(F.col("o_totalprice"), goal).alias("utility")))


def z_sql(col: str, ref: str) -> str:
    """Scalar CTE body with centre and scale of ``col`` over ``ref``."""
    return f"""SELECT m, CASE WHEN n >= 5 AND mad * 1.4826 > 1e-6 THEN mad * 1.4826 WHEN sd > 1e-6 THEN sd ELSE 1.0 END AS s FROM
 (SELECT median({col}) AS m, mad({col}) AS mad, stddev_pop({col}) AS sd, count({col}) AS n FROM {ref})"""


@query(
    "robust_z",
    f"""WITH z AS ({z_sql('delta_ri', '(SELECT * FROM v_feat WHERE nurse_skillmix < 0.08)')}), z2 AS ({z_sql('missing_vs_hr_last', 'v_feat')})
    SELECT row_id, {rnd('CASE WHEN delta_ri IS NOT NULL THEN least(greatest((delta_ri - z.m) / z.s, -4), 4) END', 'z')}, {rnd('least(greatest((missing_vs_hr_last - z2.m) / z2.s, -4), 4)', 'z2')}, 'robust_z' AS z_method, 'std_z_fallback' AS z2_method FROM v_feat, z, z2""",
)
def _(t: Tables) -> DataFrame:
    reference = t.feat.filter(F.col("nurse_skillmix") < 0.08)
    out = K.robust_z(t.feat, reference, column="delta_ri")
    out = K.robust_z(out, t.feat, column="missing_vs_hr_last", out="z2")
    return emit(out.select("row_id", "z", "z2", "z_method", "z2_method"))


MISS = ["missing_vs_hr_last", "missing_loinc_8867_4", "missing_loinc_85556_9_t0", "missing_loinc_85556_9_t1"]
BURDEN = "(" + " + ".join(f"coalesce({c}, 0)" for c in MISS) + ") / 4"


@query("missingness_burden", f"SELECT row_id, {rnd(BURDEN, 'missingness')} FROM v_feat")
def _(t: Tables) -> DataFrame:
    return emit(t.feat.select("row_id", K.missingness_burden(t.feat.columns).alias("missingness")))


DOC = "CASE WHEN nurse_proc_count > 0 THEN least(nurse_proc_count_det / nurse_proc_count, 1) END"
TIMELY = "1 - (missing_loinc_85556_9_t0 + missing_loinc_85556_9_t1) / 2"
QUALITY = f"CASE WHEN nurse_proc_count > 0 THEN (1 - {BURDEN} + {DOC} + {TIMELY}) / 3 ELSE (1 - {BURDEN} + {TIMELY}) / 2 END"


@query(
    "process_quality",
    f"SELECT row_id, {rnd(QUALITY, 'quality')}, {rnd(DOC, 'documentation')}, {rnd(TIMELY, 'timeliness')}, {rnd(f'CASE WHEN nurse_proc_count > 0 THEN {QUALITY} END', 'strict')} FROM v_feat",
)
def _(t: Tables) -> DataFrame:
    quality, parts = K.process_quality(t.feat.columns)
    strict, _ = K.process_quality(t.feat.columns, K.ScoreSpec(min_quality_parts=3))
    return emit(
        t.feat.select(
            "row_id",
            quality.alias("quality"),
            parts["documentation_consistency"].alias("documentation"),
            parts["timeliness"].alias("timeliness"),
            strict.alias("strict"),
        )
    )


def drift_stats(df: DataFrame, features=FEATURES) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


OOD = " + ".join(f"least(greatest((abs({f} - s.m_{f}) / s.s_{f} - 0.5) / 0.5, 0), 1)" for f in FEATURES)
STATS_SQL = "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM v_feat"


@query("ood_burden", f"WITH s AS ({STATS_SQL}) SELECT row_id, {rnd(f'({OOD}) / 3', 'ood')} FROM v_feat, s")
def _(t: Tables) -> DataFrame:
    spec = K.ScoreSpec(ood_z_threshold=0.5)
    out = with_stats(t.feat, drift_stats(t.feat), "_d")
    return emit(out.select("row_id", K.ood_burden(FEATURES, "_d", t.feat.columns, spec).alias("ood")))


@query(
    "conformal_burden",
    f"""WITH s AS (SELECT stddev_pop(delta_ri) AS sd FROM v_feat)
    SELECT s_suppkey, {rnd('CASE WHEN s_suppkey % 6 <> 0 THEN least(abs(s_acctbal) / 200.0 * 2 / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END, 1) END', 'conformal')} FROM supplier, s""",
)
def _(t: Tables) -> DataFrame:
    q_hat = F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal") / 200.0)
    out = with_stats(t.raw("supplier"), t.feat.agg(F.stddev_pop("delta_ri").alias("sd")), "_d")
    return emit(out.select("s_suppkey", K.conformal_burden(q_hat, F.col("_d.sd")).alias("conformal")))


@query(
    "low_support_burden",
    f"""WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linenumber = 1) AS n, count(*) FILTER (WHERE l_linenumber = 2 AND l_tax < 0.03) AS m FROM lineitem GROUP BY 1)
    SELECT s_suppkey, {rnd('greatest((100.0 - coalesce(n, 0)) / 100.0, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE (30.0 - coalesce(m, 0)) / 30.0 END, 0)', 'low_support')} FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey""",
)
def _(t: Tables) -> DataFrame:
    counts = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("n"), F.count_if((F.col("l_linenumber") == 2) & (F.col("l_tax") < 0.03)).alias("m")
    )
    joined = t.raw("supplier").join(counts, "s_suppkey", "left")
    causal = F.when(F.col("s_suppkey") % 5 != 0, F.coalesce("m", F.lit(0)))
    return emit(joined.select("s_suppkey", K.low_support_burden(F.col("n"), causal).alias("low_support")))


@query(
    "combine_uncertainty",
    f"""SELECT o_orderkey, {rnd('(least(o_totalprice / 4e5, 1) * .35 + (o_orderkey % 10) / 10.0 * .35 + (o_orderkey % 4) / 4.0 * .2 + .5 * .1) / 1.0', 'u_all')},
    {rnd('((o_orderkey % 10) / 10.0 * .35 + (CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 4) / 4.0 END) * .2) / .55', 'u_part')} FROM orders""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    full = {"conformal_width": F.col("o_totalprice") / 4e5, "missingness": (k % 10) / 10.0, "ood": (k % 4) / 4.0, "low_support": F.lit(0.5)}
    part = {"conformal_width": None, "missingness": (k % 10) / 10.0, "ood": F.when(k % 7 != 0, (k % 4) / 4.0), "low_support": None}
    return emit(t.raw("orders").select("o_orderkey", K.combine_uncertainty(full).alias("u_all"), K.combine_uncertainty(part).alias("u_part")))


@query(
    "severity_weight",
    f"""WITH z AS ({z_sql('-delta_ri', 'v_feat')}) SELECT row_id, {rnd('CASE WHEN delta_ri IS NOT NULL THEN 1 + least(greatest(least(greatest((-delta_ri - z.m) / z.s, -4), 4), 0), 2) END', 'severity_weight')} FROM v_feat, z""",
)
def _(t: Tables) -> DataFrame:
    out = K.severity_weight(t.feat, t.feat, column="delta_ri", goal="higher_is_better")
    return emit(out.select("row_id", "severity_weight"))


@query(
    "relative_attribution",
    f"""WITH s AS ({STATS_SQL}), a AS (SELECT row_id, 0.4 * (nurse_hppd - s.m_nurse_hppd) AS a1, -30 * (nurse_skillmix - s.m_nurse_skillmix) AS a2, 50 * (ri_initial - s.m_ri_initial) AS a3 FROM v_feat, s)
    SELECT row_id, {rnd('(a1 + a2) / (abs(a1) + abs(a2) + abs(a3) + 1e-6)', 'attribution')} FROM a""",
)
def _(t: Tables) -> DataFrame:
    beta = {"nurse_hppd": 0.4, "nurse_skillmix": -30.0, "ri_initial": 50.0}
    out = with_stats(t.feat, drift_stats(t.feat), "_d")
    parts = {f: F.lit(b) * (F.col(f) - F.col(f"_d.{f}_mean")) for f, b in beta.items()}
    return emit(out.select("row_id", K.relative_attribution(parts, ["nurse_hppd", "nurse_skillmix", "absent"]).alias("attribution")))


@query(
    "benefit",
    f"SELECT row_id, {rnd('delta_ri - nurse_hppd', 'higher')}, {rnd('nurse_hppd - delta_ri', 'lower')} FROM v_feat",
)
def _(t: Tables) -> DataFrame:
    y, b = F.col("delta_ri"), F.col("nurse_hppd")
    return emit(t.feat.select("row_id", K.benefit(y, b, "higher_is_better").alias("higher"), K.benefit(y, b, "lower_is_better").alias("lower")))


@query(
    "row_score",
    f"SELECT row_id, status, status = 'provisional' AS provisional, {rnd('raw_score', 'raw_score', 9)}, {rnd('score', 'score', 9)}, array_to_string(warnings, '|') AS warnings FROM v_rowscore",
)
def _(t: Tables) -> DataFrame:
    return emit(K.row_score(t.components).select("row_id", "status", "provisional", "raw_score", "score", "warnings"), raw_score=9, score=9)


@query(
    "row_confidence",
    f"SELECT row_id, {rnd('confidence', 'confidence')}, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_label FROM v_rowscore",
)
def _(t: Tables) -> DataFrame:
    return emit(K.row_score(t.components).select("row_id", "confidence", "confidence_label"))


@query(
    "row_flags",
    """SELECT row_id, row_id % 12 = 0 AS flag_low_support, row_id % 14 = 0 AS flag_ood_detected, high AS flag_high_uncertainty, blocked AS flag_missing_key_inputs, causal IS NOT NULL AS flag_causal_available,
    array_to_string(list_sort(list_distinct(list_concat(warnings, CASE WHEN row_id % 12 = 0 THEN ['low_support'] ELSE [] END, CASE WHEN row_id % 14 = 0 THEN ['ood_detected'] ELSE [] END))), '|') AS warnings FROM v_rowscore""",
)
def _(t: Tables) -> DataFrame:
    out = K.row_flags(K.row_score(t.components), low_support="low_support_burden", ood="ood_burden")
    flags = [f"flag_{f}" for f in ("low_support", "ood_detected", "high_uncertainty", "missing_key_inputs", "causal_available")]
    return emit(out.select("row_id", *flags, "warnings"))


SHARES_SQL = """
WITH p AS (SELECT w.episode_id, w.window_index, coalesce(p.performer_actor_ref, '') AS a, count(*) AS n FROM v_window w JOIN v_proc p ON p.episode_id = w.episode_id
  AND p.performed_dt >= w.start_dt AND p.performed_dt < w.end_dt WHERE p.is_nursing GROUP BY ALL
  UNION ALL SELECT episode_id, -1, coalesce(performer_actor_ref, ''), count(*) FROM v_proc WHERE is_nursing GROUP BY ALL),
s AS (SELECT episode_id, window_index, sum(n) AS t, sum(n) FILTER (WHERE a <> '') AS k FROM p GROUP BY ALL)
SELECT episode_id, window_index, a AS actor, {share}, {rel} FROM p JOIN s USING (episode_id, window_index) WHERE a <> ''""".format(
    share=rnd("n / t", "share"), rel=rnd("coalesce(k, 0) / t", "reliability")
)


@query("staff_shares", SHARES_SQL)
def _(t: Tables) -> DataFrame:
    from caretrace.functions.intervals import points_in_intervals

    w = WP.windows(t).select("episode_id", "window_index", "start_dt", "end_dt")
    inside = points_in_intervals(t.procedures, w, key="episode_id", ts="performed_dt", start="start_dt", end="end_dt")
    by_window = K.staff_shares(inside, ids=["episode_id", "window_index"])
    by_episode = K.staff_shares(t.procedures, ids=["episode_id"]).withColumn("window_index", F.lit(-1))
    both = by_window.unionByName(by_episode)
    return emit(both.select("episode_id", "window_index", F.explode("staff_shares").alias("actor", "share"), F.col("staff_reliability").alias("reliability")))


@query(
    "select_cohort",
    """WITH r AS (SELECT row_id, episode_id, start_dt, end_dt FROM v_feat WHERE start_dt >= TIMESTAMP '1997-01-01' AND end_dt <= TIMESTAMP '1999-06-30' AND unit_id = 7)
    SELECT 'reference' AS cohort, row_id FROM r UNION ALL SELECT 'selected', row_id FROM r WHERE episode_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t: Tables) -> DataFrame:
    options = {"grain": "window", "unit_id": 7, "date_from": "1997-01-01 00:00:00", "date_to": "1999-06-30 00:00:00"}
    _, reference = K.select_cohort(t.feat, **options)
    urgent = t.raw("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("episode_id"))
    selected = reference.join(urgent, "episode_id", "left_semi")
    pick = lambda df, name: df.select(F.lit(name).alias("cohort"), "row_id")
    return pick(reference, "reference").unionByName(pick(selected, "selected"))


@query(
    "normalize_external_rows",
    f"""SELECT k AS idx, row_id, coalesce(CASE WHEN k % 5 = 0 THEN 'pk' END, CASE WHEN k % 4 <> 0 THEN 'e' || CAST(o_custkey AS STRING) END, 'row:' || CAST(k AS STRING)) AS patient_key,
    {ts('CASE WHEN k % 2 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate END', 'start_dt')}, {ts('o_orderdate', 'end_dt')},
    {rnd('o_totalprice / 3e5', 'ri_initial', 9)}, CASE WHEN k % 11 = 0 THEN 1.0 ELSE 0.0 END AS missing_ri_initial, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS missing_gcs, 0.0 AS staff_reliability,
    CASE WHEN k % 6 = 1 THEN 5 ELSE 6 END AS n_entries FROM v_ext""",
)
def _(t: Tables) -> DataFrame:
    out = K.normalize_external_rows(t.external, index="idx")
    at = lambda n: F.try_element_at("features", F.lit(n)).alias(n)
    cols = [at("ri_initial"), at("missing_ri_initial"), at("missing_gcs"), "staff_reliability", F.size("features").alias("n_entries")]
    return emit(out.select("idx", "row_id", "patient_key", "start_dt", "end_dt", *cols), ri_initial=9)


PRIMARY = K.FeatureContract(("ri_initial", "nurse_hppd", "proc_count", "nurse_skillmix"), "v1", "feeds", "episode", ("ri_initial", "proc_count"), 0.8)
BASELINE = K.FeatureContract(("ri_initial", "age"), "v1", "feeds", "episode", ("ri_initial",), 0.8, "baseline")


@query(
    "feature_contract",
    f"""SELECT row_id, status AS contract_status, array_to_string(warnings, '|') AS contract_warnings, {rnd('CASE WHEN gap THEN 0.75 ELSE 1.0 END', 'coverage')},
    CASE WHEN gap THEN 'nurse_skillmix' ELSE '' END AS missing_features, array_to_string(critical, '|') AS missing_critical, hard AS flag_missing_key_inputs FROM v_issue WHERE status IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    out = K.feature_contract(t.external, PRIMARY, index="idx")
    return emit(out.select("row_id", "contract_status", "contract_warnings", "coverage", "missing_features", "missing_critical", "flag_missing_key_inputs"))


MERGE_SQL = f"""
WITH b AS (SELECT row_id, CASE WHEN len(ctx) > 0 OR k % 11 = 0 THEN 'contract_mismatch' ELSE 'low_feature_coverage' END AS status,
  CASE WHEN len(ctx) > 0 THEN ctx WHEN k % 11 = 0 THEN ['model_feature_space_mismatch'] ELSE ['low_feature_coverage'] END AS warnings FROM v_ext),
r AS (SELECT *, CASE status WHEN 'contract_mismatch' THEN 3 WHEN 'insufficient_evidence' THEN 2 ELSE 1 END AS rank FROM (SELECT row_id, status, warnings FROM v_issue WHERE status IS NOT NULL UNION ALL SELECT * FROM b))
SELECT r.row_id, arg_max(r.status, rank) AS contract_status, array_to_string(list_sort(list_distinct(flatten(list(r.warnings)))), '|') AS contract_warnings, 0.5 AS coverage,
 CASE WHEN any_value(i.gap) AND any_value(i.status) IS NOT NULL THEN 'age|nurse_skillmix' ELSE 'age' END AS missing_features,
 CASE WHEN any_value(i.status) IS NOT NULL THEN 'baseline|primary' ELSE 'baseline' END AS model_roles FROM r JOIN v_issue i USING (row_id) GROUP BY r.row_id"""


def both_issues(t: Tables) -> DataFrame:
    return K.feature_contract(t.external, PRIMARY, index="idx").unionByName(K.feature_contract(t.external, BASELINE, index="idx"))


@query("merge_contract_issues", MERGE_SQL)
def _(t: Tables) -> DataFrame:
    out = K.merge_contract_issues(both_issues(t))
    return emit(out.select("row_id", "contract_status", "contract_warnings", "coverage", "missing_features", "model_roles"))


BLOCK_SQL = """
WITH ref AS (SELECT list_sort(list_distinct(flatten(list(warnings)))) AS w FROM v_issue WHERE status IS NOT NULL AND k % 2 = 0),
bat AS (SELECT arg_min(warnings, CASE WHEN status = 'contract_mismatch' THEN 0 WHEN status = 'insufficient_evidence' THEN 1e9 ELSE 2e9 END + k) AS w FROM v_issue WHERE status IS NOT NULL)
SELECT 'reference' AS mode, row_id, coalesce(status, 'blocked_by_reference_contract') AS status,
 array_to_string(coalesce(warnings, list_sort(list_distinct(list_concat(ref.w, ['blocked_by_reference_contract', 'scoring_blocked_by_reference_rows_contract_failure'])))), '|') AS warnings FROM v_issue, ref
UNION ALL SELECT 'batch', row_id, coalesce(status, 'contract_mismatch'), array_to_string(coalesce(warnings, list_sort(list_concat(bat.w, ['scoring_blocked_by_batch_contract_failure']))), '|') FROM v_issue, bat"""


@query("block_by_reference_or_batch", BLOCK_SQL)
def _(t: Tables) -> DataFrame:
    issues = K.feature_contract(t.external, PRIMARY, index="idx")
    reference = issues.filter(F.col("idx") % 2 == 0)
    a = K.block_by_reference_or_batch(t.external, issues, reference, index="idx").withColumn("mode", F.lit("reference"))
    b = K.block_by_reference_or_batch(t.external, issues, reference.filter(F.lit(False)), index="idx").withColumn("mode", F.lit("batch"))
    return emit(a.unionByName(b))


@query(
    "score_summary",
    f"""SELECT count(*) AS rows_requested, count(score) AS rows_scored, count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'provisional') AS n_provisional,
    count(*) FILTER (WHERE status = 'insufficient_evidence') AS n_insufficient_evidence, {', '.join(rnd(f'avg({c}) FILTER (WHERE score IS NOT NULL)', f'mean_{c}') for c in C.COMPONENTS)},
    (SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT unnest(warnings) AS w FROM v_rowscore)) AS warnings FROM v_rowscore""",
)
def _(t: Tables) -> DataFrame:
    return emit(K.score_summary(K.row_score(t.components)))


REDACT_SQL = """SELECT row_id, 'episode' AS grain, episode_id, CASE WHEN score IS NOT NULL THEN 'shadow_only' ELSE status END AS status, status = 'provisional' AS provisional, CAST(NULL AS DOUBLE) AS score,
 true AS score_suppressed, array_to_string(warnings, '|') AS warnings, causal IS NOT NULL AS flag_causal_available, low AS flag_low_support, high AS flag_high_uncertainty, blocked AS flag_missing_key_inputs,
 true AS shadow_mode, true AS non_individual_use, 'shadow_aggregate_research' AS intended_use FROM v_rowscore"""


@query("redact_rows", REDACT_SQL)
def _(t: Tables) -> DataFrame:
    return emit(K.redact_rows(K.redact_rows(K.row_score(t.components))))


@query(
    "redact_summary",
    """SELECT count(*) AS rows_requested, count(score) AS rows_scored, count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'provisional') AS n_provisional,
    count(*) FILTER (WHERE status = 'insufficient_evidence') AS n_insufficient_evidence, (SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT unnest(warnings) AS w FROM v_rowscore)) AS warnings,
    true AS summary_redacted, 'non_individual_shadow_mode' AS redaction_reason FROM v_rowscore""",
)
def _(t: Tables) -> DataFrame:
    return emit(K.redact_summary(K.score_summary(K.row_score(t.components))))
