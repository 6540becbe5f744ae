"""Registered queries of reports, fairness, follow-up, audit and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.operators import audit as L
from caretrace.operators import followup as U
from caretrace.operators import model as M
from caretrace.operators import report as R
from caretrace.operators import scoring as SC
from caretrace.operators import windows as W
from caretrace.plans import windows as WP
from caretrace.plans.adapter import AS_OF, Tables
from caretrace.plans.base import emit, query, rnd, ts
from caretrace.plans.governance import W_SQL
from caretrace.session import cut_lineage, shared_root
from caretrace.streaming import streams as S


def shared_folder(t: Tables, name: str) -> str:
    return f"{shared_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- fairness --------------------------------------------------------------------------------


def judged_documents(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", "lang", "source", "n_chars").join(t.raw("labels"), "doc_id")


IMPACT_SQL = f"""
WITH d AS (SELECT lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id)),
a AS (SELECT 'lang' AS sensitive_feature, lang AS g, quality FROM d UNION ALL SELECT 'source', source, quality FROM d),
r AS (SELECT sensitive_feature, g, count(*) AS n, avg(quality) AS rate FROM a GROUP BY ALL HAVING count(*) >= 25)
SELECT sensitive_feature, g AS "group", n, {rnd('rate', 'selection_rate')},
 {rnd('CASE WHEN count(*) OVER (PARTITION BY sensitive_feature) >= 2 AND max(rate) OVER (PARTITION BY sensitive_feature) > 0 THEN min(rate) OVER (PARTITION BY sensitive_feature) / max(rate) OVER (PARTITION BY sensitive_feature) END', 'disparate_impact_ratio')} FROM r"""


@query("disparate_impact", IMPACT_SQL)
def _(t: Tables) -> DataFrame:
    return emit(R.disparate_impact(judged_documents(t), decision="quality", sensitive=["lang", "source"]))


@query(
    "age_bands",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'nan' WHEN p_size * 2 <= 17 THEN '<=17' WHEN p_size * 2 <= 39 THEN '18-39' WHEN p_size * 2 <= 64 THEN '40-64' WHEN p_size * 2 <= 79 THEN '65-79' ELSE '80+' END AS band FROM part""",
)
def _(t: Tables) -> DataFrame:
    age = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") * 2).cast("string")).otherwise(F.lit("old"))
    return t.raw("part").select("p_partkey", R.age_bands(age).alias("band"))


@query(
    "group_fairness_metrics",
    f"""WITH d AS (SELECT lang, CAST(n_chars >= (SELECT median(n_chars) FROM documents JOIN labels USING (doc_id)) AS INTEGER) AS y, CAST(quality >= (SELECT median(quality) FROM labels JOIN documents USING (doc_id)) AS INTEGER) AS l FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT lang, avg(y) AS rate, avg(y) FILTER (WHERE l = 1) AS tpr, avg(y) FILTER (WHERE l = 0) AS fpr FROM d GROUP BY 1)
    SELECT 'lang' AS sensitive_feature, {rnd('min(rate) / max(rate)', 'demographic_parity_ratio')}, {rnd('max(rate) - min(rate)', 'demographic_parity_difference')},
    {rnd('greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))', 'equalized_odds_difference')} FROM g""",
)
def _(t: Tables) -> DataFrame:
    return emit(R.group_fairness_metrics(judged_documents(t), decision="n_chars", label="quality", sensitive="lang"))


# --- eligibility, exclusions, report ---------------------------------------------------------

CRITERIA = [
    {"description": "busy enough", "expression": {"all": [{"field": "nurse_hppd", "op": ">=", "value": 5}, {"not": {"field": "delta_ri", "op": "<", "value": 2}}]}},
    {"description": "text rule", "expression": "nurse_hppd > 3"},
    {"description": "not low", "expression": {"any": [{"field": "nurse_skillmix", "op": "between", "min": 0.02, "max": 0.09}, {"field": "delta_ri", "op": "not_exists"}]}},
    {"description": "unknown", "expression": {"field": "weight", "op": ">", "value": 1}},
    {"description": "counts", "expression": {"all": [{"field": "nurse_proc_count", "op": "in", "value": [0.0, 1.0, 2.0]}, {"field": "delta_ri", "op": "!=", "value": 1.0}]}},
]
M1 = "nurse_hppd >= 5 AND NOT coalesce(delta_ri < 2, false)"
M2 = f"{M1} AND (nurse_skillmix BETWEEN 0.02 AND 0.09 OR delta_ri IS NULL)"
M3 = f"{M2} AND nurse_proc_count IN (0, 1, 2)"
N_OF = lambda m: f"(SELECT count(*) FROM v_feat WHERE {m})"
STAGES = [
    (1, "busy enough", None, "true", M1),
    (2, "text rule", "expression_string_not_executed", M1, M1),
    (3, "not low", None, M1, M2),
    (4, "unknown", "unknown_field:weight", M2, M2),
    (5, "counts", None, M2, M3),
]


@query(
    "eligibility_filter",
    " UNION ALL ".join(
        f"SELECT {i} AS stage, '{d}' AS description, {'true' if e is None else 'false'} AS supported, {'NULL' if e is None else repr(e)} AS error, {N_OF(a)} AS n_before, {N_OF(b)} AS n_after, {N_OF(a)} - {N_OF(b)} AS excluded"
        for i, d, e, a, b in STAGES
    ),
)
def _(t: Tables) -> DataFrame:
    return emit(R.eligibility_filter(t.feat, CRITERIA)[1])


@query("eligible_rows", f"SELECT row_id, {rnd('nurse_hppd', 'nurse_hppd')} FROM v_feat WHERE {M3}")
def _(t: Tables) -> DataFrame:
    return emit(R.eligibility_filter(t.feat, CRITERIA)[0].select("row_id", "nurse_hppd"))


REQUIRED = ["vs_hr_last", "delta_ri"]
GONE = "(missing_vs_hr_last = 1 OR missing_loinc_85556_9_t0 = 1 OR missing_loinc_85556_9_t1 = 1)"


def reasons_sql(where: str = "true") -> str:
    rows = [("missing_vs_hr_last", "", "", ""), ("missing_loinc_85556_9_t0", C.ACUITY_CODE, C.LOINC_DISPLAY[C.ACUITY_CODE], "t0"), ("missing_loinc_85556_9_t1", C.ACUITY_CODE, C.LOINC_DISPLAY[C.ACUITY_CODE], "t1")]
    return " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) AS excluded, '{c}' AS code, '{d}' AS display, '{w}' AS \"where\" FROM v_feat WHERE {f} = 1 AND {where}" for f, c, d, w in rows
    )


@query("missingness_exclusions", reasons_sql())
def _(t: Tables) -> DataFrame:
    return emit(R.missingness_exclusions(t.feat, required=REQUIRED)[1])


@query(
    "component_reasons",
    f"""WITH c AS ({WP.COMPONENT_SQL}), g AS (SELECT code, anchor AS "where", count(*) AS excluded FROM c WHERE missing = 1 GROUP BY ALL)
    SELECT code, "where", excluded, d.display FROM g JOIN (VALUES {', '.join(f"('{c}', '{d}')" for c, d in C.LOINC_DISPLAY.items())}) d(code, display) USING (code) ORDER BY excluded DESC, code, "where" LIMIT 60""",
)
def _(t: Tables) -> DataFrame:
    target = WP.target(t)
    long = WP.W.component_missingness(target, t.observations, tol_minutes=720)
    return emit(R.component_reasons_long(target.filter("missing_delta_ri = 1").select("episode_id", "window_index"), long))


def severity_sql(x: str, n: str) -> str:
    return f"CASE WHEN {x} >= 50 OR {x} / {n} >= 0.25 THEN 'critical' WHEN {x} >= 10 OR {x} / {n} >= 0.1 THEN 'high' WHEN {x} >= 3 OR {x} / {n} >= 0.03 THEN 'medium' ELSE 'low' END"


@query(
    "quality_playbook",
    f"""WITH r AS ({reasons_sql(M3)}), n AS (SELECT count(*) AS n FROM v_feat WHERE {M3})
    SELECT 'missingness' AS stage, code, display, "where", excluded, {severity_sql('excluded', 'n')} AS severity, 'Clinical Informatics / Data Steward' AS owner_role FROM r, n WHERE code <> '' AND excluded > 0
    UNION ALL SELECT 'eligibility_stage_2', 'eligibility_expression', 'text rule', '', 0, 'medium', 'Data Engineer / Epidemiology' UNION ALL SELECT 'eligibility_stage_4', 'eligibility_expression', 'unknown', '', 0, 'medium', 'Data Engineer / Epidemiology'""",
)
def _(t: Tables) -> DataFrame:
    eligible, stages = R.eligibility_filter(t.feat, CRITERIA)
    _, reasons = R.missingness_exclusions(eligible, required=REQUIRED)
    n = eligible.agg(F.count(F.lit(1)).alias("n"))
    return emit(R.quality_playbook(reasons, stages, n_before=n.scalar()).drop("action"))


FLOW_SQL = f"""SELECT count(*) AS assessed, count(*) FILTER (WHERE {M3}) AS eligible, count(*) FILTER (WHERE NOT ({M3})) AS excluded_eligibility, count(*) FILTER (WHERE {M3} AND {GONE}) AS excluded_missingness,
 count(*) FILTER (WHERE {M3} AND NOT {GONE}) AS included, (SELECT CAST(unit_id AS STRING) FROM v_feat GROUP BY unit_id ORDER BY count(*) DESC, unit_id LIMIT 1) AS unit_hint FROM v_feat"""


@query("consort_flow", FLOW_SQL)
def _(t: Tables) -> DataFrame:
    return emit(R.consort_flow(t.feat, CRITERIA, required=REQUIRED))


@query("trial_report")
def _(t: Tables) -> DataFrame:
    closing = t.feat.agg(F.round(F.avg("delta_ri"), 6).alias("ate"))
    return R.trial_report(t.feat, CRITERIA, treatment="nurse_hppd", outcome="delta_ri", required=REQUIRED, closing=closing)


@query(
    "federated_weights",
    f"""WITH u AS (SELECT s_nationkey AS round_id, s_suppkey AS client_id, CASE WHEN s_nationkey = 3 THEN 0 ELSE coalesce(n, 0) END AS n_rows FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey WHERE s_suppkey % 5 <> 0)
    SELECT CAST(round_id AS BIGINT) AS round_id, client_id, n_rows, CAST(sum(n_rows) OVER (PARTITION BY round_id) AS BIGINT) AS total_rows, {rnd('n_rows / greatest(sum(n_rows) OVER (PARTITION BY round_id), 1)', 'weight')} FROM u""",
)
def _(t: Tables) -> DataFrame:
    counts = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    updates = t.raw("supplier").join(counts, "s_suppkey", "left").select(
        F.col("s_nationkey").alias("round_id"), F.col("s_suppkey").alias("client_id"), F.when(F.col("s_nationkey") == 3, F.lit(0)).otherwise(F.col("n")).alias("n_rows"), (F.col("s_suppkey") % 5 != 0).alias("accepted")
    )
    return emit(R.federated_weights(updates).select("round_id", "client_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "total_rows", "weight"))


# --- follow-up -------------------------------------------------------------------------------


def scored_results(t: Tables) -> DataFrame:
    k = F.col("row_id")
    return t.scored.select(
        F.col("row_id").alias("record_id"),
        "episode_id",
        F.lit("m1").alias("model_id"),
        F.lit("v1").alias("formula_version"),
        F.lit("h").alias("formula_hash"),
        F.when(k % 13 == 0, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        "warnings",
        "staff_shares",
        F.when(k % 3 == 0, F.lit(0.5)).otherwise(F.lit(0.9)).alias("staff_reliability"),
    )


STATE_SQL = "CASE WHEN row_id % 13 = 0 THEN 'failed' WHEN status = 'provisional' THEN 'immediate_provisional' WHEN status = 'complete' THEN 'complete' ELSE 'insufficient_evidence' END"


@query(
    "initial_followup",
    f"""SELECT row_id AS record_id, {STATE_SQL} AS initial_state, CASE WHEN {STATE_SQL} IN ('failed', 'insufficient_evidence') THEN {STATE_SQL} ELSE 'pending_followup' END AS followup_status, {STATE_SQL} AS current_state,
    array_to_string(list_sort(list_distinct(list_concat(warnings, ['non_individual_use_team_or_unit_only'], CASE WHEN row_id % 3 = 0 OR staff IS NULL THEN ['low_support'] ELSE [] END))), '|') AS warnings FROM v_scored WHERE row_id % 8 <> 0""",
)
def _(t: Tables) -> DataFrame:
    rows = scored_results(t)
    existing = rows.filter(F.col("record_id") % 8 == 0)
    return emit(U.initial_followup(rows, existing).select("record_id", "initial_state", "followup_status", "current_state", "warnings"))


def followup_records(t: Tables) -> DataFrame:
    e, k = t.episodes, F.col("episode_id")
    ten_days = F.expr("INTERVAL '240' HOUR")
    return e.select(
        (k * 10).alias("record_id"),
        "episode_id",
        F.lit("m1").alias("model_id"),
        F.when(k % 7 != 0, F.when(k % 3 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).otherwise(F.col("admission") + ten_days)).alias("base_time"),
        "discharge",
        (k % 4 == 0).alias("has_target"),
        F.when(k % 9 == 0, F.lit("los")).otherwise(F.lit("delta_ri")).alias("target"),
        F.when(k % 5 == 0, F.lit("new")).when(k % 5 == 1, F.lit("")).otherwise(F.lit("old")).alias("snapshot_hash"),
        F.lit("old").alias("stored_hash"),
        (k % 6 == 0).alias("enriched"),
        F.when(k % 6 == 0, F.col("admission")).alias("last_rescore_at"),
        F.when(k % 2 == 0, F.create_map(F.lit("n"), F.lit(1.0))).alias("staff_shares"),
        F.lit(0.9).alias("staff_reliability"),
    )


def evidence(t: Tables) -> dict[str, DataFrame]:
    written = t.raw("events").filter(F.col("event_id") % 37 == 0).select(F.col("user_id").alias("episode_id"), F.lit("m1").alias("model_id"), F.col("ts").alias("created_at"))
    return {
        "observations": t.observations,
        "procedures": t.procedures,
        "windows": WP.windows(t).select("episode_id", "end_dt"),
        "writebacks": written,
    }


EVAL_SQL = f"""
WITH r AS (SELECT *, CASE WHEN episode_id % 7 <> 0 THEN CASE WHEN episode_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE admission + INTERVAL 240 HOUR END END AS base_time FROM v_episode),
o AS (SELECT r.episode_id, count(*) AS n, count(*) FILTER (WHERE base_time IS NULL OR effective_dt > base_time) AS f, max(effective_dt) AS m FROM r JOIN v_obs USING (episode_id) GROUP BY 1),
p AS (SELECT r.episode_id, count(*) AS n, count(*) FILTER (WHERE base_time IS NULL OR performed_dt > base_time) AS f, max(performed_dt) AS m FROM r JOIN v_proc USING (episode_id) GROUP BY 1),
w AS (SELECT r.episode_id, count(*) AS n, count(*) FILTER (WHERE base_time IS NULL OR end_dt > base_time) AS f, max(end_dt) AS m FROM r JOIN (SELECT episode_id, end_dt FROM v_window) USING (episode_id) GROUP BY 1),
b AS (SELECT user_id AS episode_id, count(*) AS n, max(ts) AS m FROM events WHERE event_id % 37 = 0 GROUP BY 1),
j AS (SELECT r.*, coalesce(o.n, 0) AS n_o, coalesce(p.n, 0) AS n_p, coalesce(w.n, 0) AS n_w, coalesce(b.n, 0) AS n_b, coalesce(o.f, 0) AS f_o, coalesce(p.f, 0) AS f_p, coalesce(w.f, 0) AS f_w,
  greatest(r.discharge, o.m, p.m, w.m, b.m) AS last_at, r.episode_id % 4 = 0 OR (r.episode_id % 9 <> 0 AND r.discharge IS NOT NULL) AS outcome, r.episode_id % 5 = 0 AS changed
  FROM r LEFT JOIN o USING (episode_id) LEFT JOIN p USING (episode_id) LEFT JOIN w USING (episode_id) LEFT JOIN b USING (episode_id)),
k AS (SELECT *, outcome AND (f_o > 0 OR f_p > 0 OR f_w > 0 OR changed) AS enough FROM j)"""
STATUS_SQL = "CASE WHEN episode_id % 6 = 0 AND NOT enough THEN 'enriched_followup' WHEN enough THEN 'stale' WHEN outcome OR n_o + n_p + n_w + n_b > 0 THEN 'insufficient_evidence' ELSE 'pending_followup' END"


@query(
    "evaluate_followup",
    f"""{EVAL_SQL} SELECT episode_id * 10 AS record_id, n_o AS total_obs, f_o AS new_obs, f_p AS new_proc, f_w AS new_windows, n_b AS total_writebacks, outcome AS outcome_available, changed AS feature_snapshot_changed,
    enough AS sufficient_for_rescore, {STATUS_SQL} AS followup_status, {ts('last_at', 'last_followup_at')},
    array_to_string(list_sort(list_filter(['non_individual_use_team_or_unit_only', CASE WHEN episode_id % 2 = 1 THEN 'low_support' END, CASE WHEN NOT outcome THEN 'followup_outcome_unavailable' END,
      CASE WHEN NOT (f_o > 0 OR f_p > 0 OR f_w > 0 OR changed) THEN 'no_new_supported_followup_evidence' END], lambda x: x IS NOT NULL)), '|') AS evaluation_warnings FROM k""",
)
def _(t: Tables) -> DataFrame:
    out = U.evaluate_followup(followup_records(t), **evidence(t))
    cols = ["record_id", "total_obs", "new_obs", "new_proc", "new_windows", "total_writebacks", "outcome_available", "feature_snapshot_changed"]
    return emit(out.select(*cols, "sufficient_for_rescore", "followup_status", "last_followup_at", "evaluation_warnings"))


@query(
    "current_state",
    f"""{EVAL_SQL} SELECT episode_id * 10 AS record_id, CASE WHEN {STATUS_SQL} = 'enriched_followup' THEN 'enriched_followup' WHEN {STATUS_SQL} IN ('stale', 'insufficient_evidence') THEN {STATUS_SQL} WHEN episode_id % 2 = 0 THEN 'complete' ELSE 'pending_followup' END AS current_state FROM k""",
)
def _(t: Tables) -> DataFrame:
    out = U.evaluate_followup(followup_records(t), **evidence(t))
    initial = F.when(F.col("episode_id") % 2 == 0, F.lit("complete"))
    return out.select("record_id", U.current_state(F.col("followup_status"), F.col("enriched"), initial).alias("current_state"))


def episode_scores(t: Tables, features: list[str]) -> DataFrame:
    """(record_id, score, status) of every episode, scored by a linear model over ``features`` through all gates."""
    rows = W.episode_features(t.episodes, t.procedures, t.observations, t.shifts, as_of=AS_OF).withColumn("row_id", F.col("episode_id") * 10)
    rows = cut_lineage(rows.select("row_id", "episode_id", "unit_id", *WHOLE, "delta_ri", *[c for c in rows.columns if c.startswith("missing_") and c not in WHOLE]))
    drift = rows.agg(*[f(c).alias(f"{c}_{n}") for c in WHOLE for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    sound = t.spark.createDataFrame([(True, [])], "defensible boolean, statuses array<string>")
    out = SC.score_request(
        SC.Request(rows, "episode", temporal_spec=None), artifact=sound, model=M.fit_linear(rows, features, "delta_ri"), governed=["nurse_hppd", "nurse_skillmix"], target="delta_ri", drift=drift, q_hat=5.0, train_rows=rows.count()
    )
    return out.select(F.col("row_id").alias("record_id"), "score", F.when(F.col("score").isNotNull(), F.col("status")).alias("status"))


WHOLE = ["ri_initial", "nurse_hppd", "nurse_skillmix"]


@query("rescore_candidates")
def _(t: Tables) -> DataFrame:
    """Due records scored anew with staffing features, over what an earlier model without the skill mix had given them."""
    judged = U.evaluate_followup(followup_records(t), **evidence(t))
    again = episode_scores(t, WHOLE).withColumn("scored_at", F.lit("2024-03-01").cast("timestamp_ntz"))
    earlier = episode_scores(t, WHOLE[:2]).join(followup_records(t).filter("enriched").select("record_id"), "record_id", "left_semi")
    history = earlier.select("record_id", "score", F.lit("enriched_followup").alias("followup_status"), F.lit("2024-02-10").cast("timestamp_ntz").alias("scored_at"))
    return emit(U.rescore_candidates(judged, again, history), digits=4)


@query(
    "feature_snapshot_hash",
    """SELECT o_orderkey, sha256('{"features":{"a":' || CAST(o_custkey AS STRING) || ',"b":"' || o_orderpriority || '"},"feature_version":"v1","schema_hash":"s","target":{"delta":' || CAST(o_orderkey % 5 AS STRING) || '}}') AS snapshot_hash FROM orders""",
)
def _(t: Tables) -> DataFrame:
    features = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))
    target = F.struct((F.col("o_orderkey") % 5).alias("delta"))
    return t.raw("orders").select("o_orderkey", U.feature_snapshot_hash(F.lit("s"), F.lit("v1"), features, target).alias("snapshot_hash"))


WB_ON = "status2 = 'complete' AND score2 IS NOT NULL"
SUMMARY_SQL = f"""
WITH x AS (SELECT *, CASE WHEN row_id % 5 = 0 AND status <> 'insufficient_evidence' THEN 'complete' ELSE status END AS status2, CASE WHEN row_id % 5 = 0 THEN score / 2 ELSE score END AS score2 FROM v_scored)
SELECT CAST(unit_id AS STRING) AS "group", {rnd(f'CASE WHEN count(*) >= 10 AND count(DISTINCT episode_id) >= 10 AND count(DISTINCT staff) >= 5 THEN sum(score2 * {W_SQL}) FILTER (WHERE {WB_ON}) / (sum({W_SQL}) FILTER (WHERE {WB_ON}) + 1e-6) END', 'score')}, count(*) AS n_observations, count(DISTINCT episode_id) AS n_episodes, count(DISTINCT staff) AS n_staff FROM x GROUP BY 1"""


@query("writeback_summary", SUMMARY_SQL)
def _(t: Tables) -> DataFrame:
    s = t.scored
    improved = F.when(F.col("row_id") % 5 == 0, F.struct(*[
        (F.when(F.col("status") != "insufficient_evidence", F.lit("complete")).otherwise(F.col("status")) if c == "status" else F.col("score") / 2 if c == "score" else F.col(c)).alias(c) for c in s.columns if c != "row_id"
    ]))
    records = s.select(F.col("row_id").alias("record_id"), F.lit("m1").alias("model_id"), F.lit(None).cast("string").alias("baseline_model_id"), F.struct(*[c for c in s.columns if c != "row_id"]).alias("initial"), improved.alias("enriched"))
    models = t.raw("supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("model_id"), F.lit(True).alias("defensible"))
    records = cut_lineage(records)  # follow-up records are a stored table
    gate = U.writeback_gate(records, model_id="m1", defensible=True, models=models)
    return emit(U.writeback_summary(records, group_by="team", gate=gate).select("group", "score", "n_observations", "n_episodes", "n_staff"))


@query(
    "writeback_gate",
    """SELECT k AS case_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'mixed_models_not_aggregable' WHEN 2 THEN 'model_not_defensible' WHEN 3 THEN 'mixed_baseline_models_not_aggregable' WHEN 4 THEN 'baseline_model_not_found'
    ELSE 'baseline_model_not_defensible' END AS detail FROM (SELECT DISTINCT o_orderkey % 6 AS k FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    o = t.raw("orders").select((F.col("o_orderkey") % 6).alias("k"), "o_custkey")
    models = t.raw("supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("model_id"), (F.col("s_suppkey") != 2).alias("defensible"))
    base = {0: F.lit("m3"), 1: F.lit(None), 2: F.lit(None), 3: F.when(F.col("o_custkey") % 2 == 0, F.lit("m3")), 4: F.lit("zz"), 5: F.lit("m2")}
    out = None
    for k in range(6):
        model = F.when(F.col("o_custkey") % 2 == 0, F.lit("m9")).otherwise(F.lit("m1")) if k == 1 else F.lit("m1")
        rows = o.filter(F.col("k") == k).select(model.alias("model_id"), base[k].cast("string").alias("baseline_model_id"))
        one = U.writeback_gate(rows, model_id="m1", defensible=k != 2, models=models).select(F.lit(k).cast("long").alias("case_id"), "detail")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "patient_summary",
    f"""SELECT row_id AS record_id, {STATE_SQL} AS current_state, CAST(NULL AS DOUBLE) AS score, true AS score_suppressed,
    array_to_string(list_sort(list_distinct(list_concat(warnings, ['non_individual_use_team_or_unit_only', 'writeback_summary_model_not_defensible'], CASE WHEN row_id % 3 = 0 OR staff IS NULL THEN ['low_support'] ELSE [] END))), '|') AS warnings FROM v_scored""",
)
def _(t: Tables) -> DataFrame:
    rows = scored_results(t)
    records = U.initial_followup(rows, rows.filter(F.lit(False)))
    models = t.raw("supplier").filter("s_suppkey = 1").select(F.lit("m1").alias("model_id"), F.lit(False).alias("defensible"))
    return emit(U.patient_summary(records, models).select("record_id", "current_state", "score", "score_suppressed", "warnings"))


# --- audit -----------------------------------------------------------------------------------

SECRET = "audit-secret"
IPAD = bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()
OPAD = bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()


def hmac_sql(text: str) -> str:
    return f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({text}))))"


def audit_events(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    return c.select(
        "conv_id",
        "turn",
        F.concat(F.lit("t"), F.col("turn")).alias("created_at"),
        F.lit("message").alias("event_type"),
        F.col("role").alias("actor"),
        F.lit("chat").alias("context"),
        F.sha2("text", 256).alias("payload_sha256"),
    )


CHAIN_SQL = f"""
WITH RECURSIVE x AS (SELECT conv_id, turn, role, sha256(text) AS p FROM conversations),
chain AS (SELECT conv_id, turn, '' AS prev_hash, sha256('|t' || CAST(turn AS STRING) || '|message|' || role || '|chat|' || p) AS chain_hash FROM x WHERE turn = 0
 UNION ALL SELECT x.conv_id, x.turn, c.chain_hash, sha256(c.chain_hash || '|t' || CAST(x.turn AS STRING) || '|message|' || role || '|chat|' || p) FROM chain c JOIN x ON x.conv_id = c.conv_id AND x.turn = c.turn + 1)
SELECT conv_id, turn, prev_hash, chain_hash, {hmac_sql('chain_hash')} AS hmac_sig FROM chain"""


@query("seal_audit_batch", CHAIN_SQL)
def _(t: Tables) -> DataFrame:
    out = L.seal_audit_batch(audit_events(t), chain="conv_id", seq="turn", secret=SECRET)
    return out.select("conv_id", "turn", "prev_hash", "chain_hash", "hmac_sig")


def sealed_in_batches(t: Tables) -> DataFrame:
    """Turns 0 to 2 of every conversation as batch 1, the rest as batch 2."""
    events = audit_events(t)
    first = L.seal_audit_batch(events.filter("turn < 3"), chain="conv_id", seq="turn", secret=SECRET, batch=1)
    tails = L.chain_tails(first, chain="conv_id", seq="turn")
    return first.unionByName(L.seal_audit_batch(events.filter("turn >= 3"), chain="conv_id", seq="turn", secret=SECRET, batch=2, tails=tails))


@query("seal_audit_batches", CHAIN_SQL)
def _(t: Tables) -> DataFrame:
    return sealed_in_batches(t).select("conv_id", "turn", "prev_hash", "chain_hash", "hmac_sig")


@query("seal_chains", CHAIN_SQL)
def _(t: Tables) -> DataFrame:
    """Chains of any length in batches of three events, each going on from the one before."""
    out = L.seal_chains(audit_events(t), shared_folder(t, "chains"), chain="conv_id", seq="turn", secret=SECRET, batch_events=3)
    return out.select("conv_id", "turn", "prev_hash", "chain_hash", "hmac_sig")


@query(
    "verify_audit_chain",
    """WITH m AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1),
    b AS (SELECT conv_id, CASE WHEN turn < 3 THEN 1 ELSE 2 END AS batch, max(turn) AS last_seq FROM conversations GROUP BY ALL)
    SELECT conv_id, turn, 'content_changed' AS reason FROM conversations WHERE conv_id % 5 = 0 AND turn = 0
    UNION ALL SELECT conv_id, turn, 'signature_invalid' FROM conversations WHERE conv_id % 5 = 1 AND turn = 1
    UNION ALL SELECT conv_id, 1, 'predecessor_missing' FROM m WHERE conv_id % 5 = 2 AND last_turn >= 1
    UNION ALL SELECT conv_id, last_seq, 'batch_incomplete' FROM b JOIN m USING (conv_id)
      WHERE (conv_id % 5 = 2 AND batch = 1) OR (conv_id % 5 = 3 AND last_seq = last_turn) OR conv_id % 5 = 4""",
)
def _(t: Tables) -> DataFrame:
    sealed = sealed_in_batches(t)
    manifest = L.batch_manifest(sealed, chain="conv_id", seq="turn")
    last = manifest.groupBy("conv_id").agg(F.max("last_seq").alias("end"))
    k = F.col("conv_id") % 5
    tampered = (
        sealed.join(last, "conv_id")
        .filter(~((k == 2) & (F.col("turn") == 0)) & ~((k == 3) & (F.col("turn") == F.col("end"))) & (k != 4))
        .drop("end")
        .withColumn("actor", F.when((k == 0) & (F.col("turn") == 0), F.lit("intruder")).otherwise(F.col("actor")))
        .withColumn("hmac_sig", F.when((k == 1) & (F.col("turn") == 1), F.lit("00")).otherwise(F.col("hmac_sig")))
    )
    return L.verify_audit_chain(tampered, chain="conv_id", seq="turn", secret=SECRET, manifest=manifest)


@query(
    "pseudonymize_actor",
    f"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'system:api' WHEN 1 THEN 'system:unknown' WHEN 2 THEN 'system:nightly_job' WHEN 3 THEN 'user:' || sha256(c_name) ELSE 'legacy_actor:' || {hmac_sql("'legacy_actor:' || c_name")} END AS actor FROM customer""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    actor = F.when(k == 0, F.lit("api")).when(k == 1, F.lit("  ")).when(k == 2, F.lit("system:nightly_job")).when(k == 3, F.concat(F.lit("user:"), F.sha2("c_name", 256))).otherwise(F.col("c_name"))
    return t.raw("customer").select("c_custkey", L.pseudonymize_actor(actor, secret=SECRET).alias("actor"))


@query(
    "audit_allowlist",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'grain|unit_id' ELSE 'unit_id' END AS kept FROM customer""",
)
def _(t: Tables) -> DataFrame:
    payload = F.create_map(
        F.lit("patient"), F.col("c_name"), F.lit("unit_id"), F.col("c_nationkey").cast("string"), F.lit("grain"), F.when(F.col("c_custkey") % 2 == 0, F.lit("episode")).otherwise(F.lit("")), F.lit("status"), F.lit(None).cast("string")
    )
    return emit(t.raw("customer").select("c_custkey", F.array_sort(F.map_keys(L.audit_allowlist(payload))).alias("kept")))


@query("audit_recent", f"SELECT event_id, {ts('ts', 'created_at')} FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", F.col("ts").alias("created_at"))
    return emit(L.audit_recent(rows, limit=500, order=("created_at", "event_id")))


@query(
    "snapshot_diff",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 1 THEN 'create' WHEN c_custkey % 11 = 2 THEN 'delete' ELSE 'update' END AS action,
    CASE c_custkey % 11 WHEN 1 THEN 'c_mktsegment:>' || c_mktsegment || '|c_name:>' || c_name WHEN 2 THEN 'c_mktsegment:' || c_mktsegment || '>|c_name:' || c_name || '>'
      WHEN 3 THEN 'c_mktsegment:' || c_mktsegment || '>NEW' WHEN 4 THEN 'c_mktsegment:' || c_mktsegment || '>|c_name:' || c_name || '>x' || c_name END AS changes FROM customer WHERE c_custkey % 11 IN (1, 2, 3, 4)""",
)
def _(t: Tables) -> DataFrame:
    base = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey") % 11
    old = base.filter(k != 1)
    new = base.filter(k != 2).select(
        "c_custkey",
        F.when(k == 4, F.concat(F.lit("x"), "c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k == 3, F.lit("NEW")).when(k != 4, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    out = L.snapshot_diff(old, new, key="c_custkey")
    text = F.transform(
        F.array_sort(F.map_keys("changes")),
        lambda c: F.concat(c, F.lit(":"), F.coalesce(F.try_element_at("changes", c)["from"], F.lit("")), F.lit(">"), F.coalesce(F.try_element_at("changes", c)["to"], F.lit(""))),
    )
    return emit(out.select("c_custkey", "action", text.alias("changes")))


@query("change_log_query", f"SELECT CAST(event_id AS STRING) AS object_id, event_type AS label, {ts('ts', 'created_at')} FROM events WHERE event_type = 'error' ORDER BY ts DESC, CAST(event_id AS STRING) LIMIT 200")
def _(t: Tables) -> DataFrame:
    log = t.raw("events").select(F.col("event_id").cast("string").alias("object_id"), F.col("event_type").alias("label"), F.col("ts").alias("created_at"))
    return emit(L.change_log_query(log, label="error", limit=200))


@query(
    "human_in_loop",
    """WITH d AS (SELECT conv_id AS run_id, turn, ['approve', 'override', 'reject', 'note'][CAST((conv_id + turn) % 4 + 1 AS INTEGER)] AS kind FROM conversations WHERE conv_id % 6 <> 0),
    g AS (SELECT run_id, arg_max(kind, turn) AS last_kind, count(*) AS n, list(kind ORDER BY turn) AS ks FROM d GROUP BY 1)
    SELECT r.run_id, CASE last_kind WHEN 'approve' THEN 'accepted' WHEN 'override' THEN 'modified' WHEN 'reject' THEN 'overridden' WHEN 'note' THEN 'noted' ELSE 'unreviewed' END AS status,
    coalesce(last_kind IN ('override', 'reject'), false) AS human_override_flag, coalesce(n, 0) AS n_decisions, coalesce(array_to_string(ks, '|'), '') AS decisions FROM (SELECT DISTINCT conv_id AS run_id FROM conversations) r LEFT JOIN g USING (run_id)""",
)
def _(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    kinds = F.array(F.lit("approve"), F.lit("override"), F.lit("reject"), F.lit("note"))
    decisions = c.filter(F.col("conv_id") % 6 != 0).select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("created_at"), F.col("turn").alias("decision_id"), F.try_element_at(kinds, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")).alias("decision_type")
    )
    runs = c.select(F.col("conv_id").alias("run_id")).distinct()
    return emit(L.human_in_loop(decisions, runs))


def dedupe_sql(minutes: int) -> str:
    return f"""
WITH RECURSIVE x AS (SELECT DISTINCT user_id % 3 AS caller, event_type AS error, ts FROM events),
log AS (SELECT caller, error, min(ts) AS ts FROM x GROUP BY ALL
 UNION ALL SELECT caller, error, nxt FROM (SELECT l.caller, l.error, (SELECT min(x.ts) FROM x WHERE x.caller = l.caller AND x.error = l.error AND x.ts >= l.ts + INTERVAL {minutes} MINUTE) AS nxt FROM log l) WHERE nxt IS NOT NULL)
SELECT caller, error, {ts('ts', 'logged_at')} FROM log"""


@query("denial_dedupe", dedupe_sql(60))
def _(t: Tables) -> DataFrame:
    d = t.raw("events").select((F.col("user_id") % 3).alias("caller"), F.col("event_type").alias("error"), F.col("ts").alias("logged_at"))
    return emit(L.denial_dedupe(d, keys=["caller", "error"], ts="logged_at", seconds=3600))


# --- streams ---------------------------------------------------------------------------------


def in_parts(t: Tables, source: str, run: Callable[[DataFrame], None], parts: int = 4, late: bool = True) -> None:
    """Let a stream read ``events`` in time-ordered parts, one run of the query and so one micro-batch or more per part.

    With ``late`` every eleventh event comes one part later than its time says.
    """
    events = t.raw("events")
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"))
    place = F.unix_micros(F.col("ts").cast("timestamp"))
    spot = events.withColumn("_e", ends.select(F.struct("a", "b")).scalar())
    part = F.least(F.floor((place - F.col("_e.a")) / (F.col("_e.b") - F.col("_e.a") + 1) * parts), F.lit(parts - 1))
    if late:
        part = F.least(part + (F.col("event_id") % 11 == 0).cast("int"), F.lit(parts - 1))
    dealt = spot.withColumn("_p", part.cast("int"))
    for k in range(parts):
        dealt.filter(F.col("_p") == k).drop("_e", "_p").write.mode("append").parquet(source)
        run(S.file_stream(t.spark, source, schema=events.schema))


@query(
    "stream_raw_latest",
    f"""SELECT user_id AS episode_id, event_type AS resource_type, 'k' || CAST(event_id % 40 AS STRING) AS resource_id, {ts('max(ts)', 'ingested_at')}, arg_max(event_id, ts) AS event_id FROM events WHERE event_id % 19 <> 0 GROUP BY user_id, event_type, event_id % 40""",
)
def _(t: Tables) -> DataFrame:
    out, order = shared_folder(t, "upserts"), ["ingested_at", "event_id"]
    rid = F.when(F.col("event_id") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit("k"), F.col("event_id") % 40))
    shaped = lambda rows: rows.select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("resource_type"), rid.alias("resource_id"), F.col("ts").alias("ingested_at"), "event_id")
    in_parts(t, f"{out}-source", lambda rows: S.stream_raw_latest(shaped(rows), out, f"{out}-ckpt", order=order, buckets=16))
    S.drop_old_generations(t.spark, out)
    return emit(S.read_latest(t.spark, out, schema=shaped(t.raw("events")).schema))


# Parts of the input as ``in_parts`` deals them, with the mark that the parts before leave.
PARTS_SQL = """e AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
p AS (SELECT events.*, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS w, least(least(CAST(floor((epoch_us(ts) - a) / (b - a + 1) * 4) AS INTEGER), 3) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, 3) AS k FROM events, e),
m AS (SELECT g.k, max(p.ts) - INTERVAL 2 DAY AS mark FROM (SELECT unnest(range(4)) AS k) g LEFT JOIN p ON p.k < g.k GROUP BY g.k),
d AS (SELECT p.*, mark IS NOT NULL AND w + INTERVAL 12 HOUR <= mark AS late FROM p JOIN m USING (k))"""


def counted(t: Tables, late: bool) -> DataFrame:
    """The window counts of the stream, or the rows they leave out; rows come up to seven days late, two are allowed."""
    out = shared_folder(t, "counts")
    shaped = lambda rows: rows.select(F.col("user_id").alias("episode_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", (F.col("event_type") == "error").alias("is_nursing"))
    args = {"key": "episode_id", "ts": "ts", "lateness": "2 days"}

    # The last state of every window is kept: update mode writes a window again when it changes.
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def run(rows: DataFrame) -> None:
        if late:
            S.stream_late_rows(shaped(rows), out, f"{out}-ckpt", **args)
        else:
            S.run_available(S.stream_window_counts(shaped(rows), **args).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-ckpt"))

    in_parts(t, f"{out}-source", run)
    return t.spark.read.parquet(out)


@query(
    "stream_window_counts",
    f"""WITH {PARTS_SQL}, x AS (SELECT user_id AS episode_id, w, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_nursing, arg_max(value, ts) AS v FROM d WHERE NOT late GROUP BY ALL)
    SELECT episode_id, {ts('w', 'start_dt')}, n, n_nursing, {rnd('v', 'last_value')} FROM x""",
)
def _(t: Tables) -> DataFrame:
    from caretrace.functions.tables import latest_by

    final = latest_by(counted(t, late=False).drop("batch_id"), ["episode_id", "start_dt"], ["batch"])
    return emit(final.select("episode_id", "start_dt", "n", "n_nursing", "last_value"))


@query(
    "stream_late_rows",
    f"""WITH {PARTS_SQL}, c AS (SELECT user_id AS episode_id, w, count(*) AS dropped FROM d WHERE late GROUP BY ALL), n AS (SELECT count(*) AS total FROM events)
    SELECT episode_id, {ts('w', 'start_dt')}, dropped, total - (SELECT count(*) FROM d WHERE NOT late) = (SELECT sum(dropped) FROM c) AS adds_up FROM c, n""",
)
def _(t: Tables) -> DataFrame:
    """What the window counts leave out; with it they add up to all rows."""
    dropped = counted(t, late=True).groupBy("episode_id", "start_dt").agg(F.sum("dropped").alias("dropped"))
    streamed = counted(t, late=False)
    from caretrace.functions.tables import latest_by

    kept = latest_by(streamed.drop("batch_id"), ["episode_id", "start_dt"], ["batch"]).agg(F.sum("n")).scalar()
    total = t.raw("events").agg(F.count(F.lit(1))).scalar()
    return emit(dropped.withColumn("adds_up", total - kept == dropped.agg(F.sum("dropped")).scalar()))


# The stream's rule with late rows: batches in order, times in order within a batch, rows behind the watermark left out.
LATE_SQL = f"""
WITH RECURSIVE e AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
p AS (SELECT DISTINCT user_id % 3 AS caller, event_type AS error, ts, least(least(CAST(floor((epoch_us(ts) - a) / (b - a + 1) * 4) AS INTEGER), 3) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, 3) AS k FROM events, e),
m AS (SELECT g.k, max(p.ts) - INTERVAL 3 DAY AS mark FROM (SELECT unnest(range(4)) AS k) g LEFT JOIN p ON p.k < g.k GROUP BY g.k),
x AS (SELECT caller, error, ts, p.k FROM p JOIN m USING (k) WHERE mark IS NULL OR ts > mark),
log AS (SELECT caller, error, min({{'k': k, 't': ts}}) AS spot FROM x GROUP BY ALL
 UNION ALL SELECT caller, error, nxt FROM (SELECT l.caller, l.error, (SELECT min({{'k': x.k, 't': x.ts}}) FROM x WHERE x.caller = l.caller AND x.error = l.error AND x.ts >= l.spot.t + INTERVAL 1 MINUTE
   AND (x.k > l.spot.k OR (x.k = l.spot.k AND x.ts > l.spot.t))) AS nxt FROM log l) WHERE nxt IS NOT NULL)
SELECT caller, error, {ts('spot.t', 'logged_at')} FROM log"""


@query("stream_denial_dedupe", LATE_SQL)
def _(t: Tables) -> DataFrame:
    """Every eleventh denial comes a part later: some are judged late, those more than three days behind are dropped."""
    out = shared_folder(t, "denials")
    shaped = lambda rows: rows.select((F.col("user_id") % 3).alias("caller"), F.col("event_type").alias("error"), F.col("ts").cast("timestamp").alias("logged_at"))
    in_parts(t, f"{out}-source", lambda rows: S.stream_denial_dedupe(shaped(rows), out, f"{out}-ckpt", keys=["caller", "error"], ts="logged_at", lateness="3 days"))
    return emit(t.spark.read.parquet(out).drop("batch_id"))


@query(
    "stream_followup",
    f"""WITH r AS (SELECT *, CASE WHEN episode_id % 7 <> 0 THEN CASE WHEN episode_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE admission + INTERVAL 240 HOUR END END AS base_time FROM v_episode),
    g AS (SELECT episode_id * 10 AS record_id, count(*) AS total, count(*) FILTER (WHERE base_time IS NULL OR ts > base_time) AS "new", max(ts) AS latest FROM r JOIN events ON user_id = episode_id GROUP BY 1)
    SELECT record_id, total, "new", {ts('latest')}, CASE WHEN "new" > 0 THEN 'stale' ELSE 'insufficient_evidence' END AS followup_status FROM g""",
)
def _(t: Tables) -> DataFrame:
    out = shared_folder(t, "followup")
    in_parts(t, f"{out}-source", lambda rows: S.stream_followup(rows.select(F.col("user_id").alias("episode_id"), "ts"), followup_records(t), out, f"{out}-ckpt", ts="ts"))
    return emit(S.read_followup(t.spark, out))
