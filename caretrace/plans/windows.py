"""Registered queries of the window feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.operators import windows as W
from caretrace.plans.adapter import AS_OF, FOLLOW_UP_HOURS, WINDOW_HOURS, Tables
from caretrace.plans.base import emit, query, rnd, ts

KEYS = ["episode_id", "window_index"]


def windows(t: Tables) -> DataFrame:
    return W.fixed_windows(t.episodes, window_hours=WINDOW_HOURS, as_of=AS_OF)


def spec(t: Tables) -> DataFrame:
    return W.window_temporal_spec(windows(t), follow_up_hours=FOLLOW_UP_HOURS)


def target(t: Tables, boundary: str = "first_last", tol_minutes: int = 60) -> DataFrame:
    return W.outcome_target(W.outcome_bounds(spec(t), W.ri_series(t.observations), boundary=boundary, tol_minutes=tol_minutes))


def features(t: Tables, **options) -> DataFrame:
    options = {"window_hours": WINDOW_HOURS, "follow_up_hours": FOLLOW_UP_HOURS, "as_of": AS_OF, **options}
    return W.window_features(t.episodes, t.procedures, t.observations, t.shifts, **options)


@query(
    "episode_temporal_spec",
    f"""SELECT episode_id, 'temporal_v1' AS temporal_spec_version, {ts('admission', 'index_time')},
    {ts('feature_window_start')}, {ts('feature_window_end')}, {ts('feature_window_end', 'outcome_window_start')},
    {ts('feature_window_end + INTERVAL 24 HOUR', 'outcome_window_end')}, 'legacy_discharge_endpoint' AS censoring_reason,
    'legacy_outcome_not_defensible' AS outcome_status FROM v_espec""",
)
def _(t: Tables) -> DataFrame:
    out = W.episode_temporal_spec(t.episodes, as_of=AS_OF)
    return emit(out.drop("unit_id", "hospital_id", "admission", "discharge", "ri_initial", "ri_final"))


@query(
    "procedure_counts",
    """SELECT 'window' AS grain, w.episode_id, w.window_index, coalesce(c.proc_count, 0) AS proc_count,
    coalesce(c.nurse_proc_count, 0) AS nurse_proc_count, coalesce(c.nurse_proc_count_det, 0) AS nurse_proc_count_det
    FROM v_window w LEFT JOIN v_counts c USING (episode_id, window_index)
    UNION ALL
    SELECT 'episode', e.episode_id, -1, count(p.proc_id),
    count(p.proc_id) FILTER (WHERE regexp_matches(p.performer_role, '(nurs|rn|enfermer|tcae|aux)', 'i')), count(p.proc_id) FILTER (WHERE p.is_nursing)
    FROM v_espec e LEFT JOIN v_proc p ON p.episode_id = e.episode_id AND p.performed_dt <= e.feature_window_end GROUP BY e.episode_id""",
)
def _(t: Tables) -> DataFrame:
    w = W.procedure_counts(windows(t), t.procedures, grain="window")
    e = W.procedure_counts(W.episode_temporal_spec(t.episodes, as_of=AS_OF), t.procedures, grain="episode")
    return emit(
        w.select(F.lit("window").alias("grain"), *w.columns).unionByName(
            e.select(F.lit("episode").alias("grain"), "episode_id", F.lit(-1).alias("window_index"), *W.COUNT_COLS)
        )
    )


@query(
    "roster_overlap",
    f"SELECT episode_id, window_index, shift_id, {ts('overlap_start')}, {ts('overlap_end')}, {rnd('overlap_hours', 'overlap_hours')} FROM v_overlap",
)
def _(t: Tables) -> DataFrame:
    out = W.roster_overlap(windows(t), t.shifts, ids=KEYS, start="start_dt", end="end_dt")
    return emit(out.select(*KEYS, "shift_id", "overlap_start", "overlap_end", "overlap_hours"))


@query("census_fallback", "SELECT episode_id, window_index, shift_id, CAST(census AS BIGINT) AS census FROM v_census")
def _(t: Tables) -> DataFrame:
    overlaps = W.roster_overlap(windows(t), t.shifts, ids=KEYS, start="start_dt", end="end_dt")
    return emit(W.census_fallback(overlaps, t.episodes).select(*KEYS, "shift_id", "census"))


@query(
    "staffing_exposure",
    f"""SELECT w.episode_id, w.window_index, {rnd('coalesce(nurse_hours, 0)', 'nurse_hours', 4)}, {rnd('coalesce(rn_hours, 0)', 'rn_hours', 4)},
    {rnd('coalesce(patient_hours, 0)', 'patient_hours', 4)},
    {rnd('CASE WHEN patient_hours > 0 THEN nurse_hours / (patient_hours / 24.0) ELSE 0 END', 'nurse_hppd', 4)},
    {rnd('CASE WHEN nurse_hours > 0 THEN rn_hours / nurse_hours ELSE 0 END', 'nurse_skillmix')}
    FROM v_window w LEFT JOIN v_staff s USING (episode_id, window_index)""",
)
def _(t: Tables) -> DataFrame:
    w = windows(t)
    overlaps = W.roster_overlap(w, t.shifts, ids=KEYS, start="start_dt", end="end_dt")
    out = W.staffing_exposure(w, W.census_fallback(overlaps, t.episodes), ids=KEYS)
    return emit(out, nurse_hours=4, rn_hours=4, patient_hours=4, nurse_hppd=4)


def _vital_sql() -> str:
    parts = []
    for code, short in C.VITALS.items():
        src = f"v.{short}" if short in ("hr", "sbp") else "NULL"
        flag = f"CAST({src} IS NULL AS BIGINT)"
        parts += [
            rnd(f"coalesce({src}, 0)", f"vs_{short}_last"),
            f"{flag} AS missing_vs_{short}_last",
            f"{flag} AS missing_loinc_{code.replace('-', '_')}",
        ]
    return ", ".join(parts)


@query(
    "vitals_last",
    f"SELECT w.episode_id, w.window_index, {_vital_sql()} FROM v_window w LEFT JOIN v_vitals v USING (episode_id, window_index)",
)
def _(t: Tables) -> DataFrame:
    return emit(W.vitals_last(windows(t), t.observations, grain="window"))


EPISODE_FEATURES_SQL = f"""
WITH x_over AS (SELECT w.episode_id, w.unit_id, greatest(s.start_dt, w.admission) AS a, least(s.end_dt, w.feature_window_end) AS b, s.rn_count, s.na_count, s.patient_census
  FROM v_espec w JOIN v_shift s ON s.unit_id = w.unit_id AND s.end_dt > w.admission AND s.start_dt < w.feature_window_end),
x_cen AS (SELECT o.*, (epoch_us(b) - epoch_us(a)) / 3600000000.0 AS h, greatest(coalesce(o.patient_census,
  (SELECT count(*) FROM v_episode e WHERE e.unit_id = o.unit_id AND e.admission <= o.b AND (e.discharge IS NULL OR e.discharge >= o.a))), 1) AS census FROM x_over o),
x_staff AS (SELECT episode_id, sum((rn_count + na_count) * h) AS nh, sum(rn_count * h) AS rh, sum(census * h) AS ph FROM x_cen GROUP BY 1),
x_vit AS (SELECT e.episode_id, arg_max(o.value_num, o.effective_dt) FILTER (WHERE o.code = '8867-4') AS hr,
  arg_max(o.value_num, o.effective_dt) FILTER (WHERE o.code = '8480-6') AS sbp
  FROM v_espec e JOIN v_obs o ON o.episode_id = e.episode_id AND o.effective_dt <= e.feature_window_end
  WHERE o.value_num IS NOT NULL AND o.code_system = 'http://loinc.org' GROUP BY 1),
x_cnt AS (SELECT e.episode_id, count(p.proc_id) AS proc_count, count(p.proc_id) FILTER (WHERE regexp_matches(p.performer_role, '(nurs|rn|enfermer|tcae|aux)', 'i')) AS nurse_proc_count,
  count(p.proc_id) FILTER (WHERE p.is_nursing) AS nurse_proc_count_det
  FROM v_espec e LEFT JOIN v_proc p ON p.episode_id = e.episode_id AND p.performed_dt <= e.feature_window_end GROUP BY 1)
SELECT e.episode_id, e.unit_id, {rnd('e.ri_initial', 'ri_initial')}, {rnd('e.ri_final - e.ri_initial', 'delta_ri')}, proc_count, nurse_proc_count, nurse_proc_count_det,
 {rnd('CASE WHEN ph > 0 THEN nh / (ph / 24.0) ELSE 0 END', 'nurse_hppd', 4)}, {rnd('CASE WHEN nh > 0 THEN rh / nh ELSE 0 END', 'nurse_skillmix')},
 {rnd('coalesce(hr, 0)', 'vs_hr_last')}, {rnd('coalesce(sbp, 0)', 'vs_sbp_last')}, CAST(hr IS NULL AS BIGINT) AS missing_vs_hr_last,
 CAST(sbp IS NULL AS BIGINT) AS missing_loinc_8480_6, 1 AS missing_vs_temp_last, 'legacy_outcome_not_defensible' AS outcome_status, {ts('e.feature_window_end')}
FROM v_espec e LEFT JOIN x_staff USING (episode_id) LEFT JOIN x_vit USING (episode_id) LEFT JOIN x_cnt USING (episode_id)"""


@query("episode_features", EPISODE_FEATURES_SQL)
def _(t: Tables) -> DataFrame:
    out = W.episode_features(t.episodes, t.procedures, t.observations, t.shifts, as_of=AS_OF)
    cols = ["episode_id", "unit_id", "ri_initial", "delta_ri", *W.COUNT_COLS, "nurse_hppd", "nurse_skillmix", "vs_hr_last", "vs_sbp_last"]
    cols += ["missing_vs_hr_last", "missing_loinc_8480_6", "missing_vs_temp_last", "outcome_status", "feature_window_end"]
    return emit(out.select(*cols), nurse_hppd=4)


@query("fixed_windows", f"SELECT episode_id, window_index, {ts('start_dt')}, {ts('end_dt')} FROM v_window")
def _(t: Tables) -> DataFrame:
    return emit(windows(t).select(*KEYS, "start_dt", "end_dt"))


SHIFT_WINDOWS_SQL = f"""
WITH x_live AS (SELECT *, coalesce(discharge, TIMESTAMP '2024-02-01 00:00:00') AS last_dt FROM v_episode WHERE unit_id % 5 <> 4),
x_dark AS (SELECT * FROM v_window WHERE unit_id % 5 = 4),
x_pairs AS (SELECT e.episode_id, s.start_dt AS ss, greatest(s.start_dt, e.admission) AS a, least(s.end_dt, e.last_dt) AS b
  FROM x_live e JOIN v_shift s ON s.unit_id = e.unit_id AND s.end_dt > e.admission AND s.start_dt < e.last_dt WHERE e.last_dt > e.admission)
SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY ss) - 1 AS BIGINT) AS window_index, {ts('a', 'start_dt')}, {ts('b', 'end_dt')} FROM x_pairs
UNION ALL SELECT episode_id, window_index, {ts('start_dt')}, {ts('end_dt')} FROM x_dark"""


@query("shift_windows", SHIFT_WINDOWS_SQL)
def _(t: Tables) -> DataFrame:
    # One unit in five publishes no roster, so the fallback to fixed windows is part of the result.
    shifts = t.shifts.filter(F.col("unit_id") % 5 != 4)
    return emit(W.shift_windows(t.episodes, shifts, window_hours=WINDOW_HOURS, as_of=AS_OF).select(*KEYS, "start_dt", "end_dt"))


@query(
    "window_temporal_spec",
    f"""SELECT episode_id, window_index, {ts('outcome_start', 'outcome_window_start')}, {ts('outcome_end', 'outcome_window_end')}, censoring_reason,
    'temporal_v1' AS temporal_spec_version FROM v_wspec""",
)
def _(t: Tables) -> DataFrame:
    return emit(spec(t).select(*KEYS, "outcome_window_start", "outcome_window_end", "censoring_reason", "temporal_spec_version"))


@query(
    "ri_series",
    f"""SELECT 'window' AS variant, episode_id, obs_id, {rnd('value_num', 'value_num')}, {ts('effective_dt')} FROM v_series
    UNION ALL SELECT 'causal', episode_id, obs_id, {rnd('value_num', 'value_num')}, {ts('effective_dt')} FROM v_obs
    WHERE value_num IS NOT NULL AND (code = '85556-9' OR lower(code) = 'ri')""",
)
def _(t: Tables) -> DataFrame:
    both = [W.ri_series(t.observations, variant=v).withColumn("variant", F.lit(v)) for v in ("window", "causal")]
    return emit(both[0].unionByName(both[1]))


@query(
    "outcome_first_last",
    f"SELECT episode_id, window_index, {rnd('ri_start', 'ri_start')}, {rnd('ri_end', 'ri_end')} FROM v_bounds",
)
def _(t: Tables) -> DataFrame:
    return emit(W.outcome_first_last(spec(t), W.ri_series(t.observations)).select(*KEYS, "ri_start", "ri_end"))


NEAREST_TOL = 360
NEAREST_SQL = f"""
WITH x_near AS (SELECT w.episode_id, w.window_index, count(*) AS n,
   min({{{{'d': abs(epoch_us(p.effective_dt) - epoch_us(w.outcome_start)), 't': p.effective_dt, 'v': p.value_num}}}}) AS a,
   min({{{{'d': abs(epoch_us(p.effective_dt) - epoch_us(w.outcome_end)), 't': p.effective_dt, 'v': p.value_num}}}}) AS b
  FROM v_wspec w JOIN v_series p ON p.episode_id = w.episode_id
   AND p.effective_dt >= w.outcome_start - INTERVAL {{tol}} MINUTE AND p.effective_dt <= w.outcome_end + INTERVAL {{tol}} MINUTE GROUP BY ALL)
SELECT w.episode_id, w.window_index, {rnd('CASE WHEN n >= 2 AND ({tol} = 0 OR a.d <= {tol} * CAST(60000000 AS BIGINT)) THEN a.v END', 'ri_start')},
 {rnd('CASE WHEN n >= 2 AND ({tol} = 0 OR b.d <= {tol} * CAST(60000000 AS BIGINT)) THEN b.v END', 'ri_end')}
FROM v_wspec w LEFT JOIN x_near USING (episode_id, window_index)"""


@query("outcome_nearest", NEAREST_SQL.format(tol=NEAREST_TOL).replace("{{", "{").replace("}}", "}"))
def _(t: Tables) -> DataFrame:
    out = W.outcome_nearest(spec(t), W.ri_series(t.observations), tol_minutes=NEAREST_TOL)
    return emit(out.select(*KEYS, "ri_start", "ri_end"))


@query("outcome_nearest_unlimited", NEAREST_SQL.format(tol=0).replace("{{", "{").replace("}}", "}"))
def _(t: Tables) -> DataFrame:
    return emit(W.outcome_nearest(spec(t), W.ri_series(t.observations), tol_minutes=0).select(*KEYS, "ri_start", "ri_end"))


TARGET_COLS = f"""{rnd('delta_ri', 'delta_ri')}, outcome_status, missing_t0 AS missing_loinc_85556_9_t0, missing_t1 AS missing_loinc_85556_9_t1,
 missing_delta_ri, {rnd('ri_window_start', 'ri_window_start')}"""


@query("outcome_target", f"SELECT episode_id, window_index, {TARGET_COLS} FROM v_target")
def _(t: Tables) -> DataFrame:
    cols = ["delta_ri", "outcome_status", "missing_loinc_85556_9_t0", "missing_loinc_85556_9_t1", "missing_delta_ri", "ri_window_start"]
    return emit(target(t).select(*KEYS, *cols))


CODES_SQL = "[" + ", ".join(f"'{c}'" for c in C.COMPONENT_CODES) + "]"
COMPONENT_SQL = f"""
WITH x_need AS (SELECT episode_id, window_index, outcome_start, outcome_end, anchor,
   CASE WHEN anchor = 't0' THEN outcome_start ELSE outcome_end END AS at, code
  FROM v_target, (SELECT unnest(['t0', 't1']) AS anchor), (SELECT unnest({CODES_SQL}) AS code)
  WHERE missing_delta_ri = 1 AND ((anchor = 't0' AND missing_t0 = 1) OR (anchor = 't1' AND missing_t1 = 1))),
x_have AS (SELECT n.episode_id, n.window_index, n.anchor, n.code, min(abs(epoch_us(o.effective_dt) - epoch_us(n.at))) AS d
  FROM x_need n JOIN v_obs o ON o.episode_id = n.episode_id AND o.code = n.code AND o.effective_dt BETWEEN n.outcome_start AND n.outcome_end
  WHERE o.value_num IS NOT NULL AND o.code_system = 'http://loinc.org' GROUP BY ALL)
SELECT n.episode_id, n.window_index, n.code, n.anchor, CAST(h.d IS NULL OR h.d > 720 * CAST(60000000 AS BIGINT) AS BIGINT) AS missing
FROM x_need n LEFT JOIN x_have h USING (episode_id, window_index, anchor, code)"""


@query("component_missingness", COMPONENT_SQL)
def _(t: Tables) -> DataFrame:
    return emit(W.component_missingness(target(t), t.observations, tol_minutes=720))


WINDOW_FEATURES_SQL = f"""
SELECT w.episode_id, w.unit_id, w.window_index, {rnd('w.ri_initial', 'ri_initial')}, {rnd('(epoch_us(w.end_dt) - epoch_us(w.start_dt)) / 3600000000.0', 'window_hours')},
 72.0 AS follow_up_hours, coalesce(proc_count, 0) AS proc_count, coalesce(nurse_proc_count, 0) AS nurse_proc_count,
 coalesce(nurse_proc_count_det, 0) AS nurse_proc_count_det,
 {rnd('CASE WHEN patient_hours > 0 THEN nurse_hours / (patient_hours / 24.0) ELSE 0 END', 'nurse_hppd', 4)},
 {rnd('CASE WHEN nurse_hours > 0 THEN rn_hours / nurse_hours ELSE 0 END', 'nurse_skillmix')},
 {_vital_sql()}, {TARGET_COLS}, {ts('w.start_dt')}, {ts('w.end_dt')}, {ts('w.outcome_end', 'outcome_window_end')}, w.censoring_reason
FROM v_target w LEFT JOIN v_counts USING (episode_id, window_index) LEFT JOIN v_staff USING (episode_id, window_index)
LEFT JOIN v_vitals v USING (episode_id, window_index)"""


@query("window_features", WINDOW_FEATURES_SQL)
def _(t: Tables) -> DataFrame:
    cols = ["episode_id", "unit_id", "window_index", "ri_initial", "window_hours", "follow_up_hours", *W.COUNT_COLS, "nurse_hppd", "nurse_skillmix"]
    cols += [*W.VITAL_COLS, "delta_ri", "outcome_status", "missing_loinc_85556_9_t0", "missing_loinc_85556_9_t1", "missing_delta_ri"]
    cols += ["ri_window_start", "start_dt", "end_dt", "outcome_window_end", "censoring_reason"]
    return emit(features(t).select(*cols), nurse_hppd=4)


@query(
    "schema_hash",
    """WITH x AS (SELECT event_type, [event_type || '_count', 'ri_initial', 'lang'] AS f, ['delta_ri', 'outcome_status'] AS g, count(*) AS n_rows FROM events GROUP BY ALL)
    SELECT event_type, n_rows, sha256(array_to_string(list_sort(f), '|') || '#' || array_to_string(list_sort(g), '|')) AS schema_hash FROM x""",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    names = F.create_map(F.concat("event_type", F.lit("_count")), F.lit(0), F.lit("ri_initial"), F.lit(0), F.lit("lang"), F.lit(0))
    targets = F.create_map(F.lit("outcome_status"), F.lit(0), F.lit("delta_ri"), F.lit(0))
    return rows.withColumn("schema_hash", W.schema_hash(F.map_keys(names), F.map_keys(targets)))


SNAP = ["ri_window_start", "delta_ri", "outcome_window_end", "discharge", "ri_start", "ri_end", "episode_id"]
SNAP_SQL = " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, {len(SNAP)} AS n_cols, '{c}' AS \"column\", {rnd(f'avg(CAST({src} IS NULL AS DOUBLE))', 'missing_rate')} FROM v_target"
    for c, src in [(c, "outcome_end" if c == "outcome_window_end" else c) for c in SNAP]
)


@query("missing_rate_snapshot", SNAP_SQL)
def _(t: Tables) -> DataFrame:
    return emit(W.missing_rate_snapshot(target(t).select(*SNAP)))


RECOMPUTE_SQL = f"""
WITH x_c AS (SELECT *, least(coalesce(discharge, TIMESTAMP '9999-01-01'), end_dt + INTERVAL 48 HOUR) AS oe, coalesce(discharge < end_dt + INTERVAL 48 HOUR, false) AS cut FROM v_target),
x_r AS (SELECT *, coalesce(outcome_end = oe AND outcome_start <= outcome_end, false) AS reuse FROM x_c),
x_s AS (SELECT episode_id, obs_id, effective_dt, value_num FROM v_obs WHERE value_num IS NOT NULL AND (code = '85556-9' OR lower(code) = 'ri')),
x_v AS (SELECT r.episode_id, r.window_index, count(*) AS n, arg_min(s.value_num, s.effective_dt) AS a, arg_max(s.value_num, s.effective_dt) AS b
  FROM x_r r JOIN x_s s ON s.episode_id = r.episode_id AND s.effective_dt BETWEEN r.end_dt AND r.oe WHERE NOT r.reuse GROUP BY ALL),
x_f AS (SELECT r.*, coalesce(v.n >= 2, false) AS ok, v.a, v.b FROM x_r r LEFT JOIN x_v v USING (episode_id, window_index))
SELECT episode_id, window_index, reuse, {ts('oe', 'outcome_window_end')},
 CASE WHEN reuse THEN censoring_reason WHEN cut THEN 'discharged_before_outcome_window_end' ELSE 'not_censored' END AS censoring_reason,
 {rnd('CASE WHEN reuse THEN delta_ri WHEN ok THEN b - a END', 'delta_ri')},
 CASE WHEN reuse THEN missing_delta_ri WHEN ok THEN 0 ELSE 1 END AS missing_delta_ri,
 CASE WHEN reuse THEN outcome_status WHEN ok THEN 'defensible_fixed_horizon' ELSE 'insufficient_outcome_evidence' END AS outcome_status,
 CASE WHEN reuse THEN '' ELSE 'outcome_recomputed_for_target_trial_horizon|stored_outcome_window_mismatch_target_trial' END AS warnings
FROM x_f"""


@query("causal_outcome_recompute", RECOMPUTE_SQL)
def _(t: Tables) -> DataFrame:
    out = W.causal_outcome_recompute(target(t), W.ri_series(t.observations, variant="causal"), horizon_hours=48)
    cols = ["reuse", "outcome_window_end", "censoring_reason", "delta_ri", "missing_delta_ri", "outcome_status", "warnings"]
    return emit(out.select(*KEYS, *cols))
